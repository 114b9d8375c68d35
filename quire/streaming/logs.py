"""Endless sources: log lines as they are written, and raw readings put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files that come into a folder, with the tag of lines such as "[touch] ..."."""
    lines = spark.readStream.format("text").load(path)
    return lines.select("value", F.nullif(F.regexp_extract("value", r"^\[(\w+)\]", 1), F.lit("")).alias("tag"))


def sampled(readings: DataFrame, n: int = 4) -> DataFrame:
    """Raw readings (device, seq, x, y) as means, cut to whole numbers, of n in turn; those of an unfinished group are left out."""
    groups = readings.groupBy("device", F.floor(F.col("seq") / n).alias("sample"))
    mean = lambda c: F.avg(c).cast("int").alias(c)
    return groups.agg(F.count("*").alias("__n"), mean("x"), mean("y")).where(F.col("__n") == n).drop("__n")


def first_of_each(results: DataFrame, key: str, order: str) -> DataFrame:
    """Of results that came in any order, for each key the one of least order."""
    rest = [c for c in results.columns if c != key]
    best = results.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(key, *[F.col(f"r.`{c}`") for c in rest])
