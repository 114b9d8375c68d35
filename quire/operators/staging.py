"""Tables that are computed once: written to the folder all executors share, and read again.

What needs the same rows twice (counts of ranges and then their places, a parse and then its holes) stores them, so that both reads see
the same rows, also after executors are lost. The tables lie in spark.checkpoint.dir and are deleted when the program ends, or by clean().
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without it a folder of this machine, for a local master only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quire-staging-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted as staged tables are."""
    path = f"{_folder(spark)}/quire/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table."""
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean() -> None:
    """Deletes all staged tables."""
    while _left:
        path, spark = _left.popitem()
        with contextlib.suppress(Exception):  # the session may be gone
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


atexit.register(clean)
