"""Published versions of a set of tables: readers see all of one build, or all of the one before.

A build writes its tables to a folder of its own. Publishing adds a manifest, which says where each table lies: tables that the build
did not make stay where they were. Manifests are numbered, written beside and renamed, so one is there whole or not at all; of two
builds that publish at once, the second to rename fails. What fails before that leaves readers with what they had.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"manifest-(\d{8})\.json")


def _store(spark: SparkSession, path: str):
    """The store's file system, its Path class, and path in it."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _numbers(spark: SparkSession, path: str) -> list[int]:
    store, make = _store(spark, path)
    found = store.listStatus(make(path)) if store.exists(make(path)) else []
    return sorted(int(m[1]) for f in found if (m := _NAME.fullmatch(f.getPath().getName())))


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    lines = spark.read.text(f"{path}/manifest-{number:08d}.json", wholetext=True).first()
    return json.loads(lines[0])


def current(spark: SparkSession, path: str) -> dict[str, str]:
    """Where the tables published last lie; none if nothing is published."""
    numbers = _numbers(spark, path)
    return _manifest(spark, path, numbers[-1]) if numbers else {}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A published table."""
    found = current(spark, path)
    if name not in found:
        raise FileNotFoundError(f"{path} has no published table {name}")
    return spark.read.parquet(f"{path}/{found[name]}")


class Build:
    """Tables of a build: keep() writes one, publish() shows all of them to readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder, self.made = spark, path.rstrip("/"), f"build-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str, **how) -> DataFrame:
        self.made[name] = f"{self.folder}/{name}"
        place = f"{self.path}/{self.made[name]}"
        df.write.parquet(place, **how)
        return self.spark.read.parquet(place)

    def publish(self) -> int:
        """The number of the new manifest."""
        number = (_numbers(self.spark, self.path) or [-1])[-1] + 1
        tables = (_manifest(self.spark, self.path, number - 1) if number else {}) | self.made
        store, make = _store(self.spark, self.path)
        draft, final = make(f"{self.path}/{self.folder}/manifest.json"), make(f"{self.path}/manifest-{number:08d}.json")
        out = store.create(draft, True)
        try:
            out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        finally:
            out.close()
        if store.exists(final) or not store.rename(draft, final):
            raise RuntimeError(f"another build has published manifest {number}")
        return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes builds that none of the last manifests names, and older manifests; returns the builds deleted. Not to be run beside a build."""
    numbers = _numbers(spark, path)
    used = {place.split("/")[0] for n in numbers[-keep:] for place in _manifest(spark, path, n).values()}
    store, make = _store(spark, path)
    gone = [name for f in store.listStatus(make(path)) if (name := f.getPath().getName()).startswith("build-") and name not in used]
    for name in [*(f"manifest-{n:08d}.json" for n in numbers[:-keep]), *gone]:
        store.delete(make(f"{path}/{name}"), True)
    return gone
