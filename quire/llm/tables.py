"""Tables that cut lineage: written to the folder all executors share, and read again.

Every table lies in the folder of the innermost open scratch(), which deletes it at its end at the latest; tables stored outside
of one belong to the program and go when it ends, or at clean().  Operators delete what their result does not read.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_open: list[str] = []
_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a folder of this machine will do for a local master only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quire-checkpoint-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted as stored tables are."""
    path = f"{_open[-1] if _open else f'{shared_folder(spark)}/quire'}/{name}-{uuid.uuid4().hex}"
    if not _open:
        _left[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables stored in this block are deleted at its end; read the results before."""
    folder = f"{shared_folder(spark)}/quire/scratch-{uuid.uuid4().hex}"
    _open.append(folder)
    try:
        yield folder
    finally:
        _open.remove(folder)
        _delete(spark, folder)


def clean() -> None:
    """Deletes all tables stored outside of a scratch() so far."""
    while _left:
        path, spark = _left.popitem()
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)


atexit.register(clean)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe against lost executors.

    What the finished job kept on disk for shuffles goes when the driver's garbage is collected, so that is done here.
    """
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, name)
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        _left.pop(df.stored_path, None)
        _delete(df.sparkSession, df.stored_path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
