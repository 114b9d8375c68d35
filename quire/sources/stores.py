"""Binary files as data sources: tasks write and read parts of files themselves, where the store allows it.

``quire_parts`` writes rows (part, data) that come sorted by part: each task writes its parts to a staging folder, and the commit moves them
to their places, or joins them to one file, and deletes what an earlier run left over.  Until then, and if any task fails, the old files
stay as they are.  ``quire_records`` reads files of fixed-size records by ranges of whole records, so a file of any length is read by as
many tasks as wanted.  ``ranges_of_files`` reads stated byte ranges: each file is opened once, and only those bytes are read.

Tasks open files through pyarrow's file systems, by path or URI (file, s3, gs, hdfs).
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BATCH_BYTES = 4 << 20


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return stores.FileSystem.from_uri(path if re.match(r"[a-z0-9+]+:", path) else f"file://{path}")


@dataclass
class _Staged(WriterCommitMessage):
    """What a task has written: (part, path) of each file."""

    files: list[tuple[int, str]]


class _PartsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.stem, self.file, self.head = options["folder"], options.get("stem"), options.get("file"), bytes.fromhex(options.get("head", ""))
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Staged:
        store, folder = opened(self.folder)
        place = f"{folder}/{self.staging}"
        store.create_dir(place, recursive=True)
        attempt, files, out, now = uuid.uuid4().hex, [], None, None
        try:
            for batch in batches:
                parts, data = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
                for a, b in itertools.pairwise(cuts):
                    if a == b:
                        continue
                    if parts[a] != now:
                        if out:
                            out.close()
                        now = int(parts[a])
                        files.append((now, f"{place}/{now}-{attempt}"))
                        out = store.open_output_stream(files[-1][1])
                    run = data.slice(a, b - a).drop_null()
                    if len(run):
                        offsets = np.frombuffer(run.buffers()[1], np.int64)[run.offset : run.offset + len(run) + 1]
                        if offsets[-1] > offsets[0]:
                            out.write(run.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
        finally:
            if out:
                out.close()
        return _Staged(files)

    def commit(self, messages: list[_Staged | None]) -> None:
        store, folder = opened(self.folder)
        files = sorted(f for m in messages if m is not None for f in m.files)
        if any(a[0] == b[0] for a, b in itertools.pairwise(files)):
            raise ValueError("rows of one part came from several tasks")
        store.create_dir(f"{folder}/{self.staging}", recursive=True)
        if self.file:
            whole = f"{folder}/{self.staging}/whole"
            with store.open_output_stream(whole) as out:
                out.write(self.head)
                for _, path in files:
                    with store.open_input_stream(path) as part:
                        while piece := part.read(BATCH_BYTES):
                            out.write(piece)
            store.move(whole, f"{folder}/{self.file}")
        else:
            made = dict(files)
            count = max(made, default=-1) + 1
            for k in range(count):
                if k not in made:
                    made[k] = f"{folder}/{self.staging}/{k}"
                    store.open_output_stream(made[k]).close()
                store.move(made[k], f"{folder}/{self.stem}_{k:04d}.dat")
            for k, path in _numbered(store, folder, self.stem):
                if k >= count:
                    store.delete_file(path)
        store.delete_dir(f"{folder}/{self.staging}")

    def abort(self, messages: list[_Staged | None]) -> None:
        store, folder = opened(self.folder)
        if store.get_file_info(f"{folder}/{self.staging}").type == stores.FileType.Directory:
            store.delete_dir(f"{folder}/{self.staging}")


class Parts(DataSource):
    """Options: folder, and stem (files stem_NNNN.dat by part) or file (all parts in order, after the bytes of head, in hex)."""

    @classmethod
    def name(cls) -> str:
        return "quire_parts"

    def schema(self) -> str:
        return "part long, data binary"

    def writer(self, schema, overwrite: bool) -> _PartsWriter:
        return _PartsWriter(dict(self.options))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, count: int):
        self.path, self.start, self.count = path, start, count


class _RecordsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size, self.head = options["path"], int(options["size"]), int(options.get("head", 0))
        self.most, self.parts = int(options.get("count", -1)), int(options["parts"])

    def partitions(self) -> list[_Range]:
        store, path = opened(self.path)
        count = max(0, store.get_file_info(path).size - self.head) // self.size
        count = count if self.most < 0 else min(count, self.most)
        bounds = [count * k // self.parts for k in range(self.parts + 1)]
        return [_Range(path, a, b - a) for a, b in itertools.pairwise(bounds) if b > a] or [_Range(path, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        step = max(1, BATCH_BYTES // self.size)
        if part.count:
            with store.open_input_file(part.path) as file:
                for at in range(part.start, part.start + part.count, step):
                    n = min(step, part.start + part.count - at)
                    data = pa.py_buffer(file.read_at(n * self.size, self.head + at * self.size))
                    records = pa.Array.from_buffers(pa.binary(self.size), n, [None, data]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n, dtype=np.int64)), records], names=["pos", "record"])


class Records(DataSource):
    """Options: path, size of a record, parts; head (bytes before the first record) and count (most records). A short last one is left out."""

    @classmethod
    def name(cls) -> str:
        return "quire_records"

    def schema(self) -> str:
        return "pos long, record binary"

    def reader(self, schema) -> _RecordsReader:
        return _RecordsReader(dict(self.options))


def fixed_records(spark: SparkSession, path: str, size: int, head: int = 0, count: int = -1, parts: int | None = None) -> DataFrame:
    """(pos, record) of a file of records of size bytes; parts tasks read it (by default, as many as there are shuffle partitions)."""
    spark.dataSource.register(Records)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.format("quire_records").options(path=path, size=size, head=head, count=count, parts=parts).load()


def write_parts(rows: DataFrame, folder: str, **where: str) -> None:
    """Writes rows (part, data), sorted within partitions and each part in one of them, in one job; where: stem, or file and head."""
    rows.sparkSession.dataSource.register(Parts)
    rows.write.format("quire_parts").options(folder=folder, **where).mode("append").save()


def _numbered(store: stores.FileSystem, folder: str, stem: str) -> list[tuple[int, str]]:
    """(number, path) of the files stem_NNNN.dat of a folder."""
    found = store.get_file_info(stores.FileSelector(folder, allow_not_found=True))
    return sorted((int(m[1]), f.path) for f in found if (m := re.fullmatch(rf"{re.escape(stem)}_(\d+)\.dat", f.base_name)))


def count_of_files(folder: str, stem: str) -> int:
    store, path = opened(folder)
    return len(_numbered(store, path, stem))


def read_bytes(path: str, offset: int, length: int) -> bytes:
    """A few bytes of a file, for headers."""
    store, place = opened(path)
    with store.open_input_file(place) as file:
        return file.read_at(length, offset)


def _ranged(batches: Iterator[pa.RecordBatch], open_file) -> Iterator[pa.RecordBatch]:
    """Rows (key, path, offset, length) with data in place of the last three; ranges that a file doesn't have whole are left out."""
    now, file, size = None, None, 0
    for batch in batches:
        keys, data, held = [], [], 0
        for k, (path, offset, length) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)))):
            if path != now:
                if file:
                    file.close()
                now, file = path, open_file(path)
                size = file.size() if file else 0
            if offset >= 0 and length >= 0 and offset + length <= size:
                keys.append(k)
                data.append(file.read_at(length, offset) if length else b"")
                held += length
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(data, pa.binary())], names=["key", "data"])
                keys, data, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(data, pa.binary())], names=["key", "data"])
    if file:
        file.close()


def ranges_of_files(places: DataFrame) -> DataFrame:
    """(key, data) of places (key, path, offset, length). A task opens each of its files once and reads the ranges in their order; a
    file's ranges are dealt out to several tasks by stretches of it, so that a file that is asked for often holds none up."""

    def open_file(path: str):
        store, place = opened(path)
        return store.open_input_file(place) if store.get_file_info(place).type == stores.FileType.File else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _ranged(batches, open_file)

    kind = places.schema["key"].dataType.simpleString()
    dealt = places.select("key", "path", F.col("offset").cast("long"), F.col("length").cast("long")).repartition("path", F.floor(F.col("offset") / (16 * BATCH_BYTES)))
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(read, f"key {kind}, data binary")
