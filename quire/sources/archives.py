"""ZIM archives as a data source: entries by ranges, and archives written from entries.

``quire_archive`` reads an archive or a folder of them.  A task takes a range of entries: it reads their directory records and then,
unless the schema leaves out ``content``, each cluster that they lie in once.  Give ``.schema()`` the columns wanted: any of ENTRIES, and
``error``, with which entries that can't be read come as rows of their own; without it they are left out.

Fixed values of the format are its header, the codes of directory records and the codes of compressions.
"""

from __future__ import annotations

import io
import itertools
import lzma
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.operators import ordering
from quire.schemas import ENTRIES
from quire.sources.stores import BATCH_BYTES, opened, write_parts

MAGIC, HEADER = 72173914, "<IHH16sIIQQQQIIQ"
REDIRECT, LINK, DELETED = 0xFFFF, 0xFFFE, 0xFFFD
PLAIN, XZ, ZSTD, WIDE = (0, 1), 4, 5, 0x10
RECORD_BYTES = 4096  # read at once for a directory record; paths and titles are rarely longer
_ARROW = {"entry_id": pa.int64(), "path": pa.string(), "title": pa.string(), "is_redirect": pa.bool_(), "mimetype": pa.string(), "content": pa.binary(), "error": pa.string()}


class Archive:
    """An open archive. file: read_at(bytes, offset) and size()."""

    def __init__(self, file):
        self.file = file
        head = self._exactly(0, struct.calcsize(HEADER))
        magic, _, _, _, self.count, self.clusters, self.paths_at, _, self.clusters_at, mimes_at, _, _, end = struct.unpack(HEADER, head)
        if magic != MAGIC:
            raise ValueError("not a ZIM archive")
        self.end = end or file.size()
        self.mimes = self._text_list(mimes_at)

    def _exactly(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError("the archive ends early")
        return data

    def _text_list(self, at: int) -> list[str]:
        data, out = b"", []
        while b"\0\0" not in data:
            more = self.file.read_at(RECORD_BYTES, at + len(data))
            data += more
            if len(more) < RECORD_BYTES:
                break
        for x in data.split(b"\0"):
            if not x:
                break
            out.append(x.decode("utf-8", "replace"))
        return out

    def numbers(self, at: int, first: int, n: int) -> tuple[int, ...]:
        """n 64-bit numbers of a list, from the first-th on."""
        return struct.unpack(f"<{n}Q", self._exactly(at + 8 * first, 8 * n))

    def record(self, at: int) -> tuple[str, str, str | None, tuple[int, int] | None]:
        """(path, title, MIME type, (cluster, blob)) of a directory record; the last two are None for redirects."""
        size = RECORD_BYTES
        data = self.file.read_at(size, at)
        mime, _, namespace = struct.unpack_from("<HBc", data)
        if mime in (LINK, DELETED):
            raise ValueError("a deleted entry")
        begin = 12 if mime == REDIRECT else 16
        while data.count(b"\0", begin) < 2 and len(data) == size:
            size *= 2
            data = self.file.read_at(size, at)
        url, title, _ = data[begin:].split(b"\0", 2)
        url, title, namespace = (x.decode("utf-8", "replace") for x in (url, title, namespace))
        path = url if namespace == "C" else f"{namespace}/{url}"
        return (path, title or url, None, None) if mime == REDIRECT else (path, title or url, self.mimes[mime], struct.unpack_from("<II", data, 8))

    def blobs(self, cluster: int) -> list[bytes]:
        if cluster >= self.clusters:
            raise ValueError("no such cluster")
        begin = self.numbers(self.clusters_at, cluster, 1)[0]
        end = self.numbers(self.clusters_at, cluster + 1, 1)[0] if cluster + 1 < self.clusters else self.end
        raw = self._exactly(begin, end - begin)
        kind, data = raw[0] & 0xF, raw[1:]
        if kind == XZ:
            data = lzma.decompress(data)
        elif kind == ZSTD:
            data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
        elif kind not in PLAIN:
            raise ValueError(f"compression {kind} is not known")
        code, width = ("Q", 8) if raw[0] & WIDE else ("I", 4)
        n = struct.unpack_from(f"<{code}", data)[0] // width
        bounds = struct.unpack_from(f"<{n}{code}", data)
        return [data[a:b] for a, b in itertools.pairwise(bounds)]

    def entries(self, first: int, n: int, with_content: bool) -> Iterator[dict]:
        """Entries of a range as rows, those of a cluster together; what can't be read has only an error."""
        places = []
        for k, at in enumerate(self.numbers(self.paths_at, first, n), first):
            try:
                path, title, mime, place = self.record(at)
            except (ValueError, IndexError, struct.error) as fault:
                yield {"entry_id": k, "error": str(fault)}
                continue
            row = {"entry_id": k, "path": path, "title": title, "is_redirect": place is None, "mimetype": mime}
            if place is None or not with_content:
                yield row
            else:
                places.append((*place, row))
        for cluster, group in itertools.groupby(sorted(places, key=lambda x: x[:2]), lambda x: x[0]):
            try:
                blobs, fault = self.blobs(cluster), None
            except (ValueError, IndexError, struct.error, lzma.LZMAError, zstandard.ZstdError, MemoryError) as e:
                blobs, fault = [], e
            for _, blob, row in group:
                yield row | {"content": blobs[blob]} if blob < len(blobs) else {"entry_id": row["entry_id"], "path": row["path"], "error": str(fault or "no such blob")}


@dataclass
class _Entries(InputPartition):
    path: str
    first: int
    count: int
    before: int  # entries of the archives before


class _ArchiveReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.columns, self.path, self.step = schema.fieldNames(), options["path"], int(options.get("entries", 4096))

    def partitions(self) -> list[_Entries]:
        store, path = opened(self.path)
        info = store.get_file_info(path)
        if info.type == stores.FileType.Directory:
            files = sorted(f.path for f in store.get_file_info(stores.FileSelector(path)) if f.type == stores.FileType.File and not f.base_name.startswith(("_", ".")))
        else:
            files = [path]
        out, before = [], 0
        for name in files:
            with store.open_input_file(name) as file:
                n = Archive(file).count
            out += [_Entries(name, at, min(self.step, n - at), before) for at in range(0, n, self.step)]
            before += n
        return out or [_Entries("", 0, 0, 0)]

    def read(self, part: _Entries) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        store, _ = opened(self.path)
        with store.open_input_file(part.path) as file:
            rows, held = [], 0
            for row in Archive(file).entries(part.first, part.count, "content" in self.columns):
                if "error" in row and "error" not in self.columns:
                    continue
                row["entry_id"] += part.before
                rows.append(row)
                held += len(row.get("content") or b"")
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _ARROW[c]) for c in self.columns], names=self.columns)


class ArchiveSource(DataSource):
    """Options: path (an archive or a folder of them), entries (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "quire_archive"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> _ArchiveReader:
        return _ArchiveReader(schema, dict(self.options))


def archive_entries(spark: SparkSession, path: str, columns: str = ENTRIES, entries_of_task: int = 4096) -> DataFrame:
    """The entries of an archive, or of a folder of them numbered on in the order of their names."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("quire_archive").schema(columns).options(path=path, entries=entries_of_task).load()


def packed(entries: list[tuple[str, str, bool, str | None, bytes | None]], cluster_bytes: int = 1 << 20) -> bytes:
    """An archive of entries (path, title, is_redirect, mimetype, content). Redirects lead to the first entry."""
    entries = sorted(entries, key=lambda e: _place(e[0]))
    mimes = sorted({e[3] or "" for e in entries if not e[2]})
    groups: list[list[bytes]] = [[]]
    records = []
    for path, title, redirect, mime, content in entries:
        namespace, url = _place(path)
        if redirect:
            head = struct.pack("<HBcII", REDIRECT, 0, namespace, 0, 0)
        else:
            if sum(map(len, groups[-1])) >= cluster_bytes:
                groups.append([])
            head = struct.pack("<HBcIII", mimes.index(mime or ""), 0, namespace, 0, len(groups) - 1, len(groups[-1]))
            groups[-1].append(content or b"")
        records.append(head + url + b"\0" + (title or "").encode() + b"\0")
    clusters = []
    for blobs in groups:
        bounds = list(itertools.accumulate(map(len, blobs), initial=4 * (len(blobs) + 1)))
        clusters.append(bytes([ZSTD]) + zstandard.compress(struct.pack(f"<{len(bounds)}I", *bounds) + b"".join(blobs)))
    listed = b"".join(m.encode() + b"\0" for m in mimes) + b"\0"
    at = struct.calcsize(HEADER)
    paths_at = at + len(listed)
    titles_at = paths_at + 8 * len(records)
    records_at = titles_at + 4 * len(records)
    places = list(itertools.accumulate(map(len, records), initial=records_at))
    clusters_at = places[-1]
    starts = list(itertools.accumulate(map(len, clusters), initial=clusters_at + 8 * len(clusters)))
    by_title = sorted(range(len(entries)), key=lambda k: entries[k][1] or "")
    head = struct.pack(HEADER, MAGIC, 5, 0, bytes(16), len(records), len(clusters), paths_at, titles_at, clusters_at, at, 0xFFFFFFFF, 0xFFFFFFFF, starts[-1])
    return b"".join([head, listed, struct.pack(f"<{len(records)}Q", *places[:-1]), struct.pack(f"<{len(records)}I", *by_title), *records, struct.pack(f"<{len(clusters)}Q", *starts[:-1]), *clusters])


def _place(path: str) -> tuple[bytes, bytes]:
    """(namespace, URL) of a path."""
    return (path[0].encode(), path[2:].encode()) if path[1:2] == "/" and path[0].isascii() else (b"C", path.encode())


def write_archives(entries: DataFrame, folder: str, stem: str = "archive", most_bytes: int = 16 << 20) -> None:
    """Archives stem_NNNN.dat of entries in the order of their ids, each of at most most_bytes of content or of one entry; a task packs
    one at a time."""
    sized = entries.select(F.col("entry_id").alias("id"), (F.coalesce(F.octet_length("content"), F.lit(0)) + 64).cast("long").alias("length"))
    numbered = ordering.chunked(sized, most_bytes).select(F.col("id").alias("entry_id"), F.col("chunk_id").alias("part"))
    rows = entries.join(numbered, "entry_id").select("part", "path", "title", "is_redirect", "mimetype", "content").repartition("part").sortWithinPartitions("part", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for part, group in itertools.groupby(each, lambda r: r[0]):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([packed([r[1:] for r in group])], pa.binary())], names=["part", "data"])

    write_parts(rows.mapInArrow(run, "part long, data binary"), folder, stem=stem)
