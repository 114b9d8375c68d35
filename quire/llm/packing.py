"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing places equal lengths one after another, so what it does depends only on how many pieces there are of
each length.  The driver therefore gets one count for each length (at most seq_len rows, however large the corpus is),
runs the algorithm on those counts with a segment tree over remaining capacities, and keeps its decisions as runs:
"pieces a..b of length L go q to a bin from bin s on, at this offset".  The rank of a piece within its length is counted
in parallel (length and hash bucket), so no task sees all pieces of a length.  The result is that of best-fit decreasing over all
pieces at once.

Null texts count as empty: one piece that holds the end id.  A row is a document of its own: repeated ids and rows give
their pieces again (which of alike pieces goes where is open); null ids are kept.  A very long text is tokenised whole, at the
memory of its ids, and cut into pieces of seq_len.  An empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.arrays import buffers, tidy
from quire.llm.bytebpe import encoder, with_end
from quire.llm.tables import stored

BUCKET_ROWS = 5_000
SALTS = 1 << 20


class OpenBins:
    """Open bins by remaining capacity: ranges of bin numbers, and a segment tree of which capacities have any."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, r: int) -> None:
        i = self.leaves + r
        self.any[i] = bool(self.ranges[r])
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def push(self, r: int, first: int, n: int) -> None:
        if n:
            self.ranges[r].append((first, n))
            self._mark(r)

    def pop(self, r: int) -> tuple[int, int]:
        out = self.ranges[r].pop()
        self._mark(r)
        return out

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least need that an open bin has."""
        i = self.leaves + need
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Pieces of one length, from rank first to the next run's: per to a bin, bins counted from bin on, at offset."""

    length: int
    first: int
    per: int
    bin: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], seq_len: int) -> tuple[list[Run], int]:
    """The runs that best-fit decreasing makes of counts pieces of each length, and the number of bins."""
    bins, runs, used = OpenBins(seq_len), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            first, n = bins.pop(room) if room is not None else (used, -(-left // (seq_len // length)))
            if room is None:
                room, used = seq_len, used + n
            per = room // length
            full = min(n, left // per)
            runs.append(Run(length, rank, per, first, seq_len - room))
            bins.push(room - per * length, first, full)
            rank, left = rank + full * per, left - full * per
            part = min(left, per) if full < n else 0  # the last bin of a run gets what is left
            if part:
                bins.push(room - part * length, first + full, 1)
                rank, left = rank + part, 0
            bins.push(room, first + full + bool(part), n - full - bool(part))
    return runs, used


def cut(n: int, seq_len: int) -> list[int]:
    """Lengths of the pieces of n tokens: all of seq_len but the first, which has the rest."""
    return [n] if n <= seq_len else [n % seq_len] * bool(n % seq_len) + [seq_len] * (n // seq_len)


def pieces(df: DataFrame, tokenizer: str, seq_len: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece of every row, and a salt, by which alike pieces can be told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for i, _, ids, first in encoder(tokenizer).encode_all(*buffers(batch.column(1))):
                ids, first = with_end(ids, first, end_id)
                raw, rows = memoryview(ids.astype("<u4").tobytes()), []
                for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    at = a
                    for k, n in enumerate(cut(b - a, seq_len)):
                        rows.append((i + d, k, at - a, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                        at += n
                if rows:
                    doc, *rest = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                    salt = pa.array(((made + np.arange(len(rows))) % SALTS).astype(np.int32))
                    made += len(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:]), salt], names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "salt"]
    source = df.select(F.col(id_col), F.col(text_col))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, salt int")


def packed(df: DataFrame, tokenizer: str, seq_len: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with the sequence_id and offset that best-fit decreasing gives it; offsets in a sequence have no gaps."""
    made = stored(pieces(df, tokenizer, seq_len, end_id, id_col, text_col), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit_decreasing(counts, seq_len)
    by_length = {n: [r for r in runs if r.length == n] for n in counts}
    tables = {n: tuple(np.array([getattr(r, x) for r in rs], np.int64) for x in ("first", "per", "bin", "offset")) for n, rs in by_length.items()}
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", "salt"), F.lit(buckets)))
    base = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(F.col(id_col), "piece", "ids_crc32", "salt")) - 1
    ranked = dealt.withColumn("inner", inner).join(base, ["length", "bucket"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("inner")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, per, bin_, off = tables[n]
                run = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[run]
                sequence[at], offset[at] = bin_[run] + inside // per[run], off[run] + inside % per[run] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    names = [*ranked.columns[:5], "sequence_id", "offset"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema[:5]]
    return ranked.mapInArrow(place, ", ".join([*kinds, "sequence_id long", "offset long"]))
