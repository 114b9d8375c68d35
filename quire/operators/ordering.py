"""Dense positions, running totals and greedy packing over a global order, without moving all rows to one task.

Rows are dealt into ranges of the order (repartitionByRange with ties included, so neither a prefix nor a key that most rows share makes a
range larger than others), sorted there and stored once, each with its range and what comes before it within.  The totals of the
ranges, one row each, are added up and joined back.  Tasks take rows batch by batch and hold no range.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.operators.staging import staged

_PLACE_BITS = 33  # of monotonically_increasing_id: the partition is above them


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ranged(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df sorted in ranges of the order (nulls first), with each row's range, name, and its place in it, name + "_pos"."""
    dealt = df.repartitionByRange(*map(_c, order)).sortWithinPartitions(*map(_c, order)).withColumn("__at", F.monotonically_increasing_id())
    return dealt.withColumns({name: F.shiftright("__at", _PLACE_BITS).cast("int"), f"{name}_pos": F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1)}).drop("__at")


def _added(rows: DataFrame, sums: DataFrame, value: str, name: str) -> DataFrame:
    """rows with name: the total of value over the ranges before, and of what is in "__inner". sums has a row for each range."""
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__range", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("__base"))
    return rows.join(F.broadcast(base), "__range").withColumn(name, F.col("__base") + F.col("__inner")).drop("__range", "__inner", "__base")


def with_position(df: DataFrame, key: Column | str, name: str, ties: tuple[Column | str, ...] = ()) -> DataFrame:
    """df with its rows' places (from 0) in the order of key and ties, which together tell rows apart."""
    rows = staged(ranged(df, [key, *ties], "__range").withColumnRenamed("__range_pos", "__inner"), "ranges")
    return _added(rows, rows.groupBy("__range").agg(F.count("*").alias("__n")), "__n", name)


def with_text_position(df: DataFrame, key: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The same in the byte order of a text or binary key."""
    return with_position(df, F.col(key).cast("binary"), name, ties)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, the last column (a long) replaced by its total over the rows before."""
    total = 0
    for batch in batches:
        k = batch.num_columns - 1
        values = batch.column(k).fill_null(0).to_numpy()
        sums = total + np.cumsum(values)
        total = int(sums[-1]) if len(sums) else total
        yield batch.set_column(k, batch.schema.field(k), pa.array(sums - values))


def with_text_running_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the total of value over all rows before a row in the byte order of a unique text key."""
    dealt = ranged(df, [F.col(key).cast("binary")], "__range").drop("__range_pos").withColumn("__inner", F.col(value).cast("long"))
    rows = staged(dealt.mapInArrow(_running, dealt.schema), "ranges")
    return _added(rows, rows.groupBy("__range").agg(F.sum(F.col(value).cast("long")).alias("__sum")), "__sum", name)


class _Run:
    """Blobs of a range in order, batch by batch; bytes are counted from the range's start."""

    def __init__(self, limit: int):
        self.limit, self.total = limit, 0

    def taken(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(before, after, next) of a batch's blobs: the bytes up to each and with it, and the blob that begins a chunk after one that
        begins with it (their number if none here does)."""
        after = self.total + np.cumsum(lengths)
        before = after - lengths
        if len(after):
            self.total = int(after[-1])
        return before, after, np.maximum(np.arange(len(after)) + 1, np.searchsorted(after, before + self.limit, side="right"))


class _Summary(_Run):
    """What a range does to the chunk that is open at its start, by the bytes that it reaches into the range.

    A reach of low or more, and less than the next low, is followed by the same chunks: they begin with the blob at low. Those that come
    to begin at the same blobs are followed together, so a batch costs little more than one run through it.
    """

    def __init__(self, limit: int):
        super().__init__(limit)
        self.low, self.reach, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, lengths: np.ndarray) -> None:
        before, after, following = self.taken(lengths)
        fresh = np.flatnonzero(before <= self.limit)
        states, of = np.unique(self.reach, return_inverse=True)
        now = np.concatenate([np.searchsorted(after, states, side="right"), fresh])
        last, count = np.full(len(now), -1), np.zeros(len(now), np.int64)
        while (going := np.flatnonzero(now < len(after))).size:
            last[going] = now[going]
            count[going] += 1
            now[going] = following[now[going]]
        reach = np.concatenate([states, np.zeros(len(fresh), np.int64)])
        reach[last >= 0] = before[last[last >= 0]] + self.limit
        which = np.concatenate([of, np.arange(len(states), len(now))])
        self.low = np.concatenate([self.low, before[fresh]])
        self.count = np.concatenate([self.count, np.zeros(len(fresh), np.int64)]) + count[which]
        self.reach = reach[which]

    def steps(self) -> list[tuple[int, int, int]]:
        """(low, out, chunks): for a reach of low or more, the reach beyond the range, and how many chunks begin in it. A reach of the
        range's bytes or more passes over it."""
        out = self.reach - self.total
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (self.count[1:] != self.count[:-1])
        at = np.flatnonzero(new)
        return [(low if j else -(1 << 62), o, c) for j, (low, o, c) in enumerate(zip(self.low[at].tolist(), out[at].tolist(), self.count[at].tolist()))]


class _Places(_Run):
    """The chunk and offset of each blob, a range being entered with this reach in this chunk."""

    def __init__(self, limit: int, reach: int, chunk: int):
        super().__init__(limit)
        self.reach, self.chunk = reach, chunk

    def take(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after, following = self.taken(lengths)
        starts, j = [], int(np.searchsorted(after, self.reach, side="right"))
        while j < len(after):
            starts.append(j)
            j = int(following[j])
        which = np.searchsorted(np.array(starts, np.int64), np.arange(len(after)), side="right")
        begin = np.concatenate([[self.reach - self.limit], before[starts]]) if starts else np.array([self.reach - self.limit])
        chunk, offset = self.chunk + which, before - begin[which]
        self.reach, self.chunk = int(begin[-1]) + self.limit, self.chunk + len(starts)
        return chunk, offset


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(range, part of a batch) in order; the range is the first column."""
    for batch in batches:
        r = batch.column(0).to_numpy()
        for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]):
            if b > a:
                yield int(r[a]), batch.slice(a, b - a)


def chunked(lengths: DataFrame, limit: int, id_col: str = "id", length_col: str = "length") -> DataFrame:
    """(id, length, chunk_id, offset): blobs appended in id order, a new chunk begun when one would pass limit.

    What a range of blobs does depends on the chunk that is open at its start, but chunks soon begin at the same blobs whatever that
    is.  So each range is summed up as a step function of it, in parallel; one task follows these few steps from range to range, and
    the ranges place their blobs in parallel. A first blob over the limit leaves chunk 0 empty.
    """
    rows = ranged(lengths.select(F.col(id_col).cast("long").alias("id"), F.col(length_col).cast("long").alias("length")), ["id"], "r").select("r", "id", "length")
    rows = staged(rows, "ranges")
    in_order = lambda df: df.repartition("r").sortWithinPartitions("r", "id")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, parts in itertools.groupby(_runs(batches), lambda x: x[0]):
            run = _Summary(limit)
            for _, part in parts:
                run.take(part.column(2).to_numpy())
            low, out, count = zip(*run.steps(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(low), pa.int32()), pa.array([run.total] * len(low)), *(pa.array(x, pa.int64()) for x in (low, out, count))], names=["r", "total", "low", "out", "chunks"])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, chunk, now, total, steps = limit, 0, None, 0, []

        def behind() -> tuple[int, int]:
            if now is None or reach >= total:
                return reach - total, chunk
            out, count = next((o, c) for low, o, c in reversed(steps) if reach >= low)
            return out, chunk + count

        for batch in batches:
            entered = []
            for r, t, low, out, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != now:
                    reach, chunk = behind()
                    now, total, steps = r, t, []
                    entered.append((r, reach, chunk))
                steps.append((low, out, count))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in entered], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["r", "reach", "chunk"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in itertools.groupby(_runs(batches), lambda x: x[0]):
            run = None
            for _, part in parts:
                run = run or _Places(limit, part.column(3)[0].as_py(), part.column(4)[0].as_py())
                chunk, offset = run.take(part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(chunk), pa.array(offset)], names=[id_col, length_col, "chunk_id", "offset"])

    steps = in_order(rows).mapInArrow(summed, "r int, total long, low long, out long, chunks long")
    entered = staged(steps.repartition(1).sortWithinPartitions("r", "low").mapInArrow(followed, "r int, reach long, chunk long"), "entered")
    known = rows.join(F.broadcast(entered), "r").select("r", "id", "length", "reach", "chunk")  # a row a range
    return in_order(known).mapInArrow(placed, f"`{id_col}` long, `{length_col}` long, chunk_id long, offset long")
