"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA-style).

Vectors are cut to blocks of at most ROWS rows, anchors to blocks of at most ANCHORS, and both to chunks of DIMS dimensions.  An anchor block
and a row block meet once for each chunk; the task multiplies them to a partial tile of int64 scores.  The partial tiles of a pair of
blocks are shuffled together and added one by one, and each whole tile is reduced to the few rows that an anchor can still need of it;
only those go on to the merge by rank.  Two products are made: anchors with the rows of their own label give the positives, and, once these
fix the windows of scores, anchors with all rows give the negatives.  A task holds a few blocks and one tile, whatever the size of a label.

Components are floor(scale * x) as 64-bit integers, and scores are exact as long as sums stay below 2**63 (tiles are multiplied in doubles
where no partial sum can reach 2**53, else in integers).  Rows with a null label, a null vector, or a null or non-finite component take no
part. An empty vector scores 0 with all; of vectors of unequal length the shorter counts as ended with zeros. A null id is no anchor and
comes last among ties. Repeated rows are rows of their own: each may be the other's positive, their ties go by the order of the
stored rows, and repeated anchors give their rows again. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.arrays import tidy
from quire.llm.tables import forget, shuffle_partitions, stored

ROWS, ANCHORS, DIMS = 1024, 64, 32
ROW_GROUP, ANCHOR_GROUP = 8, 4  # blocks that one group of a task holds, about
NO_ID = (1 << 63) - 1  # stands for a null id: last among ties

_BLOCK = "block long, c int, n int, label int, held array<binary>, chunk binary"
_TILE = "a long, g int, r long, i int, c int, held array<binary>, scores binary"
_TILE_ARROW = pa.schema([("a", pa.int64()), ("g", pa.int32()), ("r", pa.int64()), ("i", pa.int32()), ("c", pa.int32()), ("held", pa.list_(pa.binary())), ("scores", pa.binary())])


def usable_rows(df: DataFrame, scale: int, label: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, q) of the rows that take part; row numbers hold for one evaluation, so store them."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.col(label_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.where(usable).select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), label.cast("int").alias("label"), q.alias("q"))


def _matrix(lists: pa.ListArray, multiple: int, fill: int) -> np.ndarray:
    """Lists of longs as rows of a matrix, filled up to the longest one's length or more, a multiple of multiple."""
    counts = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), -(-max(1, int(counts.max())) // multiple) * multiple), fill, np.int64)
    out[np.arange(out.shape[1])[None] < counts[:, None]] = lists.flatten().to_numpy()
    return out


def _packed(size: int, by_label: bool):
    """Rows (row, id, label, q, positives) as a record for each block of at most size rows, all of one label if by_label, and chunk."""

    def record(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        row, ids, labels = (rows.column(j).to_numpy() for j in range(3))
        q = _matrix(rows.column(3), DIMS, 0)
        held = [x.tobytes() for x in (row, ids, labels, _matrix(rows.column(4), 2, -1))]
        n = q.shape[1] // DIMS
        columns = [np.full(n, row[0]), np.arange(n, dtype=np.int32), np.full(n, len(row), np.int32), np.full(n, labels[0] if by_label else 0, np.int32)]
        held = pa.array([held if c == 0 else [] for c in range(n)], pa.list_(pa.binary()))
        chunks = pa.array([q[:, c * DIMS : (c + 1) * DIMS].tobytes() for c in range(n)], pa.binary())
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), held, chunks], names=["block", "c", "n", "label", "held", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, have, last = [], 0, None
        for batch in batches:
            labels = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist()] if by_label else [0]
            for at, end in itertools.pairwise([*cuts, len(labels)]):
                while at < end:
                    if have == size or have and by_label and labels[at] != last:
                        yield record(parts)
                        parts, have = [], 0
                    k = min(end - at, size - have)
                    parts.append(batch.slice(at, k))
                    at, have, last = at + k, have + k, labels[at]
        if have:
            yield record(parts)

    return run


def _product(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """one @ two.T, exactly."""
    most = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (one, two)]
    if most[0] * most[1] * one.shape[1] < 1 << 53:
        return (one.astype(np.float64) @ two.T.astype(np.float64)).astype(np.int64)
    return one @ two.T


def _multiplied(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Partial tiles of all pairs of blocks of a group, a record for each anchor; the first chunk also sends what the tile is of."""
    out = []
    side = lambda t: [(b, n, h, np.frombuffer(x, np.int64).reshape(n, -1)) for b, n, h, x in zip(*(t.column(k).to_pylist() for k in ("block", "n", "held", "chunk")))]
    right = side(rows)
    for a, na, of_a, one in side(anchors):
        for r, _, of_r, two in right:
            tile = _product(one, two)
            first = int(bool(of_a))
            n = na + first
            ends = [pa.array([[*of_r, *of_a]] * first + [[]] * na, pa.list_(pa.binary())), pa.array([None] * first + [x.tobytes() for x in tile], pa.binary())]
            keys = [np.full(n, a), np.full(n, key[-2].as_py(), np.int32), np.full(n, r), np.arange(-first, na, dtype=np.int32), np.full(n, key[1].as_py(), np.int32)]
            out.append(pa.RecordBatch.from_arrays([*map(pa.array, keys), *ends], schema=_TILE_ARROW))
    return pa.Table.from_batches(out, _TILE_ARROW)


def _tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Partial tiles of anchor blocks and row blocks of a label (0 for all rows where blocks have any), with their records in order."""
    counts = [df.agg(F.count_if(F.col("c") == 0)).first()[0] for df in (anchors, rows)]
    h, g = (F.lit(max(1, -(-n // k))) for n, k in zip(counts, (ANCHOR_GROUP, ROW_GROUP)))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = anchors.withColumn("h", F.pmod(F.xxhash64("block"), h).cast("int")).withColumn("g", every(g))
    two = rows.withColumn("g", F.pmod(F.xxhash64("block"), g).cast("int")).withColumn("h", every(h))
    keys = ["label", "c", "g", "h"]
    met = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(_multiplied, _TILE)
    return met.repartition("a", "g").sortWithinPartitions("a", "g", "r", "i", "c")


def _first(keep: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of those to keep: by score downwards, id and row."""
    at = np.flatnonzero(keep)
    if len(at) > 2 * k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((row[at], ids[at], -score[at]))[:k]]


def _reduced(k: int, window: tuple[int, int] | None):
    """Adds up tiles and keeps of each what an anchor can need, over the tiles of an anchor block and a group: without a window the k
    first other rows of its label; with one, for each of its positives, the k first rows of other labels with low*p <= 100*s <= high*p."""

    def wanted(anchor: tuple, score: np.ndarray, row: np.ndarray, label: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        me, mine, positives = anchor
        if window is None:
            yield (me,), (label == mine) & (row != me)
        else:
            other = label != mine
            for p, s in positives:
                if p >= 0:
                    yield (me, p), other & (100 * score >= window[0] * s) & (100 * score <= window[1] * s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", *(["positive"] if window else []), "score", "id", "row"]
        best: dict[tuple, list[np.ndarray]] = {}

        def reduce(total: np.ndarray, i: int) -> None:
            row, ids, label = of_rows
            for key, keep in wanted(of_anchors[i], total, row, label):
                at = _first(keep, total, ids, row, k)
                if len(at):
                    new = [x[at] for x in (total, ids, row)]
                    if key in best:
                        new = [np.concatenate(x) for x in zip(best[key], new)]
                        order = np.lexsort((new[2], new[1], -new[0]))[:k]
                        new = [x[order] for x in new]
                    best[key] = new

        def flush() -> Iterator[pa.RecordBatch]:
            if best:
                counts = [len(x[0]) for x in best.values()]
                keys = [np.repeat(np.array(x, np.int64), counts) for x in zip(*best)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, *map(np.concatenate, zip(*best.values())))], names=names)
                best.clear()

        group, at, total, of_rows, of_anchors = None, None, None, (), []
        for batch in batches:
            places = list(zip(*(batch.column(j).to_pylist() for j in (0, 1, 2, 3))))
            for j, (a, g, r, i) in enumerate(places):
                if total is not None and (a, g, r, i) != at:
                    reduce(total, at[3])
                    total = None
                if (a, g) != group:
                    yield from flush()
                    group = (a, g)
                at = (a, g, r, i)
                if i < 0:
                    row, ids, label, _, me, _, mine, positives = batch.column(5)[j].as_py()
                    of_rows = tuple(np.frombuffer(x, t) for x, t in ((row, np.int64), (ids, np.int64), (label, np.int32)))
                    me = np.frombuffer(me, np.int64)
                    of_anchors = list(zip(me.tolist(), np.frombuffer(mine, np.int32).tolist(), np.frombuffer(positives, np.int64).reshape(len(me), -1, 2).tolist()))
                else:
                    scores = np.frombuffer(batch.column(6)[j].as_buffer(), np.int64)
                    total = scores.copy() if total is None else total + scores
        if total is not None:
            reduce(total, at[3])
        yield from flush()

    return run


def hard_negatives(df: DataFrame, anchors: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per anchor (a condition on "id") and positive, its hard negatives: anchor_id, positive_id, rank, negative_id, both scores.

    Positives are the first rows of the anchor's label, negatives the first of another label whose score is from low to high per cent
    of the positive's. label is an expression over df's columns.
    """
    spark = df.sparkSession
    rows = stored(usable_rows(df, scale, label, id_col, vector_col, label_col), "rows")
    bare = F.array().cast("array<long>").alias("positives")
    chosen = rows.where(anchors & (F.col("id") != NO_ID))
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if(anchors & (F.col("id") != NO_ID))).first()

    def blocks(table: DataFrame, size: int, n: int, by_label: bool) -> DataFrame:
        parts = max(1, min(shuffle_partitions(spark), -(-n // size)))
        dealt = table.repartitionByRange(parts, "label", F.xxhash64("row")).sortWithinPartitions("label")
        return stored(dealt.mapInArrow(tidy(_packed(size, by_label)), _BLOCK), "blocks")

    def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row"))).where(F.col("rank") <= k)

    named = rows.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = [blocks(chosen.select("*", bare), ANCHORS, n_anchors, True), blocks(rows.select("*", bare), ROWS, n_rows, True)]
    found = _tiles(*pairs).mapInArrow(tidy(_reduced(positives, None)), "anchor long, score long, id long, row long")
    held = stored(first(found, ["anchor"], positives).join(named.join(chosen.select(F.col("row").alias("anchor")), "anchor"), "anchor"), "positives")
    forget(*pairs)
    windows = held.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "row", "score"))).alias("p"))  # as many as there are positives
    windows = windows.select(F.col("anchor").alias("row"), F.flatten(F.transform("p", lambda x: F.array(x["row"], x["score"]))).alias("positives"))
    pairs = [blocks(chosen.join(windows, "row"), ANCHORS, n_anchors, False), blocks(rows.select("*", bare), ROWS, n_rows, False)]
    found = _tiles(*pairs).mapInArrow(tidy(_reduced(negatives, (low, high))), "anchor long, positive long, score long, id long, row long")
    last = stored(first(found, ["anchor", "positive"], negatives), "negatives")
    forget(*pairs)
    by = held.select("anchor", "anchor_id", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = last.join(by, ["anchor", "positive"])
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
