"""Embedding near-dedup by E8 lattice hashing.

A unit vector goes through one random projection to BLOCKS runs of 8 dimensions for each table; each run is decoded to its
nearest point of the E8 lattice, and the points together are the vector's cell.  A vector also probes the neighbouring
cells behind the PROBES nearest boundaries.  Two vectors meet where one's own cell is owned or probed by the other: at a cosine of
0.95 in a table four times in ten, so of such pairs one in 1,800 meets in none of TABLES tables; closer ones, hardly any.
Whoever meets is held against each other by cosine in double precision.

Nothing writes pairs.  Rows of equal vectors are one class with a weight.  A cell gives a forest of its links, and
components grow from those.  All links of a vector lie within its component, so they are counted there, exactly, in
tiles of TILE x TILE vectors, a strip at a time; large cells are split in tiles as well.  The m distinct vectors of a cell or
component cost m * m cosines and are copied m / TILE times, spread over tiles.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
lengths. A cosine of just the threshold is a link. Null ids get no component, count as vectors for others, and are kept; rows that share an id share a component. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.arrays import mix
from quire.llm.components import connected_components
from quire.llm.tables import forget, stored

TABLES = 14
BLOCKS = 2
SCALE = 2.0
PROBES = 12
TILE = 2048
STRIP = 256
SEED = 20260


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8, the integer points of even sum, to the rows of x."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    gap = x[odd] - r[odd]
    at = np.abs(gap).argmax(axis=1)
    r[odd, at] += np.where(gap[np.arange(len(odd)), at] < 0, -1.0, 1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Twice the nearest points of E8 = D8 and D8 + 1/2, as integers; the first on ties."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    further = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(further[:, None], half, whole)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: two entries of +-2, or eight of +-1 with an even number of -1."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        if bin(signs).count("1") % 2 == 0:
            out.append([-1 if signs >> k & 1 else 1 for k in range(8)])
    return np.array(out, np.int64)


_NEAR = minimal_vectors()


def cells(unit: np.ndarray, table: int, probes: int = PROBES) -> np.ndarray:
    """Hashes of each row's own cell and of the probed neighbours, in that order: rows by 1 + probes."""
    rng = np.random.default_rng(SEED + table)
    plane = rng.standard_normal((unit.shape[1], 8 * BLOCKS)) / np.sqrt(8.0) * SCALE
    y = unit @ plane
    points, steps, costs = [], [], []
    for b in range(BLOCKS):
        part = y[:, 8 * b : 8 * b + 8]
        own = nearest_e8(part)
        # the distance to the boundary with the neighbour at v is |v|/2 less the residual's share along v
        cost = 0.5 * np.sqrt(2.0) - (part - own / 2) @ (_NEAR.T / (2 * np.sqrt(2.0)))
        best = np.argpartition(cost, probes, axis=1)[:, :probes]
        points.append(own)
        steps.append(best)
        costs.append(np.take_along_axis(cost, best, axis=1))
    order = np.argsort(np.concatenate(costs, axis=1), axis=1, kind="stable")[:, :probes]
    variants = np.repeat(np.stack(points, 1)[:, None], probes + 1, axis=1)  # row, variant, block, 8
    rows = np.arange(len(unit))
    for k in range(probes):
        block, which = order[:, k] // probes, order[:, k] % probes
        step = np.stack(steps, 1)[rows, block, which]
        variants[rows, k + 1, block] += _NEAR[step]
    h = np.full(variants.shape[:2], np.uint64(table + 1))
    for v in np.moveaxis(variants.reshape(*variants.shape[:2], -1), -1, 0):
        h = mix(h ^ v.astype(np.uint64))
    return h.view(np.int64)


def _unit(vectors: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of usable vectors of one length."""
    x = vectors.flatten().to_numpy().astype(np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(axis=1, initial=np.finfo(np.float64).tiny)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, probe, cell) of every class: the cell it owns and those it probes."""
    for batch in batches:
        width = np.diff(batch.column(1).offsets.to_numpy())
        for w in np.unique(width).tolist():
            part = batch.take(pa.array(np.flatnonzero(width == w)))
            cid = part.column(0).to_numpy()
            for a in range(0, len(cid), 2048):
                unit = _unit(part.column(1).slice(a, 2048))
                for t in range(TABLES):
                    h = mix(cells(unit, t).view(np.uint64), w).view(np.int64)
                    n = h.shape[1]
                    probe = np.tile(np.arange(n) > 0, len(unit))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid[a : a + 2048], n)), pa.array(probe), pa.array(h.reshape(-1))], names=["cid", "probe", "cell"])


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys of a sorted stream, each whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            tail, head = held[-1], batch
            if any(tail.column(k)[-1] != head.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        begin = 0
        for cut in cuts.tolist():
            held.append(batch.slice(begin, cut - begin))
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, begin = [], cut
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _linked(one: np.ndarray, two: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whether its rows and the next ones link with each of two), strip by strip."""
    for a in range(0, len(one), STRIP):
        yield a, one[a : a + STRIP] @ two.T >= cosine


def _grown(linked: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A label for each vector of a cell, by links of its own members (rows of linked) with any: places reached from each other share
    the least. Each row and column is looked at once."""
    n = linked.shape[1]
    row_of = np.full(n, -1)
    row_of[own] = np.arange(len(own))
    label, fresh = np.arange(n), np.ones(n, bool)
    for root in np.flatnonzero(linked.any(axis=0)).tolist():
        if not fresh[root]:
            continue
        fresh[root], todo = False, [root]
        while todo:
            x = todo.pop()
            near = own[linked[:, x]] if row_of[x] < 0 else np.flatnonzero(linked[row_of[x]])
            near = near[fresh[near]]
            fresh[near], label[near] = False, root
            todo += near.tolist()
    return label


def _forest(cosine: float):
    """Edges that join the vectors of a cell, or of a tile of it, which links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("cell", "t1", "t2")):
            probe = rows.column("probe").to_numpy(zero_copy_only=False)
            if len(probe) < 2 or probe.all():
                continue
            unit, cid = _unit(rows.column("embedding")), rows.column("cid").to_numpy()
            own = np.flatnonzero(~probe)
            linked = np.concatenate([x for _, x in _linked(unit[own], unit, cosine)])
            linked[np.arange(len(own)), own] = False
            if not linked.any():
                continue
            label = _grown(linked, own)
            at = np.flatnonzero(label != np.arange(len(cid)))
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[label[at]])], names=["a", "b"])

    return run


def _counted(cosine: float):
    """(cid, links) contributions of each tile of a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("comp", "t1", "t2")):
            unit, cid, weight = _unit(rows.column("embedding")), rows.column("cid").to_numpy(), rows.column("weight").to_numpy()
            block, t1, t2 = (rows.column(k).to_numpy() for k in ("block", "t1", "t2"))
            one = np.flatnonzero(block == t1)
            two = one if t1[0] == t2[0] else np.flatnonzero(block == t2)
            left, right = [], np.zeros(len(two), np.int64)
            for a, linked in _linked(unit[one], unit[two], cosine):
                if one is two:
                    linked[np.arange(len(linked)), a + np.arange(len(linked))] = False
                left.append(linked @ weight[two])
                right += weight[one[a : a + STRIP]] @ linked
            ids, n = cid[one], np.concatenate(left) if left else np.zeros(0, np.int64)
            if one is not two:
                ids, n = np.concatenate([ids, cid[two]]), np.concatenate([n, right])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["cid", "links"])

    return run


def _tiled(rows: DataFrame, key: str, n: str) -> DataFrame:
    """Rows with block, t1, t2: each pair of rows of a key is in one tile of two blocks, or of one block twice."""
    blocks = F.ceil(F.col(n) / TILE).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"t1": F.least("block", "other"), "t2": F.greatest("block", "other")}).drop("other", n)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "t1", "t2").sortWithinPartitions(key, "t1", "t2")


def near_vectors(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links (other vectors of at least that cosine), component_id (least id reachable), kept."""
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    source = df.select(F.col(id_col).alias("id"), v.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(1), v).alias("k2"))
    classes = source.where("usable").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.max("embedding").alias("embedding"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    hashed = classes.select("cid", "embedding").mapInArrow(_hashed, "cid long, probe boolean, cell long")
    met = hashed.groupBy("cell").agg(F.count("*").alias("n"), F.min("probe").alias("only_probes")).where("n > 1 and not only_probes").select("cell", "n")
    met = stored(met, "cells")
    members = _tiled(hashed.join(met, "cell"), "cell", "n")
    edges = _dealt(members.join(classes.select("cid", "embedding"), "cid"), "cell").mapInArrow(_forest(cosine), "a long, b long")
    comps = connected_components(edges)
    forget(met)
    size = stored(comps.groupBy("component").agg((F.count("*") + 1).alias("n")), "sizes")
    inside = comps.unionByName(size.select(F.col("component").alias("node"), "component")).join(size, "component")
    tiles = _tiled(inside.select(F.col("node").alias("cid"), F.col("component").alias("comp"), "n"), "comp", "n")
    counted = _dealt(tiles.join(classes.select("cid", "weight", "embedding"), "cid"), "comp").mapInArrow(_counted(cosine), "cid long, links long")
    counted = counted.groupBy("cid").agg(F.sum("links").alias("links"))
    per_class = classes.join(counted, "cid", "left").select("k1", "k2", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    named = [classes.select(F.col("cid").alias(c), F.col("rep").alias(f"{c}r")) for c in ("node", "component")]
    reps = comps.join(named[0], "node").join(named[1], "component").select(F.col("noder").alias("a"), F.col("componentr").alias("b"))
    copies = source.where("usable").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(reps.unionByName(copies))
    per_class = stored(per_class, "links")
    forget(classes, comps, size)
    good = source.where("usable").select("id", "k1", "k2").join(per_class, ["k1", "k2"]).select("id", "links")
    rows = good.unionByName(source.where("not usable").select("id", F.lit(0).cast("long").alias("links")))
    component = F.coalesce("component", "id")
    rows = rows.join(found.withColumnRenamed("node", "id"), "id", "left")
    return rows.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
