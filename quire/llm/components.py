"""Connected components of distributed edges.

Tasks first shrink their own edges to forests.  A graph that then has at most LEFT edges, a bound on one task's memory, is finished
in a single task; a larger one goes through alternating large-star and small-star steps until it is small enough or
nothing changes.  Both ways give the same exact components.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.tables import forget, stored

LEFT = 200_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges become at most as many edges (node, least node that it reaches among them), LEFT nodes or so at a time."""
    root: dict = {}
    schema = None

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def out():
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], schema.field(k).type) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > 2 * LEFT:
            yield out()
            root.clear()
    if root:
        yield out()


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step. A node's edges are never gathered: they are minima and joins, so hot nodes can be split."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    below = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(below.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node but the least of each component, of edges (a, b) of any orderable type; component is the
    least node reachable. Nulls and loops are left out. Each step is written and read again, and the one before it deleted; the last is
a stored table, which forget() deletes."""
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    now = stored(edges.select("a", "b").where("a <> b").mapInArrow(_forests, schema), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if found["n"] <= LEFT:
            after = stored(now.coalesce(1).mapInArrow(_forests, schema), "edges")
        elif (found["n"], found["h"]) == mark:
            after = None
        else:
            mark = (found["n"], found["h"])
            after = stored(_stars(now), "edges")
        if after is not None:
            forget(now)
            now = after
        if after is None or found["n"] <= LEFT:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out.stored_path = now.stored_path
            return out
