"""State machines over the rows of each key in order, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def folded(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable[..., tuple[tuple, tuple | None]], schema: str) -> DataFrame:
    """What step(state, *values) gives besides the next state, of each row in order; state begins at start for every key.

    The columns behind key are the values, and order (some of them) should tell a key's rows apart. Keys are dealt out and sorted by
    Spark, which spills; a task holds one state and one batch, however long a key's history is.
    """
    fields = [x.split() for x in schema.split(", ")]
    names, kinds = [f[0] for f in fields], [_KINDS[f[1]] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, start, False
        for batch in batches:
            out: list[tuple] = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or k != now:
                    now, state, begun = k, start, True
                state, made = step(state, *values)
                if made is not None:
                    out.append((k, *made))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
