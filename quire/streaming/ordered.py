"""Streams whose rows come in any order, worked on in the order of their own time.

Rows wait in the state of their key until the watermark has passed them; a timer wakes the key when the next ones are due.  So whatever
the micro-batches, the result is that of the batch.  Rows that come when the watermark has passed them are left out: by Spark, which
counts them in the progress of the query (numRowsDroppedByWatermark), or, in the batch right after, by the key's own state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


_KINDS = {"long": int, "int": int, "boolean": bool, "string": str}


def _whole(row: tuple, kinds: list) -> tuple:
    """Values of a row as they were: batches and arrays with nulls give numbers as floats, and nulls as NaN."""
    return tuple(None if pd.isna(x) else kind(x) for x, kind in zip(row, kinds, strict=True))


def _pending(state: GroupState, width: int) -> tuple[list, list[tuple]]:
    """(what the state holds besides, the rows that wait in it)."""
    if not state.exists:
        return [], []
    held = list(state.get)
    return held[:-width], list(zip(*held[-width:], strict=True))


def folded_in_order(rows: DataFrame, key: str, time_ms: str, values: dict[str, str], delay: str, start: tuple, kinds: str, step: Callable[..., tuple[tuple, tuple | None]], schema: str, idle_ms: int | None = None) -> DataFrame:
    """What step(state, *values) gives besides the next state, for each row of a stream by key in the order of values.

    values are names and types (long, int, boolean, string) of columns, the first of them time_ms (milliseconds); kinds are the types of the state, as a schema.
    With idle_ms, the state of a key goes when the watermark is so long behind its last row.
    """
    names, types = list(values), [_KINDS[t] for t in values.values()]
    wait = ", ".join(f"wait_{c} array<{t}>" for c, t in values.items())
    out_names = [f.split()[0] for f in schema.split(", ")]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = _pending(state, len(names))
        waiting = [_whole(r, types) for r in waiting]
        now, last, upto = (tuple(held[:-2]), *held[-2:]) if held else (start, -1, -1)
        for batch in batches:
            new = (_whole(r, types) for r in batch[names].itertuples(index=False))
            waiting += [r for r in new if r[0] >= upto]  # the others have missed their turn
        mark, out = state.getCurrentWatermarkMs(), []
        ready = sorted((r for r in waiting if r[0] < mark), key=lambda r: tuple((x is not None, x) for x in r))
        waiting = [r for r in waiting if r[0] >= mark]
        for row in ready:
            now, made = step(now, *row)
            last = int(row[0])
            if made is not None:
                out.append((keys[0], *made))
        if not waiting and idle_ms and mark > last + idle_ms:
            state.remove()
        else:
            columns = zip(*waiting, strict=True) if waiting else ([] for _ in names)
            state.update((*now, last, max(mark, upto), *(list(c) for c in columns)))
            due = int(min(r[0] for r in waiting)) + 1 if waiting else last + idle_ms + 1 if idle_ms else 0
            if due:
                state.setTimeoutTimestamp(max(due, mark + 1))
        yield pd.DataFrame(out, columns=out_names, dtype=object)

    timed = rows.where(F.col(time_ms).isNotNull()).withColumn("__time", F.timestamp_millis(F.col(time_ms).cast("long"))).withWatermark("__time", delay)
    typed = timed.select(key, "__time", *[F.col(c).cast(t).alias(c) for c, t in values.items()])
    return typed.groupBy(key).applyInPandasWithState(run, schema, f"{kinds}, last_ms long, upto_ms long, {wait}", "append", GroupStateTimeout.EventTimeTimeout)


def stream_first_of_each(results: DataFrame, key: str, order: str, time_ms: str, within_ms: int, delay: str) -> DataFrame:
    """Of a stream of results, for each key the one of least order (ties by the other columns, as JSON), once.

    All results of a key come within within_ms of its first one; when the watermark is past that, the first is told and the key forgotten.
    """
    rest = [c for c in results.columns if c != key]
    body = ", ".join(f"`{c}` {results.schema[c].dataType.simpleString()}" for c in rest)
    kind = results.schema[key].dataType.simpleString()

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, since = (tuple(state.get[:2]), state.get[2]) if state.exists else (None, None)
        for batch in batches:
            for o, row, ms in batch[["__order", "__row", "__ms"]].itertuples(index=False):
                best = (int(o), row) if best is None else min(best, (int(o), row))
                since = int(ms) if since is None else min(since, int(ms))
        mark = state.getCurrentWatermarkMs()
        if best is None:
            return
        if mark > since + within_ms:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(keys[0], best[1])], columns=["key", "row"])
        else:
            state.update((*best, since))
            state.setTimeoutTimestamp(max(since + within_ms + 1, mark + 1))

    rows = results.where(F.col(time_ms).isNotNull() & F.col(order).isNotNull()).select(
        F.col(key).alias("key"), F.timestamp_millis(F.col(time_ms).cast("long")).alias("__time"), F.col(time_ms).cast("long").alias("__ms"),
        F.col(order).cast("long").alias("__order"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__row"),
    )
    timed = rows.withWatermark("__time", delay).groupBy("key")
    made = timed.applyInPandasWithState(run, f"key {kind}, row string", "best long, row string, since long", "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(F.col("key").alias(key), F.from_json("row", body).alias("r")).select(key, *[F.col(f"r.`{c}`").alias(c) for c in rest])
