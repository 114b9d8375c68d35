"""Gestures from touch samples: one state machine for each device, in batch and in streams.

A press within 60 ms of the one before is not taken. While a finger moves less than 15 px in all, it is held: after 500 ms, and every 100 ms
from then on. On release nothing follows a hold; 25 px or more up or down are a swipe; else it is a tap if it ended within 40 px and 500 ms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.schemas import TOUCH_EVENTS
from quire.streaming.folds import folded
from quire.streaming.ordered import folded_in_order

DEBOUNCE_MS, HOLD_MS, REPEAT_MS, STILL, SWIPE, NEAR, QUICK_MS = 60, 500, 100, 15, 25, 40, 500
STATE = "pressed boolean, start_x int, start_y int, last_x int, last_y int, press_ms long, moved int, next_hold long"
IDLE = (False, 0, 0, 0, 0, -1, 0, -1)


def step(state: tuple, ms: int, pressed: bool, x: int, y: int) -> tuple[tuple, tuple[str, int, int, int] | None]:
    """(state after a sample, gesture or None). A gesture: type, x, y, dy."""
    down, x0, y0, x1, y1, since, moved, hold = state
    if pressed and not down:
        return (state, None) if since >= 0 and ms - since < DEBOUNCE_MS else ((True, x, y, x, y, ms, 0, -1), None)
    if pressed:
        moved += y - y1
        event = None
        if abs(moved) < STILL and (ms >= hold if hold >= 0 else ms - since >= HOLD_MS):
            hold, event = ms + REPEAT_MS, ("HOLD", x0, y0, 0)
        return (True, x0, y0, x, y, since, moved, hold), event
    if not down:
        return state, None
    event = None
    if hold < 0:
        if abs(moved) >= SWIPE:
            event = ("SWIPE_UP" if moved < 0 else "SWIPE_DOWN", 0, 0, moved)
        elif int(math.hypot(x1 - x0, y1 - y0)) < NEAR and ms - since < QUICK_MS:
            event = ("TAP", x0, y0, 0)
    return (False, x0, y0, x1, y1, since, moved, hold), event


def _gesture(state: tuple, ms: int, pressed: bool, x: int | None, y: int | None) -> tuple[tuple, tuple | None]:
    state, event = step(state, ms, pressed, x or 0, y or 0)
    return state, event and (ms, *event)


def gestures(samples: DataFrame) -> DataFrame:
    """Gestures of a table of samples (device, ts_ms, pressed, x, y); samples without a time are left out, a missing place is 0.
    Samples of one time are taken in the order of their other columns."""
    rows = samples.where("ts_ms is not null and pressed is not null").select("device", "ts_ms", "pressed", "x", "y")
    return folded(rows, "device", ["ts_ms", "pressed", "x", "y"], IDLE, _gesture, TOUCH_EVENTS)


def stream_gestures(samples: DataFrame, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """The same for a stream. With a delay, samples may come in any order as long as none comes later than that: they wait for the
    watermark. Without one, samples of a device come in time order. With idle_ms, the state of a device goes when nothing came for so
    long."""
    if delay:
        columns = {"ts_ms": "long", "pressed": "boolean", "x": "int", "y": "int"}
        return folded_in_order(samples.where("pressed is not null"), "device", "ts_ms", columns, delay, IDLE, STATE, _gesture, TOUCH_EVENTS, idle_ms)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, out = tuple(state.get) if state.exists else IDLE, []
        for ms, pressed, x, y in pd.concat(list(batches)).sort_values(["ts_ms", "pressed", "x", "y"])[["ts_ms", "pressed", "x", "y"]].itertuples(index=False):
            now, event = _gesture(now, int(ms), bool(pressed), 0 if pd.isna(x) else int(x), 0 if pd.isna(y) else int(y))
            if event:
                out.append((key[0], *event))
        state.update(now)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["device", "ts_ms", "type", "x", "y", "dy"])

    rows = samples.where("ts_ms is not null and pressed is not null")
    return rows.groupBy("device").applyInPandasWithState(run, TOUCH_EVENTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
