"""Sessions of a reader: history, pages, and the screens between which gestures lead."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.schemas import HISTORY_CAP
from quire.streaming.folds import folded
from quire.streaming.ordered import folded_in_order

OUT = "session string, seq long, action string, screen string, article_id long, page int, depth int"
STATE = "screen string, article_id long, page int, history array<long>"
START = ("SEARCH", -1, 0, [])


def step(state: tuple, action: str, target: int | None) -> tuple:
    """(screen, article, page, history) after an action.

    search: a new search drops the history; open: from a result; follow: a link, which keeps where it came from, the oldest of HISTORY_CAP
    going; back: the article before (and it is that article from then on), or the search; next and previous page;
    image and tap: a picture and back from it. Actions that do not fit the screen change nothing.
    """
    screen, article, page, history = state
    if action == "search":
        return "SEARCH", -1, 0, []
    if action == "open" and screen == "SEARCH" and target is not None:
        return "ARTICLE", target, 0, []
    if screen == "IMAGE":
        return ("ARTICLE", article, page, history) if action == "tap" else state
    if screen != "ARTICLE":
        return state
    if action == "follow" and target is not None:
        return "ARTICLE", target, 0, [*history, article][-HISTORY_CAP:]
    if action == "back":
        return ("ARTICLE", history[-1], 0, history[:-1]) if history else START
    if action == "next":
        return screen, article, page + 1, history
    if action == "previous":
        return screen, article, max(0, page - 1), history
    return ("IMAGE", article, page, history) if action == "image" else state


def _action(state: tuple, seq: int, action: str, target: int | None) -> tuple[tuple, tuple]:
    state = step(state, action, target)
    return state, (seq, action, state[0], None if state[1] < 0 else state[1], state[2], len(state[3]))


def sessions(actions: DataFrame) -> DataFrame:
    """State after each action (session, seq, action, article_id) of a table. Actions of one seq are taken in the order of their
    other columns; those without a seq are left out."""
    rows = actions.where("seq is not null").select("session", "seq", "action", "article_id")
    return folded(rows, "session", ["seq", "action", "article_id"], START, _action, OUT)


def _timed_action(state: tuple, ms: int, seq: int, action: str, target: int | None) -> tuple[tuple, tuple]:
    return _action((*state[:3], list(state[3])), seq, action, target)


def stream_sessions(actions: DataFrame, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """The same for a stream. With a delay, actions have a time, ts_ms, and may come in any order as long as none comes later than that;
    those of one time are taken by seq. Without one, actions of a session come in order. With idle_ms, the state of a session goes when
    nothing came for so long."""
    if delay:
        columns = {"ts_ms": "long", "seq": "long", "action": "string", "article_id": "long"}
        return folded_in_order(actions.where("seq is not null"), "session", "ts_ms", columns, delay, START, STATE, _timed_action, OUT, idle_ms)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, out = (*state.get[:3], list(state.get[3])) if state.exists else START, []
        rows = pd.concat(list(batches)).sort_values(["seq", "action", "article_id"], na_position="first")
        for seq, action, target in rows[["seq", "action", "article_id"]].itertuples(index=False):
            now, made = _action(now, int(seq), action, None if pd.isna(target) else int(target))
            out.append((key[0], *made))
        state.update(now)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        made = pd.DataFrame(out, columns=["session", "seq", "action", "screen", "article_id", "page", "depth"])
        yield made.astype({"article_id": "Int64"})

    return actions.where("seq is not null").groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
