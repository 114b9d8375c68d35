"""The screens of the device as a state machine driven by gestures: search with its keyboard, articles, pictures."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from quire.functions.geometry import BACKSPACE, CLEAR, CONTENT_HEIGHT, DIGITS, GO, KEY_WIDTH, LETTERS, NUM, ROW_STRIDE, ROWS, SHIFT, SHIFTED_DIGITS, SYMBOLS
from quire.schemas import HISTORY_CAP, NAV_HEIGHT, SCREEN_HEIGHT, SCREEN_WIDTH
from quire.streaming.folds import folded

#: Geometry of the screens.
KEYBOARD_TOP = SCREEN_HEIGHT - ROWS * ROW_STRIDE
BUTTON_WIDTH, BUTTONS, BACK_WIDTH = 24, 4, 80
BUTTONS_LEFT = SCREEN_WIDTH - BUTTON_WIDTH * BUTTONS
INPUT_HEIGHT, RESULT_HEIGHT, OVERLAP = 28, 18, 20

OUT = "session string, seq long, screen string, query string, action string, article_id long, img_id long, scroll int, depth int"


@dataclass(frozen=True)
class Screen:
    """What the device remembers. results is the number of rows that the last search listed."""

    name: str = "SEARCH"
    query: str = ""
    keyboard: bool = False
    shift: bool = False
    num: bool = False
    results: int = 0
    listed: int = 0
    article: int | None = None
    scroll: int = 0
    picture: int | None = None
    history: tuple[int, ...] = ()


def key_under(s: Screen, x: int, y: int) -> tuple[str, Screen]:
    """The key at a place of the keyboard ("" for none) and the screen after it: shift and numbers toggle, a letter of the second or
    third row lets shift go."""
    row, column = (y - KEYBOARD_TOP) // ROW_STRIDE, int((x - (0, 16, 48, 0)[min(3, max(0, (y - KEYBOARD_TOP) // ROW_STRIDE))]) / KEY_WIDTH)
    if not 0 <= row < ROWS:
        return "", s
    if row == 3:
        key = NUM if x < 32 else " " if x < 176 else CLEAR if x < 224 else GO
        return key, replace(s, num=not s.num) if key == NUM else s
    if row == 2 and x < 48:
        return SHIFT, replace(s, shift=not s.shift)
    if row == 2 and x >= 272:
        return BACKSPACE, s
    letters = LETTERS[row]
    if not 0 <= column < len(letters):
        return "", s
    if s.num:
        return ((SHIFTED_DIGITS if s.shift else DIGITS) if row == 0 else SYMBOLS[row - 1])[column], s
    key = letters[column] if s.shift else letters[column].lower()
    return key, s if row == 0 else replace(s, shift=False)


def _scrolled(now: int, button: int, step: int, most: int) -> int:
    return max(0, min(most, (now - step, now + step, 0, most)[button]))


def _search(s: Screen, kind: str, x: int, y: int, dy: int, found: int, result: int | None, exact: int | None) -> tuple[Screen, str]:
    top = NAV_HEIGHT + INPUT_HEIGHT if s.keyboard else NAV_HEIGHT
    visible = ((KEYBOARD_TOP if s.keyboard else SCREEN_HEIGHT) - top) // RESULT_HEIGHT
    most = max(0, s.results - visible)
    if kind.startswith("SWIPE"):
        rows = max(1, abs(dy) // RESULT_HEIGHT)
        return replace(s, listed=max(0, min(most, s.listed + (rows if dy < 0 else -rows)))), "scroll" if s.results else ""
    if kind == "HOLD":
        if s.keyboard and y >= KEYBOARD_TOP and key_under(s, x, y)[0] == BACKSPACE:
            return replace(s, query=s.query[:-1]), "type"
        return s, ""
    if kind != "TAP":
        return s, ""
    if y < NAV_HEIGHT:
        if x >= BUTTONS_LEFT and s.results:
            return replace(s, listed=_scrolled(s.listed, (x - BUTTONS_LEFT) // BUTTON_WIDTH, visible, most)), "scroll"
        return s, ""
    if s.keyboard and y >= KEYBOARD_TOP:
        key, s = key_under(s, x, y)
        if key == GO:
            if exact is not None:
                return replace(s, keyboard=False, results=found, listed=0, name="ARTICLE", article=exact, scroll=0, history=()), "open"
            return replace(s, keyboard=False, results=found, listed=0), "search"
        if key in (SHIFT, NUM, ""):
            return s, ""
        return replace(s, query="" if key == CLEAR else s.query[:-1] if key == BACKSPACE else s.query + key), "type"
    if y < NAV_HEIGHT + INPUT_HEIGHT:
        return replace(s, keyboard=True), "" if s.keyboard else "keyboard"
    row = s.listed + (y - top) // RESULT_HEIGHT
    if y >= top and row < s.results and result is not None:
        return replace(s, keyboard=False, name="ARTICLE", article=result, scroll=0, history=()), "open"
    return s, ""


def _article(s: Screen, kind: str, x: int, y: int, dy: int, height: int, img: int | None, link: int | None) -> tuple[Screen, str]:
    most = max(0, height - CONTENT_HEIGHT)
    if kind.startswith("SWIPE"):
        return replace(s, scroll=max(0, min(most, s.scroll - dy))), "scroll"
    if kind != "TAP":
        return s, ""
    if y < NAV_HEIGHT:
        if x >= BUTTONS_LEFT:
            return replace(s, scroll=_scrolled(s.scroll, (x - BUTTONS_LEFT) // BUTTON_WIDTH, CONTENT_HEIGHT - OVERLAP, most)), "scroll"
        if x >= BACK_WIDTH:
            return s, ""
        if s.history:
            return replace(s, article=s.history[-1], scroll=0, history=s.history[:-1]), "back"
        return replace(s, name="SEARCH"), "back"
    if img is not None:
        return replace(s, name="IMAGE", picture=img), "picture"
    if link is not None:
        return replace(s, article=link, scroll=0, history=(*s.history, s.article)[-HISTORY_CAP:]), "follow"
    return s, ""


def step(s: Screen, seq: int, kind: str, x: int, y: int, dy: int, found: int | None, result_id: int | None, exact_id: int | None, height: int | None, img_id: int | None, link_id: int | None) -> tuple[Screen, tuple | None]:
    """The screen after a gesture, and a row on it. Of what lies behind the screen a gesture brings along: the number of rows that the
    query finds and the article it names exactly, the result under the finger, the article's height, the picture and link hit."""
    action = ""
    if s.name == "SEARCH":
        s, action = _search(s, kind, x, y, dy, found or 0, result_id, exact_id)
    elif s.name == "ARTICLE":
        s, action = _article(s, kind, x, y, dy, height or 0, img_id, link_id)
    elif kind == "TAP":
        s, action = replace(s, name="ARTICLE", picture=None), "close"
    return s, (seq, s.name, s.query, action, s.article, s.picture, s.listed if s.name == "SEARCH" else s.scroll, len(s.history))


def screens(gestures: DataFrame) -> DataFrame:
    """A row after each gesture (session, seq, type, x, y, dy, found, result_id, exact_id, height, img_id, link_id)."""
    columns = ["seq", "type", "x", "y", "dy", "found", "result_id", "exact_id", "height", "img_id", "link_id"]
    return folded(gestures.where("seq is not null").select("session", *columns), "session", columns, Screen(), step, OUT)
