"""Layout, scrolling and touch arithmetic as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quire.schemas import NAV_HEIGHT, SCREEN_HEIGHT, SCREEN_WIDTH

CONTENT_HEIGHT = SCREEN_HEIGHT - NAV_HEIGHT
KEY_WIDTH, ROW_STRIDE, ROWS = 32, 36, 4
SHIFT, NUM, CLEAR, BACKSPACE, GO = "\x01", "\x02", "\x03", "\b", "\r"
#: Keys of the keyboard's rows; fixed values.
LETTERS = ("QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM")
DIGITS, SHIFTED_DIGITS, SYMBOLS = "1234567890", "!@#$%^&*()", ("-/:;()$&@", "!'\"`,.?")


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x


def quotient(a: Column, b: Column | int) -> Column:
    """Whole-number quotient, cut towards zero."""
    return F.try_divide(a, _c(b)).cast("long")


def scroll_limit(total: Column | str) -> Column:
    return F.greatest(_c(total) - CONTENT_HEIGHT, F.lit(0))


def scroll_clamp(scroll: Column | str, total: Column | str) -> Column:
    return F.least(F.greatest(_c(scroll), F.lit(0)), scroll_limit(total))


def thumb_height(total: Column | str) -> Column:
    """Height of a scroll bar's thumb; null where all fits."""
    return F.when(_c(total) > CONTENT_HEIGHT, F.greatest(F.lit(16).cast("long"), quotient(F.lit(CONTENT_HEIGHT * CONTENT_HEIGHT), _c(total))))


def thumb_top(scroll: Column | str, total: Column | str) -> Column:
    return NAV_HEIGHT + quotient(_c(scroll) * (CONTENT_HEIGHT - thumb_height(total)), _c(total) - CONTENT_HEIGHT)


def line_visible(y: Column | str, line: Column | str | int, scroll: Column | str, height: Column | int = CONTENT_HEIGHT) -> Column:
    """Whether a line at y of the content overlaps the view."""
    top = _c(y) - _c(scroll)
    return (top + _c(line) > 0) & (top < _c(height))


def line_drawn(y: Column | str, line: Column | str | int, scroll: Column | str) -> Column:
    """Whether it is drawn: visible, and not begun above the view."""
    return line_visible(y, line, scroll) & (_c(y) - _c(scroll) >= 0)


def thumbnail_height(height: Column | str) -> Column:
    """Height at which an inline picture shows: half, 60 where unknown, within 8..120."""
    h = _c(height)
    return F.least(F.greatest(F.when(h > 0, F.shiftright(h.cast("int"), 1)).otherwise(60), F.lit(8)), F.lit(120))


def decode_scale(stored: Column | str, thumb: Column | str) -> Column:
    """Power of two from 2 to 8 by which a lossless picture is reduced, until it fits the thumbnail's height."""
    s, t = _c(stored), _c(thumb)
    return F.when((t <= 0) | (quotient(s, 2) <= t), 2).when(quotient(s, 4) <= t, 4).otherwise(8)


def centred(size: Column | str, room: int, offset: int = 0) -> Column:
    """Start of what is centred in a room; offset where it does not fit."""
    return F.lit(offset) + F.when(_c(size) < room, quotient(F.lit(room) - _c(size), 2)).otherwise(0)


def fitted(width: Column | str, height: Column | str, box_w: int, box_h: int) -> tuple[Column, Column]:
    """Size of a picture made to fit a box, its shape kept, never enlarged; sides of at least 1."""
    w, h = _c(width), _c(height)
    inside = (w <= box_w) & (h <= box_h)
    wide = w * box_h >= h * box_w  # the width decides
    new_w = F.when(wide, F.lit(box_w)).otherwise(F.greatest(F.lit(1), F.floor(w * box_h / h + 0.5)))
    new_h = F.when(wide, F.greatest(F.lit(1), F.floor(h * box_w / w + 0.5))).otherwise(F.lit(box_h))
    return F.when(inside, w).otherwise(new_w).cast("int"), F.when(inside, h).otherwise(new_h).cast("int")


def rgb565(r: Column | str, g: Column | str, b: Column | str) -> Column:
    r, g, b = _c(r), _c(g), _c(b)
    high = F.shiftleft(F.shiftright(r, 3), 11)
    return high.bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3))


def calibrated(raw1: Column, raw2: Column, target1: int, target2: int, at: int) -> Column:
    """Raw reading that two calibration points give for a screen coordinate, by linear extrapolation."""
    return raw1 + quotient((raw2 - raw1) * (at - target1), target2 - target1)


def touch_to_screen(raw: Column | str, low: Column | int, high: Column | int, last: int) -> Column:
    """A raw reading in screen coordinates, kept within 0..last."""
    at = quotient((_c(raw) - _c(low)) * last, _c(high) - _c(low))
    return F.least(F.greatest(at, F.lit(0)), F.lit(last))


def key_at(x: Column | str, y: Column | str, top: Column | int, shift: Column, num: Column) -> Column:
    """The key under a touch; null outside. Rows: letters or digits; letters or symbols; shift, letters, delete; controls."""
    x, y, dy = _c(x), _c(y), _c(y) - _c(top)
    row = F.floor(dy / ROW_STRIDE)
    pick = lambda chars, col: F.substring(F.lit(chars), col + 1, F.lit(1))
    letter = lambda chars, col: F.when(shift, pick(chars, col)).otherwise(pick(chars.lower(), col))
    col0, col1, col2 = (quotient(x - a, KEY_WIDTH).cast("int") for a in (0, 16, 48))
    within = lambda col, n: (col >= 0) & (col < n)
    first = F.when(within(col0, 10), F.when(num & shift, pick(SHIFTED_DIGITS, col0)).when(num, pick(DIGITS, col0)).otherwise(letter(LETTERS[0], col0)))
    second = F.when(within(col1, 9), F.when(num, pick(SYMBOLS[0], col1)).otherwise(letter(LETTERS[1], col1)))
    third = F.when(x < 48, SHIFT).when(x >= 272, BACKSPACE).when(within(col2, 7), F.when(num, pick(SYMBOLS[1], col2)).otherwise(letter(LETTERS[2], col2)))
    fourth = F.when(x < 32, NUM).when(x < 176, " ").when(x < 224, CLEAR).otherwise(GO)
    inside = (dy >= 0) & (dy < ROWS * ROW_STRIDE)
    return F.when(inside, reduce(lambda a, kv: a.when(row == kv[0], kv[1]), [(1, second), (2, third), (3, fourth)], F.when(row == 0, first)))


def shift_after(key: Column, row: Column, shift: Column, num: Column) -> Column:
    """Shift after a key: toggled by shift itself, let go by a letter of the second or third row."""
    return F.when(key == SHIFT, ~shift).when(row.isin(1, 2) & ~num & key.rlike("^[A-Za-z]$"), F.lit(False)).otherwise(shift)


def inside(x: Column | str, y: Column | str, left: Column | str, top: Column | str, width: Column | str, height: Column | str) -> Column:
    return (_c(x) >= _c(left)) & (_c(x) < _c(left) + _c(width)) & (_c(y) >= _c(top)) & (_c(y) < _c(top) + _c(height))


SCREEN = (SCREEN_WIDTH, SCREEN_HEIGHT)
