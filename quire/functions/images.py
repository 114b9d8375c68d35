"""Pictures: classification, the QOI format, scaling, and reduction for a display. PNG and JPEG are in functions.raster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from quire.functions.lazy import arrow_udf
from quire.functions.text import extension
from quire.schemas import MIN_IMAGE_SIDE

#: Types of raster pictures that are taken.
RASTER = ("image/jpeg", "image/png", "image/webp")
WHITE_FROM = 220


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_vector(mimetype: Column | str) -> Column:
    return _c(mimetype).startswith("image/svg+xml")


def is_image_entry(path: Column | str, mimetype: Column | str, is_redirect: Column | str) -> Column:
    """Whether an entry is a picture of its content rather than of the site's chrome."""
    wanted = _c(mimetype).isin(*RASTER) | is_vector(mimetype)
    return F.coalesce(~_c(is_redirect) & ~_c(path).contains("_mw_/") & wanted, F.lit(False))


def is_large_enough(mimetype: Column | str, width: Column | str, height: Column | str) -> Column:
    return is_vector(mimetype) | ((_c(width) >= MIN_IMAGE_SIDE) & (_c(height) >= MIN_IMAGE_SIDE))


def is_diagram(path: Column | str, mimetype: Column | str, colours: Column | str) -> Column:
    """Whether a picture is stored without loss: vector, PNG by name, or of 256 colours at most."""
    return is_vector(mimetype) | (extension(path) == "png") | F.coalesce(_c(colours) <= 256, F.lit(False))


def colour_count(pixels: Column | str) -> Column:
    """Distinct colours of an array of packed pixels."""
    return F.size(F.array_distinct(_c(pixels)))


def qoi_decode(data: bytes) -> np.ndarray:
    """Pixels (h, w, 4) of a QOI picture; ValueError where it is none. Pixels that are cut off repeat the last."""
    if len(data) < 22 or data[:4] != b"qoif":
        raise ValueError("not a QOI picture")
    w, h = int.from_bytes(data[4:8], "big"), int.from_bytes(data[8:12], "big")
    if not w or not h:
        raise ValueError("an empty picture")
    out, seen = np.zeros((w * h, 4), np.uint8), [(0, 0, 0, 0)] * 64
    r, g, b, a = 0, 0, 0, 255
    at, end, px = 14, len(data) - 8, 0
    while px < w * h:
        run = 1
        if at < end:
            op = data[at]
            at += 1
            if op >= 0xFE:
                n = 3 + (op & 1)
                r, g, b, a = (*data[at : at + n], a)[:4]
                at += n
            elif op < 0x40:
                r, g, b, a = seen[op]
            elif op < 0x80:
                r, g, b = (r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (b + (op & 3) - 2) & 255
            elif op < 0xC0:
                dg, more = (op & 63) - 32, data[at]
                at += 1
                r, g, b = (r + dg - 8 + (more >> 4)) & 255, (g + dg) & 255, (b + dg - 8 + (more & 15)) & 255
            else:
                run = min((op & 63) + 1, w * h - px)
            seen[(3 * r + 5 * g + 7 * b + 11 * a) & 63] = (r, g, b, a)
        else:
            run = w * h - px
        out[px : px + run] = (r, g, b, a)
        px += run
    return out.reshape(h, w, 4)


def qoi_encode(pixels: np.ndarray) -> bytes:
    """A QOI picture of (h, w, 3) pixels."""
    h, w, _ = pixels.shape
    out = bytearray(b"qoif" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x03\x00")
    seen: list = [None] * 64
    last, run = (0, 0, 0), 0
    for px in map(tuple, pixels.reshape(-1, 3).tolist()):
        if px == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        slot = (3 * px[0] + 5 * px[1] + 7 * px[2] + 11 * 255) & 63
        d = [(x - y + 128) % 256 - 128 for x, y in zip(px, last, strict=True)]
        if seen[slot] == px:
            out.append(slot)
        elif all(-2 <= x <= 1 for x in d):
            out.append(0x40 | d[0] + 2 << 4 | d[1] + 2 << 2 | d[2] + 2)
        elif -32 <= d[1] < 32 and -8 <= d[0] - d[1] < 8 and -8 <= d[2] - d[1] < 8:
            out += bytes([0x80 | d[1] + 32, d[0] - d[1] + 8 << 4 | d[2] - d[1] + 8])
        else:
            out += bytes([0xFE, *px])
        seen[slot] = last = px
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out + b"\0" * 7 + b"\1")


def reduced(pixels: np.ndarray, scale: int) -> np.ndarray:
    """RGB565 of a picture reduced by averaging scale x scale boxes; near white becomes white; columns of a cut box are left
    out, rows of one are averaged."""
    rgb = pixels[:, :, :3].astype(np.int64)
    rgb[(rgb >= WHITE_FROM).all(axis=2)] = 255
    h, w, _ = rgb.shape
    cols = w // scale
    rgb = rgb[:, : cols * scale].reshape(h, cols, scale, 3).sum(axis=2)
    rows = [rgb[y : y + scale].sum(axis=0) // (scale * min(scale, h - y)) for y in range(0, h, scale)]
    r, g, b = np.moveaxis(np.array(rows).reshape(-1, cols, 3), 2, 0)
    return (r >> 3 << 11 | g >> 2 << 5 | b >> 3).astype(np.uint16)


def on_white(pixels: np.ndarray) -> np.ndarray:
    """(h, w, 3) of pixels with transparency laid on white."""
    a = pixels[:, :, 3:].astype(np.int64)
    return ((pixels[:, :, :3] * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)


def thumbnail(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture in width x height by averaging; never enlarged."""
    h, w, _ = pixels.shape
    if w <= width and h <= height:
        return pixels
    scale = min(width / w, height / h)
    new_w, new_h = max(1, round(w * scale)), max(1, round(h * scale))
    total = np.zeros((h + 1, w + 1, pixels.shape[2]))
    total[1:, 1:] = pixels.astype(float).cumsum(0).cumsum(1)
    y, x = np.arange(new_h + 1) * h // new_h, np.arange(new_w + 1) * w // new_w
    box = total[np.ix_(y, x)]
    sums = box[1:, 1:] - box[:-1, 1:] - box[1:, :-1] + box[:-1, :-1]
    return np.rint(sums / (np.diff(y)[:, None, None] * np.diff(x)[None, :, None])).astype(np.uint8)


@arrow_udf("w int, h int, rgb565 binary")
def decoded(data: pd.Series, scale: pd.Series) -> pd.DataFrame:
    """Column function: QOI bytes and a scale to little-endian RGB565 rows; nulls for what is none."""
    rows = []
    for d, s in zip(data, scale, strict=True):
        try:
            px = reduced(qoi_decode(bytes(d)), max(1, int(s)))
            rows.append((px.shape[1], px.shape[0], px.astype("<u2").tobytes()))
        except (ValueError, TypeError, IndexError):
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["w", "h", "rgb565"]).astype({"w": "Int32", "h": "Int32"})


@arrow_udf("binary")
def stored(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Column function: raw RGB bytes of width x height to QOI."""
    shape = lambda p, w, h: np.frombuffer(bytes(p), np.uint8).reshape(int(h), int(w), 3)
    return pd.Series([None if p is None else qoi_encode(shape(p, w, h)) for p, w, h in zip(pixels, width, height, strict=True)], dtype=object)
