"""Raster pictures: PNG and baseline JPEG to pixels and back, in numpy, after the published standards (RFC 2083, ITU-T T.81).

Pixels are uint8 arrays (h, w, 4) when read, (h, w, 3) when written. What is broken or of an unsupported kind raises ValueError.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa

from quire.functions.images import on_white, qoi_decode, qoi_encode, thumbnail
from quire.functions.lazy import arrow_udf

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def pixels_of(data: bytes) -> np.ndarray:
    """Pixels of a QOI, PNG or JPEG picture."""
    try:
        if data[:4] == b"qoif":
            return qoi_decode(data)
        if data[:8] == PNG_MAGIC:
            return png_decode(data)
        if data[:2] == b"\xff\xd8":
            return jpeg_decode(data)
    except (IndexError, KeyError, struct.error, zlib.error) as broken:
        raise ValueError("a broken picture") from broken
    raise ValueError("no picture")


# PNG


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(pixels: np.ndarray) -> bytes:
    """A PNG picture of (h, w, 3) pixels."""
    h, w, _ = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, 3 * w)], axis=1)
    return PNG_MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    out = np.zeros((h + 1, stride + step), np.uint8)  # a row and a pixel of zeros lie before
    for y, (kind, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:], strict=True), 1):
        up, now = out[y - 1], out[y]
        if kind == 0:
            now[step:] = line
        elif kind == 1:
            lanes = np.resize(np.concatenate([line, np.zeros(-stride % step, np.uint8)]), (-(-stride // step), step))
            now[step:] = np.cumsum(lanes, axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            now[step:] = line + up[step:]
        elif kind in (3, 4):
            a, b, x = now.tolist(), up.tolist(), line.tolist()
            for k in range(stride):
                left, above, corner = a[k], b[k + step], b[k]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    near = left + above - corner
                    guess = min((left, above, corner), key=lambda v: abs(near - v))
                a[k + step] = (x[k] + guess) & 255
            now[:] = a
        else:
            raise ValueError("an unknown PNG filter")
    return out[1:, step:]


def png_decode(data: bytes) -> np.ndarray:
    """Pixels of a PNG picture that is not interlaced, of at most 8 bits a sample."""
    at, parts, palette, alpha = 8, [], None, None
    w = h = depth = kind = laced = 0
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = body
        elif name == b"IDAT":
            parts.append(body)
        elif name == b"IEND":
            break
    lanes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if not w or not h or lanes is None or laced or depth > 8 or (kind == 3 and palette is None):
        raise ValueError("an unsupported PNG picture")
    stride = -(-w * lanes * depth // 8)
    raw = zlib.decompressobj().decompress(b"".join(parts), h * (stride + 1))
    if len(raw) < h * (stride + 1):
        raise ValueError("a PNG picture is cut off")
    rows = _unfiltered(raw, h, stride, max(1, lanes * depth // 8))
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :w]
        if kind == 0:
            rows = rows * (255 // ((1 << depth) - 1))
    px = rows.reshape(h, w, lanes)
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        see = np.full(len(palette), 255, np.uint8)
        if alpha:
            see[: len(alpha)] = np.frombuffer(alpha, np.uint8)[: len(see)]
        out[:, :, :3], out[:, :, 3] = palette[px[:, :, 0]], see[px[:, :, 0]]
        return out
    out[:, :, :3] = px[:, :, : 3 if lanes > 2 else 1]
    if lanes in (2, 4):
        out[:, :, 3] = px[:, :, -1]
    elif alpha:
        clear = np.frombuffer(alpha, ">u2")[:lanes]
        out[:, :, 3][(px == clear).all(axis=2)] = 0
    return out


# JPEG

#: Fixed values of ITU-T T.81, annex K: quantisation of brightness and of colour, by rows.
BRIGHT = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Places of an 8 x 8 block in diagonal order, every other diagonal upwards.
DIAGONAL = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8))))
_WAVES = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos((2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] * np.pi / 16)
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """The two tables for a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (BRIGHT, COLOUR))


def _code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of prefix codes of 16 bits at most, none of which is all ones."""
    weights = counts | {256: 0}  # takes the code that is all ones
    while True:
        heap = [(n, -s, (s,)) for s, n in weights.items()]
        heapq.heapify(heap)
        length = dict.fromkeys(weights, 0)
        while len(heap) > 1:
            (n, _, a), (m, tie, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in a + b:
                length[s] += 1
            heapq.heappush(heap, (n + m, tie, a + b))
        longest = max(length.values())
        if longest <= 16:
            other = next(s for s in sorted(length) if length[s] == longest)
            length[256], length[other] = longest, length[256]
            return {s: max(1, n) for s, n in length.items()}
        weights = {s: (n >> 1) | 1 if s < 256 else 0 for s, n in weights.items()}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, bits) by symbol, in canonical order."""
    out, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    return out


def _symbols(blocks: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Of quantised blocks in diagonal order: (symbol, extra bits, their number) of first coefficients, and for each block the others."""

    def sized(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    first, rest, before = [], [], 0
    for block in blocks.tolist():
        n, bits = sized(block[0] - before)
        before = block[0]
        first.append((n, bits, n))
        own, zeros = [], 0
        last = max((k for k in range(1, 64) if block[k]), default=0)
        for v in block[1 : last + 1]:
            if not v:
                zeros += 1
                continue
            own += [(0xF0, 0, 0)] * (zeros // 16)
            n, bits = sized(v)
            own.append((zeros % 16 << 4 | n, bits, n))
            zeros = 0
        rest.append(own + [(0, 0, 0)] * (last < 63))
    return first, rest


def jpeg_encode(pixels: np.ndarray, quality: int = 90) -> bytes:
    """A baseline JPEG picture of (h, w, 3) pixels, colours at full resolution, with code tables of its own."""
    h, w, _ = pixels.shape
    whole = np.pad(pixels, ((0, -h % 8), (0, -w % 8), (0, 0)), "edge").astype(float)
    planes = np.moveaxis(whole @ _TO_YCC.T, 2, 0) - np.array([128, 0, 0])[:, None, None]
    tables, coded = quantisers(quality), []
    for k, plane in enumerate(planes):
        cells = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        waves = (_WAVES @ cells @ _WAVES.T).reshape(-1, 64) / tables[k > 0]
        coded.append(_symbols(np.rint(waves[:, DIAGONAL]).astype(int)))
    head = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    head += [_segment(0xDB, bytes([k]) + bytes(t[DIAGONAL].tolist())) for k, t in enumerate(tables)]
    head.append(_segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([k + 1, 0x11, k > 0]) for k in range(3))))
    codes = {}
    for table, own in ((0, coded[:1]), (1, coded[1:])):
        for kind, found in ((0, [x for first, _ in own for x in first]), (1, [x for _, rest in own for b in rest for x in b])):
            counts: dict[int, int] = {}
            for s, _, _ in found:
                counts[s] = counts.get(s, 0) + 1
            lengths = _code_lengths(counts)
            codes[kind, table] = _codes(lengths)
            known = sorted((n, s) for s, n in lengths.items() if s < 256)
            sizes = bytes(sum(n == k for n, _ in known) for k in range(1, 17))
            head.append(_segment(0xC4, bytes([kind << 4 | table]) + sizes + bytes(s for _, s in known)))
    head.append(_segment(0xDA, b"\3\1\0\2\x11\3\x11\0\x3f\0"))
    out, held, n = bytearray(), 0, 0
    for k in range(len(coded[0][0])):
        for c, (first, rest) in enumerate(coded):
            for kind, found in ((0, [first[k]]), (1, rest[k])):
                code = codes[kind, int(c > 0)]
                for s, bits, size in found:
                    word, length = code[s]
                    held, n = held << (length + size) | word << size | bits, n + length + size
            while n >= 8:
                n -= 8
                byte = held >> n
                held &= (1 << n) - 1
                out += b"\xff\0" if byte == 0xFF else bytes([byte])
    if n:
        byte = held << (8 - n) | (1 << (8 - n)) - 1
        out += b"\xff\0" if byte == 0xFF else bytes([byte])
    return b"".join([*head, bytes(out), b"\xff\xd9"])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@dataclass
class _Plane:
    """A component: sampling factors, its tables, and its coefficients by block rows and columns."""

    key: int
    across: int
    down: int
    table: int
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


class _Bits:
    """Bits of an entropy-coded run, from which stuffing has been taken; past the end there are zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, k: int) -> int:
        while self.n < k:
            part = self.data[self.at : self.at + 4].ljust(4, b"\0")
            self.held, self.n, self.at = self.held << 32 | int.from_bytes(part, "big"), self.n + 32, self.at + 4
            if self.at > len(self.data) + 64:
                raise ValueError("a JPEG picture is cut off")
        return self.held >> (self.n - k)

    def skip(self, k: int) -> None:
        self.n -= k
        self.held &= (1 << self.n) - 1

    def symbol(self, table: list[tuple[int, int]]) -> int:
        s, size = table[self.peek(16)]
        if not size:
            raise ValueError("a code that no table has")
        self.skip(size)
        return s

    def number(self, size: int) -> int:
        if not size:
            return 0
        v = self.peek(size)
        self.skip(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _lookup(sizes: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, bits) by the next 16 bits."""
    out, k, filled = [(0, 0)] * (1 << 16), 0, 0
    for bits, n in enumerate(sizes, 1):
        for s in symbols[k : k + n]:
            span = 1 << (16 - bits)
            out[filled : filled + span] = [(s, bits)] * span
            filled += span
        k += n
    if filled > 1 << 16:
        raise ValueError("code tables run over")
    return out


def _scan(runs: list[bytes], planes: list[_Plane], tables: dict, chosen: dict[int, tuple[int, int]], interval: int, units: tuple[int, int]) -> None:
    """Fills the coefficients of a scan's components."""
    if len(planes) == 1:  # blocks of one component follow each other
        steps = [(planes[0], 1, 1)]
        rows, columns = units
    else:
        steps = [(p, p.across, p.down) for p in planes]
        rows, columns = units
    total = rows * columns
    for r, run in enumerate(runs):
        bits, before = _Bits(run), dict.fromkeys((p.key for p in planes), 0)
        begin = r * interval if interval else 0
        for unit in range(begin, min(total, begin + interval) if interval else total):
            y, x = divmod(unit, columns)
            for plane, across, down in steps:
                dc, ac = (tables[k, t] for k, t in enumerate(chosen[plane.key]))
                for v in range(down):
                    for u in range(across):
                        block = plane.blocks[y * down + v, x * across + u]
                        before[plane.key] += bits.number(bits.symbol(dc))
                        block[0] = before[plane.key]
                        k = 1
                        while k < 64:
                            s = bits.symbol(ac)
                            k += s >> 4
                            if not s & 15:
                                if s != 0xF0:
                                    break
                                k += 1
                                continue
                            if k > 63:
                                raise ValueError("a block runs over")
                            block[k] = bits.number(s & 15)
                            k += 1


def jpeg_decode(data: bytes) -> np.ndarray:
    """Pixels of a baseline JPEG picture of one or three components; others are not supported."""
    at, quant, tables, interval, planes, size, rgb, done = 2, {}, {}, 0, [], None, False, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * bool(wide) :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker in (0xC0, 0xC1):
            depth, h, w, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or not h or not w or parts not in (1, 3):
                raise ValueError("an unsupported JPEG picture")
            planes = [_Plane(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)]
            size = h, w
            most = max(p.across for p in planes), max(p.down for p in planes)
            if parts == 1:
                planes[0].across = planes[0].down = 1
                most = 1, 1
            units = -(-h // (8 * most[1])), -(-w // (8 * most[0]))
            for p in planes:
                p.blocks = np.zeros((units[0] * p.down, units[1] * p.across, 64), np.int32)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("an unsupported kind of JPEG")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            rgb = body[11] == 0
        elif marker == 0xDA:
            if size is None:
                raise ValueError("a scan before its frame")
            chosen = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            runs, begin = [], at
            while True:  # up to a marker that is neither stuffing nor a restart
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    at = len(data)
                elif data[at + 1] == 0 or data[at + 1] == 0xFF:
                    at += 1 + (data[at + 1] == 0)
                    continue
                runs.append(data[begin:at].replace(b"\xff\0", b"\xff"))
                if at < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
                    at = begin = at + 2
                    continue
                break
            own = [p for p in planes if p.key in chosen]
            one = own[0]
            grid = units if len(own) > 1 else (-(-size[0] * one.down // (8 * most[1])), -(-size[1] * one.across // (8 * most[0])))
            _scan(runs, own, tables, chosen, interval, grid)
            done += len(own)
    if size is None or done < len(planes):
        raise ValueError("a JPEG picture without all its scans")
    shown = []
    for p in planes:
        waves = np.zeros((*p.blocks.shape[:2], 64))
        waves[:, :, DIAGONAL] = p.blocks * quant[p.table]
        cells = _WAVES.T @ waves.reshape(*p.blocks.shape[:2], 8, 8) @ _WAVES + 128
        plane = cells.swapaxes(1, 2).reshape(8 * p.blocks.shape[0], -1)
        shown.append(plane.repeat(most[1] // p.down, axis=0).repeat(most[0] // p.across, axis=1)[: size[0], : size[1]])
    out = np.full((*size, 4), 255, np.uint8)
    if len(planes) == 1:
        colours = np.repeat(shown[0][:, :, None], 3, axis=2)
    else:
        colours = np.stack(shown, axis=2)
        if not rgb:
            colours = (colours - np.array([0, 128, 128])) @ np.linalg.inv(_TO_YCC).T
    out[:, :, :3] = np.clip(np.rint(colours), 0, 255)
    return out


# columns


@arrow_udf("binary")
def as_png(data: pd.Series) -> pd.Series:
    """Column function: QOI pictures as PNG, which any viewer shows; JPEG and PNG as they are; null for what is no picture."""

    def one(d):
        if d is None:
            return None
        d = bytes(d)
        try:
            return png_encode(on_white(qoi_decode(d))) if d[:4] == b"qoif" else d if d[:2] == b"\xff\xd8" or d[:8] == PNG_MAGIC else None
        except (ValueError, IndexError):
            return None

    return pd.Series([one(d) for d in data], dtype=object)


@arrow_udf("w int, h int, rgb binary")
def rgb_of(data: pd.Series) -> pd.DataFrame:
    """Column function: a picture's size and its pixels, row by row, on white; nulls for what can't be decoded."""
    rows = []
    for d in data:
        try:
            px = on_white(pixels_of(bytes(d) if d is not None else b""))
            rows.append((px.shape[1], px.shape[0], px.tobytes()))
        except ValueError:
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["w", "h", "rgb"]).astype({"w": "Int32", "h": "Int32"})


PREPARED = "entry_id long, path string, mimetype string, orig_w int, orig_h int, diagram boolean, w int, h int, data binary"


def prepare(width: int, height: int, quality: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (entry_id, path, mimetype, content) that decodes pictures, fits them into width x height and encodes them:
    diagrams (PNG by name, or 256 colours at most) without loss, others as JPEG of this quality. What can't be decoded is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # decoded pictures are large
                rows = []
                for entry_id, path, mimetype, content in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    try:
                        px = pixels_of(content or b"")
                    except ValueError:
                        continue
                    h, w, _ = px.shape
                    packed = np.ascontiguousarray(px).view("<u4")
                    diagram = path.rpartition(".")[2].lower() == "png" or len(np.unique(packed)) <= 256
                    small = thumbnail(on_white(px), width, height)
                    data = qoi_encode(small) if diagram else jpeg_encode(small, quality)
                    rows.append((entry_id, path, mimetype, w, h, diagram, small.shape[1], small.shape[0], data))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
                    names = [c.split()[0] for c in PREPARED.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run
