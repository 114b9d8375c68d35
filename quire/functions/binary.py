"""Binary formats: article blobs, LZ4 blocks, integers, checksums and magic numbers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, functions as F

from quire.functions.html import split_blocks
from quire.functions.lazy import arrow_udf
from quire.schemas import BLOCK_BYTES

MAGIC, LEGACY_MAGIC = b"WKI2", b"WIKI"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lz4_decompress(data: bytes, size: int) -> bytes:
    """The LZ4 block of size bytes at most; ValueError where it is malformed."""
    out, at, n = bytearray(), 0, len(data)

    def length(nibble: int, at: int) -> tuple[int, int]:
        if nibble == 15:
            while True:
                if at >= n:
                    raise ValueError("a length is cut off")
                nibble, at, more = nibble + data[at], at + 1, data[at]
                if more != 255:
                    break
        return nibble, at

    while at < n:
        token = data[at]
        literals, at = length(token >> 4, at + 1)
        if at + literals > n or len(out) + literals > size:
            raise ValueError("literals run over")
        out += data[at : at + literals]
        at += literals
        if at == n:
            return bytes(out)
        if at + 2 > n:
            raise ValueError("an offset is cut off")
        back = data[at] | data[at + 1] << 8
        match, at = length(token & 15, at + 2)
        match += 4
        if not 0 < back <= len(out) or len(out) + match > size:
            raise ValueError("a match lies outside")
        begin = len(out) - back
        while match > 0:  # a match may overlap what it makes
            piece = out[begin : begin + match]
            out += piece
            match -= len(piece)
    raise ValueError("the last literals are missing") if n else ValueError("no data")


def lz4_compress(data: bytes) -> bytes:
    """An LZ4 block by greedy matching of four-byte groups."""
    out, seen, begin, at, n = bytearray(), {}, 0, 0, len(data)

    def put(literals: bytes, match: int, back: int) -> None:
        over = lambda v: b"\xff" * ((v - 15) // 255) + bytes([(v - 15) % 255]) if v >= 15 else b""
        out.append(min(len(literals), 15) << 4 | (min(match - 4, 15) if match else 0))
        out.extend(over(len(literals)) + literals)
        if match:
            out.extend(struct.pack("<H", back) + over(match - 4))

    while at + 12 < n:  # the format wants the last match to end five bytes before the end
        group = data[at : at + 4]
        found = seen.get(group)
        seen[group] = at
        if found is None or at - found > 0xFFFF:
            at += 1
            continue
        end = at + 4
        while end < n - 5 and data[end] == data[found + end - at]:
            end += 1
        put(data[begin:at], end - at, at - found)
        begin = at = end
    put(data[begin:], 0, 0)
    return bytes(out)


def compress_block(data: bytes) -> bytes:
    """An LZ4 block behind its original size."""
    return struct.pack("<I", len(data)) + lz4_compress(data)


def decompress_block(data: bytes) -> bytes:
    size = struct.unpack_from("<I", data)[0]
    out = lz4_decompress(data[4:], size)
    if len(out) != size:
        raise ValueError("a block has another size")
    return out


def pack(article_id: int, title: str, html: str, block: int = BLOCK_BYTES) -> bytes:
    """An article blob: magic, id, title, and LZ4 blocks of its HTML. A title of over 65,535 bytes is cut."""
    name = title.encode()[:65535].decode("utf-8", "ignore").encode()
    blocks = [compress_block(b) for b in split_blocks(html.encode(), block)]
    head = MAGIC + struct.pack("<IH", article_id, len(name)) + name + struct.pack("<H", len(blocks))
    return head + b"".join(struct.pack("<I", len(b)) + b for b in blocks)


def unpack(blob: bytes) -> tuple[int, str, list[bytes]] | None:
    """(id, title, blocks) of a blob of either format; None for what is none."""
    try:
        if blob[:4] == MAGIC:
            article_id, n = struct.unpack_from("<IH", blob, 4)
            title, at = blob[10 : 10 + n].decode("utf-8", "replace"), 10 + n
            count, blocks = struct.unpack_from("<H", blob, at)[0], []
            at += 2
            for _ in range(count):
                size = struct.unpack_from("<I", blob, at)[0]
                blocks.append(decompress_block(blob[at + 4 : at + 4 + size]))
                at += 4 + size
            return article_id, title, blocks
        data = decompress_block(blob)
        if data[:4] != LEGACY_MAGIC:
            return None
        article_id, n = struct.unpack_from("<IH", data, 4)
        size = struct.unpack_from("<I", data, 10 + n)[0]
        html = data[14 + n : 14 + n + size]
        return (article_id, data[10 : 10 + n].decode("utf-8", "replace"), [html] if html else []) if len(html) == size else None
    except (struct.error, ValueError, IndexError):
        return None


def pack_legacy(article_id: int, title: str, html: str) -> bytes:
    name, body = title.encode(), html.encode()
    return compress_block(LEGACY_MAGIC + struct.pack("<IH", article_id, len(name)) + name + struct.pack("<I", len(body)) + body)


def packed_articles(block: int = BLOCK_BYTES):
    """Column function: (id, title, html) to a blob."""

    @arrow_udf("binary")
    def pack_rows(article_id: pd.Series, title: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else pack(int(i), t or "", h, block) for i, t, h in zip(article_id, title, html, strict=True)], dtype=object)

    return pack_rows


@arrow_udf("article_id long, title string, blocks array<binary>")
def unpacked_articles(blob: pd.Series) -> pd.DataFrame:
    """Column function: blob to (id, title, blocks); nulls for what is none."""
    rows = [unpack(bytes(b)) if b is not None else None for b in blob]
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["article_id", "title", "blocks"]).astype({"article_id": "Int64"})


@arrow_udf("binary")
def packed_legacy(article_id: pd.Series, title: pd.Series, html: pd.Series) -> pd.Series:
    """Column function: (id, title, html) to a blob of the older format."""
    return pd.Series([None if h is None else pack_legacy(int(i), t or "", h) for i, t, h in zip(article_id, title, html, strict=True)], dtype=object)


@arrow_udf("binary")
def compressed(data: pd.Series) -> pd.Series:
    """Column function: text or bytes to an LZ4 block behind its size."""
    return pd.Series([None if d is None else compress_block(d.encode() if isinstance(d, str) else bytes(d)) for d in data], dtype=object)


@arrow_udf("binary")
def decompressed(block: pd.Series) -> pd.Series:
    """Column function: an LZ4 block behind its size to its bytes; null for what is malformed."""

    def one(b):
        try:
            return None if b is None else decompress_block(bytes(b))
        except (ValueError, struct.error):
            return None

    return pd.Series([one(b) for b in block], dtype=object)


def little_endian(data: Column | str, at: int | Column, n: int) -> Column:
    """Unsigned little-endian number of n bytes at a position from 0; null past the end."""
    part = F.substring(_c(data), (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(_reversed_hex(part, n), 16, 10).cast("long"))


def big_endian(data: Column | str, at: int, n: int) -> Column:
    part = F.substring(_c(data), at + 1, n)
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def _reversed_hex(part: Column, n: int) -> Column:
    h = F.hex(part)
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])


def rolling_checksum(data: Column | str) -> Column:
    """c = c * 31 + byte modulo 2**32 over all bytes."""
    h = F.hex(_c(data))
    steps = F.sequence(F.lit(0), F.octet_length(_c(data)) - 1)
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda c, i: F.pmod(c * 31 + byte(i), F.lit(1 << 32)))
    return F.when(F.octet_length(_c(data)) == 0, F.lit(0).cast("long")).otherwise(total)


def kind_of(data: Column | str) -> Column:
    """What the first bytes say: article, legacy, qoi, jpeg, png, or unknown."""
    h = F.hex(F.substring(_c(data), 1, 4))
    code = lambda b: b.hex().upper()
    out = F.when(h == code(MAGIC), "article").when(h == code(LEGACY_MAGIC), "legacy").when(h == code(b"qoif"), "qoi")
    return out.when(h.startswith("FFD8"), "jpeg").when(h == code(b"\x89PNG"), "png").otherwise("unknown")


def size_of(data: bytes) -> tuple[int, int] | None:
    """(w, h) from a picture's header: QOI's, PNG's, or that of a JPEG's first frame; None for others and for what is cut off."""
    if data[:4] == b"qoif":
        found = struct.unpack_from(">II", data, 4) if len(data) >= 12 else None
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        found = struct.unpack_from(">II", data, 16) if len(data) >= 24 and data[12:16] == b"IHDR" else None
    else:
        found = _frame_size(data) if data[:2] == b"\xff\xd8" else None
    return found if found and max(found) < 1 << 31 else None


def _frame_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = struct.unpack_from(">BH", data, at + 1)
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker in (0xC0, 0xC1, 0xC2):
            return (*reversed(struct.unpack_from(">HH", data, at + 5)),) if at + 9 <= len(data) else None
        elif marker == 0xDA or size < 2:
            return None
        else:
            at += 2 + size
    return None


@arrow_udf("w int, h int")
def _sizes(data: pd.Series) -> pd.DataFrame:
    rows = [(size_of(bytes(d)) if d is not None else None) or (None, None) for d in data]
    return pd.DataFrame(rows, columns=["w", "h"]).astype("Int32")


def picture_size(data: Column | str) -> Column:
    """Column function: size_of() by rows, as (w, h); null for what is no picture. Segments before a JPEG's frame may have any size."""
    found = _sizes(_c(data))
    return F.when(found["w"].isNotNull(), found)
