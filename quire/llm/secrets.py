"""Secret scan: pattern candidates plus structurally confirmed keys and signed tokens.

The base kinds are patterns.  The structural kinds decode a candidate and parse it before it is reported: a PEM or bare
base64/hex blob counts only if its DER lengths nest, however deep, and fill it exactly in the shape of a key, an OpenSSH key only if
its length-prefixed fields parse, a signed token only if its header is a JSON object that names an algorithm.  An encrypted PEM key
counts by its header lines and whole cipher blocks.  Bare base64 may be wrapped over lines of any width from 4 on, none wider than the
first: the lengths that a blob states tell how many characters it has.  A run of lines is joined once, and of a candidate only the
lengths are decoded until all fit, so a text takes time in proportion to its length and to that of the keys in it.

Nulls count as empty texts and give zero counts and empty spans; rows are independent, so repeated rows and ids repeat
their results, and extra columns of the input are ignored.  Spans of one start come in the order of their kinds and ends, so there are no
ties; spans may overlap.  An empty table gives an empty result.  The scan is map-only and reads whole texts, however long.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.arrays import slices, tidy

KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # as [0-9a-f]+ with shorter matches dropped: a match is a whole run either way
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s*((?:[A-Za-z][A-Za-z-]{0,39}: [^\r\n]{0,200}\r?\n)*)([A-Za-z0-9+/=\s\\]*)-----END \1-----")
_ENCRYPTED = re.compile(r"Proc-Type: 4,ENCRYPTED\r?\n(?:.*\n)*?DEK-Info: [A-Z0-9-]+,(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\r?\n")
_BLOB = re.compile(r"(?<![A-Za-z0-9+/])M[A-P][A-Za-z0-9+/]{2,}")  # base64 of 0x30, a DER sequence; its first line
_SSH = re.compile(r"(?<![A-Za-z0-9+/])b3Bl[A-Za-z0-9+/]*")  # base64 of ope..; its first line
_MORE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/]+)")  # another line of base64
_HEXDER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{58,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at a position, None if it doesn't fit below end."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    found = []
    while start < end:
        if (x := _tlv(data, start, end)) is None:
            return None
        found.append(x)
        start = x[2]
    return found


def _nests(data: bytes, start: int, end: int) -> bool:
    """Whether every constructed element from start to end is filled exactly by its parts."""
    todo = [(start, end)]
    while todo:
        if (parts := _children(data, *todo.pop())) is None:
            return False
        todo += [(a, b) for tag, a, b in parts if tag & 0x20]
    return True


def der_key(data: bytes) -> bool:
    """Whether data is one DER private or public key: RSA, EC, PKCS#8 plain or encrypted, or SubjectPublicKeyInfo."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or not _nests(data, top[1], top[2]):
        return False
    parts = _children(data, top[1], top[2])
    tags = [t for t, _, _ in parts]
    if tags[:2] == [0x02, 0x30] and 0x04 in tags[2:3]:  # version, algorithm, key octets
        return bool((alg := _children(data, parts[1][1], parts[1][2])) and alg[0][0] == 0x06)
    if tags[:2] == [0x02, 0x04]:  # EC: version 1, private octets
        return data[parts[0][1] : parts[0][2]] == b"\x01" and parts[1][2] - parts[1][1] >= 16
    if len(tags) in (6, 9) and set(tags) == {0x02}:  # DSA or RSA: version and numbers, one of them of 64 bytes or more
        return max(b - a for _, a, b in parts) >= 64
    if len(tags) == 2 and tags[0] == 0x30 and tags[1] in (0x03, 0x04):  # public key, or encrypted key
        return bool((alg := _children(data, parts[0][1], parts[0][2])) and alg[0][0] == 0x06 and parts[1][2] - parts[1][1] >= 32)
    return False


def _openssh_ends(read) -> tuple[int, int] | None:
    """Where the public fields of an openssh-key-v1 blob end (cipher, kdf, options, key count, public key) and where its private part
    does, None if they don't parse. read(at, n) gives n bytes of it, or fewer at its end."""
    if read(0, 15) != b"openssh-key-v1\0":
        return None
    number = lambda at: int.from_bytes(x, "big") if len(x := read(at, 4)) == 4 else -1
    at = 15
    for _ in range(3):
        if (n := number(at)) < 0:
            return None
        at += 4 + n
    keys, n = number(at), number(at + 4)
    if keys != 1 or n <= 0:
        return None
    private = number(at + 8 + n)
    return at + 8 + n, at + 12 + n + max(private, 0)


def openssh_key(data: bytes) -> bool:
    """Whether data begins with a well-formed openssh-key-v1 header: cipher, kdf, options, key count, public key."""
    ends = _openssh_ends(lambda at, n: data[at : at + n])
    return ends is not None and ends[0] <= len(data)


def _b64(text: str, url: bool = False) -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


class _Lines:
    """A run of lines of base64: its characters joined once, whatever the number of candidates that begin in it."""

    def __init__(self, text: str, start: int, end: int):
        self.ends, parts = [end], [text[start:end]]
        while more := _MORE.match(text, end):
            parts.append(more[1])
            end = more.end()
            self.ends.append(end)
        self.joined = "".join(parts)
        self.widths = [len(p) for p in parts]
        self.upto = list(itertools.accumulate(self.widths))  # characters with each line
        self.wider, open_ = [len(parts)] * len(parts), []  # the next line that is wider
        for k, n in enumerate(self.widths):
            while open_ and self.widths[open_[-1]] < n:
                self.wider[open_.pop()] = k
            open_.append(k)


class _Blob:
    """Base64 that begins with a match and goes on over lines no wider than its first one."""

    def __init__(self, text: str, m: re.Match, known: dict[int, tuple[_Lines, int]]):
        if m.end() not in known:
            lines = _Lines(text, *m.span())
            known.update((end, (lines, k)) for k, end in enumerate(lines.ends))
        self.text, (self.lines, self.first) = text, known[m.end()]
        width, k = m.end() - m.start(), self.first + 1
        while k < len(self.lines.widths) and self.lines.widths[k] <= width:
            k = self.lines.wider[k]
        self.start = self.lines.upto[self.first] - width
        self.end = self.lines.upto[k - 1]  # in the joined characters

    def read(self, at: int, n: int) -> bytes:
        """n bytes from a place on, or fewer at the end; only their characters are decoded."""
        begin = at // 3 * 4
        chars = self.lines.joined[self.start + begin : min(self.end, self.start + (at + n + 2) // 3 * 4)]
        return (_b64(chars[: len(chars) // 4 * 4] if len(chars) % 4 == 1 else chars) or b"")[at % 3 : at % 3 + n]

    def end_of(self, size: int, whole_line: bool) -> int | None:
        """Where in the text size bytes end, with the padding behind them; None if there are fewer, or if they have to end a line and don't."""
        chars = self.start + -(-8 * size // 6)
        k = bisect.bisect_left(self.lines.upto, chars, self.first)
        if chars > self.end or whole_line and self.lines.upto[k] != chars:
            return None
        end = self.lines.ends[k]
        for _ in range(-(chars - self.start) % 4 if self.lines.upto[k] == chars else 0):
            end += self.text[end : end + 1] == "="
        return end


def _der_blob(blob: _Blob) -> tuple[int, bytes] | None:
    """(end, bytes) of the DER element that a blob states the length of, if its top level parses; None if the blob has more or fewer
    characters. Lengths alone are read until all of them fit."""
    head = blob.read(0, 6)
    if len(head) < 6 or head[0] != 0x30 or head[1] == 0x80 or head[1] > 0x84:
        return None
    k = head[1] & 0x7F
    at, size = (2, 2 + head[1]) if head[1] < 0x80 else (2 + k, 2 + k + int.from_bytes(head[2 : 2 + k], "big"))
    end, tags = blob.end_of(size, True), []
    if end is None:
        return None
    while at < size:
        part = blob.read(at, 6)
        long = part[1] & 0x7F if len(part) == 6 and part[1] > 0x80 else 0
        if len(part) < min(6, size - at) or len(part) < 2 or long > 4 or len(tags) == 9:
            return None
        tags.append(part[0])
        if len(tags) == 1 and part[0] not in (0x02, 0x30):
            return None
        at += 2 + (long + int.from_bytes(part[2 : 2 + long], "big") if long else part[1])
    data = blob.read(0, size) if at == size else b""
    return (end, data) if len(data) == size else None


def signed_token(header: str, payload: str) -> bool:
    """Whether header decodes to a JSON object with an algorithm and payload to a JSON object."""
    for part, key in ((header, "alg"), (payload, None)):
        try:
            value = json.loads(_b64(part, True) or b"")
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or key and not isinstance(value.get(key), str):
            return False
    return True


def scan(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of all spans by start and kind, base kinds and confirmed ones."""
    out = [(*m.span(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access", m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(*m.span(), "hex", m.start()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _b64(re.sub(r"\\[nr]|\s", "", m[3]))
            if data and (len(data) % 8 == 0 if _ENCRYPTED.match(m[2]) else der_key(data) or openssh_key(data)):
                out.append((*m.span(), "pem", m.start()))
    lines: dict[int, tuple[_Lines, int]] = {}
    out += [(m.start(), found[0], "der", m.start()) for m in _BLOB.finditer(text) if (found := _der_blob(_Blob(text, m, lines))) and der_key(found[1])]
    out += [(*m.span(), "der", m.start()) for m in _HEXDER.finditer(text) if len(m[0]) % 2 == 0 and der_key(bytes.fromhex(m[0]))]
    if "b3Bl" in text:
        for m in _SSH.finditer(text):
            blob = _Blob(text, m, lines)
            if ends := _openssh_ends(blob.read):
                if (end := blob.end_of(ends[1], False)) or blob.end_of(ends[0], False):
                    out.append((m.start(), end or m.end(), "openssh", m.start()))
    if "eyJ" in text:
        out += [(*m.span(), "jwt", m.start()) for m in _JWT.finditer(text) if signed_token(m[1], m[2])]
    return sorted(out, key=lambda x: (x[0], _ORDER[x[2]], x[1]))


def redact(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """text with each secret replaced by mark; overlapping spans make one mark. None stays None."""
    if not text:
        return text
    out, at = [], 0
    for a, b in sorted((s, e) for _, e, _, s in scan(text)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256 of the base spans, and all spans as kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [scan(t) if t else [] for t in batch.column(1).to_pylist()]
            base = [[x for x in spans if _ORDER[x[2]] < 3] for spans in found]
            count = lambda k: pa.array([sum(x[2] == k for x in spans) for spans in base], pa.int64())
            sha = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), count("assign"), count("access"), count("hex"), pa.array(sha, pa.string()), pa.array([_joined(s) for s in found], pa.string())], names=names)

    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    source = df.select(F.col(id_col), F.col(text_col))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with secrets in its texts replaced; all its columns stay, length_col (if any) follows the new text."""

    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = batch.column(at).to_pylist()
            new = [redact(t) for t in texts]
            for name, values in ((text_col, new), (length_col, [None if t is None else len(t) for t in new])):
                k = batch.schema.get_field_index(name) if name else -1
                if k >= 0:
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
            yield batch

    return df.mapInArrow(tidy(run), df.schema)
