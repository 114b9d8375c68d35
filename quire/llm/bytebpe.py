"""Byte-level BPE of whole texts, in numpy, from a public tokenizer file.

Texts are cut into pretokens by array operations on code points (the split pattern of the file is fixed: contractions, letters,
numbers, other, white space), equal pretokens are encoded once, and ids are gathered back.  How new pretokens are merged is the
caller's choice: ``PairIndex`` (a pair occurrence index over the new pretokens of 8 MiB of a partition at a time) or the compiled
merge loop of tiktoken.  A special token's string is a pretoken of its own.  Characters that this Python's Unicode data does not
know are asked of the tokenizers library's splitter, one by one, so results equal that library's for every text.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from quire.llm.arrays import CHUNK_BYTES, Prefix, chunks, mix, ragged

CACHE_ENTRIES = 250_000
TOGETHER = 8  # chunks
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point; UNSURE where this Python's Unicode data has no character."""
    kinds = {"L": LETTER, "N": NUMBER, "Cn": UNSURE}
    found = (unicodedata.category(chr(c)) for c in range(0x110000))
    table = np.fromiter((kinds.get(k, kinds.get(k[0], OTHER)) for k in found), np.uint8, 0x110000)
    table[list(_WHITE)] = SPACE
    return table


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, reversed."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merge ranks of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_characters()
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.size = max(self.bytes_of) + 1
        self.byte_id = np.array([vocab[c] for c, _ in sorted(of.items(), key=lambda x: x[1])], np.int64)
        pairs, merged, made = [], [], {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append(vocab[a] << 32 | vocab[b])
            merged.append(vocab[a + b])
            if made.setdefault(a + b, rank) != rank or max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError(f"merge {rank} of {path} does not come after the merges that make its parts")
        self.pair_codes, self.merged = np.array(pairs, np.int64), np.array(merged, np.int64)
        self.sorted_order = np.argsort(self.pair_codes)
        self.sorted_codes = self.pair_codes[self.sorted_order]
        self.rank_of = dict(zip(pairs, range(len(pairs)), strict=True))

    def class_of(self, c: str) -> int:
        """The class that the library's splitter gives a character: it joins a letter, a number, or else other characters."""
        split = lambda before: len(self.library.pre_tokenizer.pre_tokenize_str(before + c)) == 1
        return LETTER if split("a") else NUMBER if split("1") else OTHER

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        """Merge rank of each pair code, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.sorted_codes, codes), len(self.sorted_codes) - 1)
        return np.where(self.sorted_codes[at] == codes, self.sorted_order[at], -1)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Vocabulary(path)


class PairIndex:
    """Merges many pretokens at once through an index from each mergeable pair to all its positions."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        vocab = self.vocab
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        ids = vocab.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        if not n:
            return [[] for _ in pieces]
        codes = ids[:-1] << 32 | ids[1:]
        rank = vocab.ranks(codes) if n > 1 else np.zeros(0, np.int64)
        rank[ends[(ends > 0) & (ends < n)] - 1] = -1  # no pair across pretokens
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        found, cuts = np.unique(rank[at], return_index=True)
        index = dict(zip(found.tolist(), (array("i", x.astype(np.int32).tobytes()) for x in np.split(at, cuts[1:])), strict=True)) if len(at) else {}
        heap = list(index)
        heapq.heapify(heap)
        symbol = array("i", ids.astype(np.int32).tobytes())
        follows, before = (array("i", np.arange(k, n + k, dtype=np.int32).tobytes()) for k in (1, -1))
        for e in ends.tolist():
            if e:
                follows[e - 1] = -1
            if e < n:
                before[e] = -1
        rank_of, made, pairs = vocab.rank_of, vocab.merged.tolist(), vocab.pair_codes.tolist()
        while heap:
            r = heapq.heappop(heap)
            left, right, new = pairs[r] >> 32, pairs[r] & 0xFFFFFFFF, made[r]
            for p in sorted(index.pop(r)):
                if symbol[p] != left or (q := follows[p]) < 0 or symbol[q] != right:
                    continue  # an earlier merge took one of the two
                symbol[p], symbol[q] = new, -1
                follows[p] = after = follows[q]
                if after >= 0:
                    before[after] = p
                    if (k := rank_of.get(new << 32 | symbol[after])) is not None:
                        if k not in index:
                            index[k] = array("i")
                            heapq.heappush(heap, k)
                        index[k].append(p)
                if (b := before[p]) >= 0 and (k := rank_of.get(symbol[b] << 32 | new)) is not None:
                    if k not in index:
                        index[k] = array("i")
                        heapq.heappush(heap, k)
                    index[k].append(b)
        out, a = [], 0
        for e in ends.tolist():
            out.append([s for s in symbol[a:e] if s >= 0])
            a = e
        return out


def compiled(vocab: Vocabulary) -> Callable[[list[bytes]], list[list[int]]]:
    """tiktoken's merge loop over the same merges."""
    import tiktoken

    ranks = {b: i for i, b in vocab.bytes_of.items() if b.decode("utf-8", "replace") not in vocab.special}
    core = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return lambda pieces: [core.encode_single_piece(p) for p in pieces]


def pretoken_starts(cps: np.ndarray, kind: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where pretokens begin; they cover the texts, so one ends where the next begins. doc_start: first of each text."""
    n = len(cps)
    start = np.zeros(n + 1, bool)
    start[doc_start] = True
    first = start[:n].copy()
    space = kind == SPACE
    before = np.empty(n, np.int8)
    before[0], before[1:] = -1, kind[:-1]
    before[first] = -1
    start[:n] |= (before != kind) & ~((before == SPACE) & ~space)  # a new class, but for what follows white space
    start[1:n] |= ~space[1:] & (before[1:] == SPACE) & (cps[:-1] != 0x20)
    start[: n - 1] |= space[:-1] & ~space[1:] & ~first[1:]  # the last of white space before something else
    for i in np.flatnonzero(start[:n] & (cps == 0x27)).tolist():
        rest = "".join(chr(c) for c in cps[i + 1 : i + 3])
        size = 2 if rest[:1] in ("s", "t", "m", "d") else 3 if rest in ("re", "ve", "ll") else 0
        if size and not first[i + 1 : i + size].any():
            start[i + 1 : i + size] = False
            start[i + size] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of whole texts; keeps a bounded cache of pretokens, for a partition and the worker's next ones."""

    def __init__(self, path: str, merge: str = "compiled"):
        self.vocab = vocabulary(path)
        self.merge = PairIndex(self.vocab) if merge == "pair_index" else compiled(self.vocab)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        for text, i in self.vocab.special.items():
            self._keep(text, [i])

    def _keep(self, text: str, ids: list[int]) -> None:
        k = len(self.known)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if k == len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[k], self.size[k] = self.used, len(ids)
        self.used += len(ids)
        self.known[text] = k

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct pretokens, which of them follow one another, the first of each text and the end)."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        text = data.tobytes().decode("utf-8")
        if not text:
            return [], np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        count = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=count[1:])
        bounds = count[offsets]  # of texts, in code points
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = _classes()[cps]
        for c in np.unique(cps[kind == UNSURE]).tolist():
            kind[cps == c] = self.vocab.class_of(chr(c))
        begins, spans = bounds[:-1][np.diff(bounds) > 0], self._specials(text, bounds)
        if spans:  # a special token ends what is before it and begins what is behind
            begins = np.unique(np.concatenate([begins, *[s for s in spans if s[1] < len(cps)], [s[0] for s in spans]]))
        start = pretoken_starts(cps, kind, begins)
        if spans:
            inner = np.zeros(len(cps) + 1, bool)
            for a, b in spans:
                inner[a + 1 : b] = True
            start = start[~inner[start]]
        end = np.append(start[1:], len(cps))
        hashes = mix(Prefix(cps.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).hash(start, end) + (end - start).astype(np.uint64))
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        strings = [text[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        return strings, which.astype(np.int32), np.searchsorted(start, bounds)

    def _specials(self, text: str, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Places of special tokens, none of which lies in two texts."""
        out = []
        for s in self.vocab.special:
            at = text.find(s)
            while at >= 0:
                if np.searchsorted(bounds, at, side="right") == np.searchsorted(bounds, at + len(s), side="left"):
                    out.append((at, at + len(s)))
                    at = text.find(s, at + len(s))
                else:
                    at = text.find(s, at + 1)
        return sorted(out)

    def encode_all(self, data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end text, ids, first id of each of these texts and the end) of the UTF-8 texts data[offsets[i]:offsets[i+1]],
        chunk by chunk; the new pretokens of TOGETHER chunks are merged together before."""
        every = list(chunks(offsets, limit))
        for k in range(0, len(every), TOGETHER):
            yield from self._encoded([(i, j, *self._cut(data, offsets[i : j + 1])) for i, j in every[k : k + TOGETHER]])

    def _encoded(self, cut: list[tuple]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        def new() -> list[str]:
            return list({s: None for _, _, strings, _, _ in cut for s in strings if s not in self.known})

        found = new()
        if len(self.known) + len(found) > CACHE_ENTRIES:
            self.clear()
            found = new()
        for text, ids in zip(found, self.merge([t.encode() for t in found]), strict=True):
            self._keep(text, ids)
        del found
        for i, j, strings, which, place in cut:
            entry = np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))[which]
            size = self.size[entry]
            total = np.zeros(len(entry) + 1, np.int64)
            np.cumsum(size, out=total[1:])
            yield i, j, self.pool[ragged(self.at[entry], size)], total[place]


@lru_cache(2)
def encoder(path: str, merge: str = "compiled") -> Encoder:
    """The worker's encoder of a file."""
    return Encoder(path, merge)


class Spelling:
    """Bytes that stand for each id, gathered for many ids at once."""

    def __init__(self, of: list[bytes]):
        self.size = np.fromiter(map(len, of), np.int64, len(of))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(of), np.uint8)

    def __call__(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, list[int]]:
        """(the bytes of all ids, where those of each text begin and the end)."""
        size = self.size[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return self.data[ragged(self.start[ids], size)].tobytes(), total[first].tolist()


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text's ids."""
    n = len(first) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    keep = np.ones(len(out), bool)
    keep[first[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, first + np.arange(n + 1)
