"""Substring dedup by seed and extend: repeated runs of min_words words are found through winnowed anchors.

Every window of min_words consecutive words has one anchor, its least n-gram hash (the leftmost on ties), which depends on the
window's words alone, so equal windows meet at equal anchors.  A seed is an anchor in a text; its context is the words of all
windows that have this anchor, up to min_words - gram on either side.  Anchors join texts, and matches are extended from them:

1. anchors found once in the corpus are dropped (counts are combined before the shuffle);
2. contexts that occur again as a whole are repeated to both ends, and one of each stands for its copies from here on;
3. the distinct contexts of an anchor are extended by half of the words that a match still lacks: of two sides that share all of
   them, one shares at least half.  A context that no other follows to the left or to the right is dropped;
4. what is left is extended to both ends, from each possible place of the anchor in a match; contexts that agree with another
   there are repeated in that window.

Windows that overlap or touch make up the maximal repeats.  At each step equal extensions meet by a hash of their words, of
128 bits where a match is decided.  No pairs of texts are made and no group is gathered: counts are combined before shuffles, and
joins on an anchor that a third of all texts share can be split.  Rows alike in id and text cost as much as other rows.

A document is a row; rows alike in id and text are copies of each other.  Null texts have no words and give the empty
text; null ids are kept; an empty table gives an empty result; other columns are ignored.  Texts of any length are worked on
whole, 1 MiB or one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.arrays import OTHER_BASE, Prefix, Words, mix, ragged, slices, tidy, window_start, word_chunks
from quire.llm.tables import forget, stored

MIN_WORDS = 35
GRAM = 8


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of each width consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at[:n]


@dataclass
class Seeds:
    """Seeds of consecutive texts, in order; places count all their words."""

    doc: np.ndarray
    at: np.ndarray  # the anchor
    first: np.ndarray  # the first window, where the context begins
    n: np.ndarray  # windows
    anchor: np.ndarray


def seeds(w: Words, min_words: int, gram: int) -> Seeds:
    grams = mix(Prefix(w.hashes).grams(gram))
    start, doc = window_start(w.counts, min_words)
    if not len(start):
        return Seeds(*(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64))
    at = sliding_argmin(grams, min_words - gram + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return Seeds(doc[first], at[first], start[first], np.diff(np.append(first, len(start))), grams[at[first]])


class Runs:
    """128-bit hashes of runs of words."""

    def __init__(self, w: Words):
        self.lanes = Prefix(w.hashes), Prefix(w.others, OTHER_BASE)

    def hash(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [mix(x.hash(start, end) + (end - start).astype(np.uint64), 3 + k).view(np.int64) for k, x in enumerate(self.lanes)]


def half(min_words: int, gram: int) -> int:
    """Words that a match has at least on one side of its anchor."""
    return -(-(min_words - gram) // 2)


_SEEDS = "k1 long, k2 long, first int, n int, anchor long, s1 long, s2 long, lefts int, rights int"


def _seeded(min_words: int, gram: int):
    """Seeds of texts (text, k1, k2): first window and number of windows, the context's hash, and short hashes of the anchor with
    half a match's further words on either side, null where the context ends before."""
    step = half(min_words, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, w in word_chunks(batch.column(0), twice=True):
                s, runs = seeds(w, min_words, gram), Runs(w)
                end = s.first + s.n - 1 + min_words
                context, sides = runs.hash(s.first, end), []
                for begin, stop in ((s.at - step, s.at + gram), (s.at, s.at + gram + step)):
                    inside = (begin >= s.first) & (stop <= end)
                    side = runs.lanes[0].hash(np.where(inside, begin, 0), np.where(inside, stop, 0))
                    sides.append(pa.array((mix(side, 6) >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=~inside))
                rows = pa.array(s.doc + i)
                first = pa.array((s.first - w.first[s.doc]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), first, pa.array(s.n.astype(np.int32)), pa.array(s.anchor.view(np.int64)), *map(pa.array, context), *sides], names=["k1", "k2", "first", "n", "anchor", "s1", "s2", "lefts", "rights"])

    return run


def _extended(min_words: int, gram: int):
    """For texts and the first windows of some of their seeds: context, place k in it and hash of each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            counts, flat = np.diff(wanted.offsets.to_numpy()), wanted.flatten().to_numpy()
            owner = np.repeat(np.arange(len(counts)), counts)
            for i, j, w in word_chunks(batch.column(0), twice=True):
                s, runs = seeds(w, min_words, gram), Runs(w)
                mine = (owner >= i) & (owner < j)
                keep = np.isin(s.first, w.first[owner[mine] - i] + flat[mine])
                first, n = s.first[keep], s.n[keep]
                context = runs.hash(first, first + n - 1 + min_words)
                at, k = ragged(first, n), ragged(np.zeros(len(n), np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)) for x in context] + [pa.array(k.astype(np.int32)), *map(pa.array, runs.hash(at, at + min_words))], names=["s1", "s2", "k", "w1", "w2"])

    return run


def covered(n_words: int, first: np.ndarray, mask: np.ndarray, min_words: int) -> np.ndarray:
    """Which words lie in a window first + k for which bit k of mask is set."""
    edge = np.zeros(n_words + 1, np.int64)
    for k in range(int(np.bitwise_or.reduce(mask)).bit_length() if len(mask) else 0):
        begin = first[(mask >> k) & 1 == 1] + k
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + min_words, -1)
    return np.cumsum(edge[:-1]) > 0


def _both(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) by the keys' complements.  Counts come out of their shuffle dealt by the keys already; by other
    values both sides are shuffled for the join itself, and only such shuffles can Spark split where a key is hot."""
    other = [f"not {k}" for k in keys]
    named = right.select(*[F.bitwise_not(k).alias(o) for k, o in zip(keys, other, strict=True)], *[c for c in right.columns if c not in keys])
    return left.withColumns({o: F.bitwise_not(k) for k, o in zip(keys, other, strict=True)}).join(named, other, how).drop(*other)


def _frequent(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1").select(*keys)


def repeats(keyed: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """For texts keyed by (k1, k2): a list of (first, mask) whose set bits are repeated windows; texts without any are left out.

    Seeds are made anew where they are needed: that is cheaper than to keep them, as a text has one every four words."""
    width = min_words - gram + 1
    if not 1 <= width <= 62:
        raise ValueError("windows of an anchor must fit a 64-bit mask")
    texts = keyed.select("text", "k1", "k2")
    every = texts.mapInArrow(tidy(_seeded(min_words, gram)), _SEEDS)
    met = _both(every, _frequent(every, "anchor"), ["anchor"], "left_semi")
    one = F.min(F.struct("k1", "k2", "first"))
    contexts = met.groupBy("s1", "s2").agg(F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ("n", "anchor", "lefts", "rights")], one.alias("one"))
    contexts = stored(contexts.select("*", "one.*").drop("one"), "contexts")
    sides = F.expr("inline(array(struct(0 AS side, lefts AS run), struct(1 AS side, rights AS run)))")
    contested = _both(contexts, _frequent(contexts, "anchor"), ["anchor"], "left_semi")
    sided = contested.select("k1", "k2", "first", "anchor", sides).where("run is not null")
    followed = _both(sided, _frequent(sided, "anchor", "side", "run"), ["anchor", "side", "run"], "left_semi")
    places = followed.groupBy("k1", "k2").agg(F.collect_set("first").alias("places"))
    found = _both(texts, places, ["k1", "k2"]).select("text", "places")
    windows = stored(found.mapInArrow(tidy(_extended(min_words, gram)), "s1 long, s2 long, k int, w1 long, w2 long"), "windows")
    again = windows.groupBy("w1", "w2").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("s1", "s2") for f in (F.min, F.max)])
    again = again.where("min_s1 <> max_s1 or min_s2 <> max_s2").select("w1", "w2")
    part = _both(windows, again, ["w1", "w2"], "left_semi").select("s1", "s2", F.expr("shiftleft(1L, k)").alias("mask"))
    whole = contexts.where("copies > 1").select("s1", "s2", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    masks = part.unionByName(whole).groupBy("s1", "s2").agg(F.expr("bit_or(mask)").alias("mask"))
    marks = _both(every.select("k1", "k2", "first", "s1", "s2"), masks, ["s1", "s2"])
    marks = stored(marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "mask")).alias("marks")), "marks")
    forget(windows, contexts)
    return marks


def keys(id_col: Column, text_col: Column) -> list[Column]:
    """128 bits by which alike rows are known."""
    return [F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), id_col, text_col).alias("k2")]


def without_repeats(df: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_text (the words left, joined by one space), and spans, the maximal repeats as
    [first word, end) pairs. A word goes if a window over it also starts anywhere else."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keys(F.col(id_col), F.col(text_col)))
    marks = repeats(source, min_words, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts, marks = batch.column(1).to_pylist(), batch.column(2)
            n_words, n_removed, kept, spans = [], [], [], []
            for d, text in enumerate(texts):
                own = (text or "").encode().split()
                out = _removed(own, marks[d].values, min_words)
                n_words.append(len(own))
                n_removed.append(int(out.sum()))
                kept.append(" ".join(x.decode() for x, gone in zip(own, out.tolist(), strict=True) if not gone) if out.any() else b" ".join(own).decode())
                edges = np.flatnonzero(np.diff(out, prepend=False, append=False))
                spans.append(edges.reshape(-1, 2).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=names)

    names = [id_col, "n_words", "n_removed", "kept_text", "spans"]
    kind = source.schema[0].dataType.simpleString()
    joined = _both(source, marks, ["k1", "k2"], "left").select("id", "text", "marks")
    return joined.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string, spans array<array<long>>")


def _removed(own: list[bytes], marks: pa.Array | None, min_words: int) -> np.ndarray:
    if marks is None or not len(marks):
        return np.zeros(len(own), bool)
    return covered(len(own), marks.field("first").to_numpy().astype(np.int64), marks.field("mask").to_numpy(), min_words)


def cut_repeats(df: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with the repeats cut out of its texts; what is left keeps its own white space. All columns stay, length_col
    (if any) follows the new text; a text that is all repeats becomes empty."""
    own = keys(F.col(id_col), F.col(text_col))
    marks = repeats(df.select(F.col(text_col).alias("text"), *own), min_words, gram)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *own)
    mark = "quire marks" + " " * max(map(len, df.columns))  # a name that no column has
    joined = _both(packed, marks, ["k1", "k2"], "left").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], F.col("marks").alias(mark))

    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            last = batch.num_columns - 1
            marks, rows = batch.column(last), batch.select(range(last))
            k = rows.schema.get_field_index(text_col)
            texts = [_cut(t, m.values, min_words) for t, m in zip(rows.column(k).to_pylist(), marks, strict=True)]
            rows = rows.set_column(k, rows.schema.field(k), pa.array(texts, rows.schema.field(k).type))
            n = rows.schema.get_field_index(length_col) if length_col else -1
            if n >= 0:
                rows = rows.set_column(n, rows.schema.field(n), pa.array([None if t is None else len(t) for t in texts], rows.schema.field(n).type))
            yield rows

    return joined.mapInArrow(tidy(run), df.schema)


def _cut(text: str | None, marks: pa.Array | None, min_words: int) -> str | None:
    if not text or marks is None or not len(marks):
        return text
    (_, _, w), *_ = word_chunks(pa.array([text]))
    out = _removed([b""] * len(w.start), marks, min_words)
    parts, at = [], 0
    for a, b in np.flatnonzero(np.diff(out, prepend=False, append=False)).reshape(-1, 2).tolist():
        parts.append(w.data[at : w.start[a]].tobytes())
        at = int(w.start[b]) if b < len(w.start) else len(w.data)
    return b"".join([*parts, w.data[at:].tobytes()]).decode()
