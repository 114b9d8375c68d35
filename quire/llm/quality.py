"""Quality rules: counts over whole texts, and a calibrated logistic regression on hashed word and character n-grams.

The classifier is fitted in one task on the features of at most MAX_TRAIN labelled rows (those of least id hash), a documented bound
that holds at any size; tasks make the features of whole texts, and a fifth of the rows is held back to calibrate its probability.
Features are relative frequencies of words, word pairs and runs of four characters of the lower-cased text (A-Z), hashed to FEATURES
buckets each.  Scoring is map-only, in
Arrow batches, against fixed thresholds.  With no labels of both kinds there is no classifier, and the base rules decide.

Null texts count as empty (they fail the base rules). Labels that are null or not 0 or 1 are ignored; an id labelled
twice takes its least label, and of labelled documents that share an id the text of least hash.  Rows are scored one by one, so
repeated rows and ids repeat their results, and there are no ties; other columns are ignored, an empty table gives an empty result.
Texts of any length count whole; three-word windows are held to be equal by a hash of 64 bits within a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.arrays import SPACE, Prefix, Words, buffers, mix, tidy, window_start, words, word_chunks

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MIN_PROBABILITY = 0.5
MAX_TRAIN = 2000
FEATURES = 1 << 17
EPOCHS, RATE, DECAY = 80, 0.05, 1e-4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def base_counts(w: Words, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; bounds: of texts in w.data."""
    data = w.data
    inside = ~SPACE[data]
    raw, dup_lines = data.tobytes(), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        seen, n = set(), 0
        for line in raw[a:b].split(b"\n"):
            if line in seen:
                n += bool(line.strip(b" \t\n\r\x0b\x0c"))
            else:
                seen.add(line)
        dup_lines.append(n)
    start, doc = window_start(w.counts, 3)
    key = mix(Prefix(w.hashes).hash(start, start + 3) + mix(doc.astype(_U), 2))
    order = np.argsort(key)
    again = np.zeros(len(key), bool)
    same = key[order[1:]] == key[order[:-1]]
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(w.start) + 2, bool)
    for k in range(3):
        covered[start[again] + k] = True
    return {
        "n_words": w.counts,
        "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _per_text(_SYMBOL[data], bounds),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": _per_text(covered[: len(w.start)], w.first),
    }


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs and character runs: (bucket of each occurrence, first occurrence of each text and the end)."""
    w = words(data, offsets, lower=True)
    bounds = offsets - offsets[0]
    mask, out = _U(FEATURES - 1), []
    out.append((w.hashes & mask, w.first))
    start, doc = window_start(w.counts, 2)
    out.append((mix(Prefix(w.hashes).hash(start, start + 2), 21) & mask, np.searchsorted(doc, np.arange(len(w.counts) + 1))))
    cps = np.frombuffer(w.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    count = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=count[1:])
    size = np.diff(count[bounds])
    start, doc = window_start(size, 4)
    four = np.zeros(len(start), np.uint32)
    for k in range(4):
        four = (four ^ cps[start + k]) * np.uint32(0x01000193)
    four = (four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    out.append(((four ^ (four >> np.uint32(13))) & np.uint32(FEATURES - 1), np.searchsorted(doc, np.arange(len(size) + 1))))
    return [(b.astype(np.int64) + k * FEATURES, f) for k, (b, f) in enumerate(out)]


def raw_scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum over the three kinds of the mean weight of a text's features."""
    out = np.zeros(len(offsets) - 1)
    for buckets, first in features(data, offsets):
        total = np.zeros(len(buckets) + 1)
        np.cumsum(weights[buckets], out=total[1:])
        out += (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first))
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text's features: at most 3 * FEATURES, however long it is."""
    index, value = [], []
    for buckets, _ in features(*buffers(pa.array([text]))):
        found, counts = np.unique(buckets, return_counts=True)
        index.append(found.astype(np.int32))
        value.append((counts / max(1, len(buckets))).astype(np.float32))
    return np.concatenate(index), np.concatenate(value)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """(weights, slope, intercept): the chance of quality 1 is sigmoid(slope * raw score + intercept). None for one class. rows: sparse()
    of each text."""
    own = np.arange(len(rows)) % 5 != 0
    if min((y[own] == 1).sum(), (y[own] == 0).sum()) == 0:
        return None
    index, value, size = [i for i, _ in rows], [v for _, v in rows], [len(i) for i, _ in rows]
    index, value, size = np.concatenate(index), np.concatenate(value), np.array(size)
    row = np.repeat(np.arange(len(rows)), size)
    used = np.repeat(own, size)
    columns, compact = np.unique(index[used], return_inverse=True)
    v, r = value[used], row[used]
    w, b = np.zeros(len(columns)), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = y[own].mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) * own / own.sum()  # both classes weigh the same
    for step in range(1, EPOCHS + 1):
        z = np.bincount(r, v * w[compact], len(rows)) + b
        g = (_sigmoid(z) - y) * cost
        grad, gb = np.bincount(compact, v * g[r], len(w)) + DECAY * w / len(w), g.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= RATE * 20 * fix * m / (np.sqrt(s) + 1e-9)
        b -= RATE * fix * mb / (np.sqrt(sb) + 1e-9)
    weights = np.zeros(3 * FEATURES, np.float32)
    weights[columns] = w
    raw = np.bincount(row, value * weights[index], len(rows))[~own]
    slope, intercept = calibrated(raw, y[~own])
    return weights, slope, intercept


def calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of Platt's sigmoid, with his smoothed targets, by Newton's method."""
    good = int(y.sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    scale, mid = float(raw.std()) or 1.0, float(raw.mean()) if len(raw) else 0.0
    x = (raw - mid) / scale
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        h = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a - da, b - db
    return float(a / scale), float(b - a * mid / scale)


def classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float, float] | None:
    """The model fitted on at most MAX_TRAIN labelled documents; one row of weights comes to the driver."""
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = y.orderBy(F.xxhash64("id"), "id").limit(MAX_TRAIN)  # so many rows at most are broadcast
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, y, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, value = sparse(text or "")
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (index, value)]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([y], pa.int32()), pa.array([tie], pa.int64()), *lists], names=["id", "y", "tie", "index", "value"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((i, y, index.values.to_numpy(), value.values.to_numpy()) for b in batches for i, y, index, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)), key=lambda x: x[0])
        model = fit([(i, v) for _, _, i, v in found], np.array([y for _, y, _, _ in found], float)) if found else None
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model[0].tobytes()]), pa.array([model[1]]), pa.array([model[2]])], names=["weights", "slope", "intercept"])

    rows = labelled.select(F.col("id").cast("string").alias("id"), "y", F.xxhash64("text").alias("tie"), "text")
    rows = rows.mapInArrow(tidy(made), "id string, y int, tie long, index array<int>, value array<float>")
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min_by(F.struct("index", "value"), "tie").alias("f")).select("id", "y", "f.*")
    got = rows.repartition(1).mapInArrow(tidy(train), "weights binary, slope double, intercept double").collect()
    return (np.frombuffer(bytes(got[0]["weights"]), np.float32), got[0]["slope"], got[0]["intercept"]) if got else None


BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(model):
    """Counts, base_failed, probability and kept of each text of an Arrow column, chunk by chunk."""

    def run(column: pa.Array):
        for i, j, w in word_chunks(column):
            data, offsets = buffers(column)
            offsets = offsets[i : j + 1]
            c = base_counts(w, offsets - offsets[0])
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])
            chance = _sigmoid(model[1] * raw_scores(model[0], data, offsets) + model[2]) if model else np.ones(j - i)
            yield i, j, c, failed, chance, ~failed & (chance >= MIN_PROBABILITY)

    return run


def quality(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and probability."""
    judge = _judged(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, c, failed, chance, kept in judge(batch.column(1)):
                counts = [pa.array(c[k].astype(np.int64)) for k in ("n_words", *BASE)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *counts, pa.array(failed), pa.array(kept), pa.array(chance)], names=names)

    names = [id_col, "n_words", *BASE, "base_failed", "kept", "probability"]
    source = df.select(F.col(id_col), F.col(text_col))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in ("n_words", *BASE)) + ", base_failed boolean, kept boolean, probability double")


def only_kept(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of df that quality keeps, with all their columns."""
    judge = _judged(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [k for *_, k in judge(batch.column(batch.schema.get_field_index(text_col)))]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return df.mapInArrow(tidy(run), df.schema)
