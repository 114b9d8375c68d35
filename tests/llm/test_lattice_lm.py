import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from quire.llm import lattice_lm as lm
from quire.llm.queries import PIECES, op10_lattice_lm, tokenizer_path
from tests.llm.test_minhash import FOLD

PATH = tokenizer_path(PIECES)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def by_enumeration(lattice, word):
    """Sum over all segmentations, each multiplied out."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        i = lattice.vocab.id_of.get(word[:n], -1)
        if i >= 0 or n == 1:
            total += math.exp(lattice.logp[i] if i >= 0 else lattice.char(word[0])) * by_enumeration(lattice, word[n:])
    return total


def test_marginal_is_the_sum_over_segmentations():
    lattice = lm.Lattice(lm.pieces(PATH), lm.pieces(PATH).first)
    found = ["▁the", "▁nation", "▁été", "▁😀a", "▁", "▁zqx\x01", "▁ununun"]
    assert lattice.walk(found) == pytest.approx([math.log(by_enumeration(lattice, w)) for w in found])


def test_both_ways_of_walking_agree():
    rng = np.random.default_rng(1)
    found = ["▁" + "".join(rng.choice(list("abethions中é"), 7)) for _ in range(40)]
    vocab = lm.pieces(PATH)
    one, many = np.zeros(vocab.size), np.zeros(vocab.size)
    lattice, times = lm.Lattice(vocab, vocab.first), rng.integers(1, 9, 40).astype(float)
    a = [lattice._one(w, one, t) for w, t in zip(found, times, strict=True)]
    b = lattice.walk(found, many, times)
    assert b == pytest.approx(a) and many == pytest.approx(one)
    assert one @ np.array([len(p) for p in [vocab_piece(vocab, i) for i in range(vocab.size)]]) > 0


def vocab_piece(vocab, i):
    if not hasattr(vocab_piece, "texts"):
        vocab_piece.texts = {v: k for k, v in vocab.id_of.items()}
    return vocab_piece.texts.get(i, "")


def brute_force(rows):
    train = [words(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    c["\nend"] = len(train)
    c = +c
    n, v = sum(c.values()), len(c)
    out = Counter()
    for i, t in rows:
        own = [*words(t), "\nend"]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out[(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(c[w] > 0 for w in own), n, round(base, 5))] += 1
    return out


def check(rows, got):
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == brute_force(rows)


def test_whole_table(spark, tiny, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{tiny}/documents.parquet").to_pylist()]
    got = op10_lattice_lm(spark, tiny).collect()
    check(rows, got)
    scores = {r["doc_id"]: r["score"] for r in got}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    again = {r["doc_id"]: r["score"] for r in op10_lattice_lm(spark, tiny).collect()}
    assert again.keys() == scores.keys() and all(again[k] == pytest.approx(v, rel=1e-9) for k, v in scores.items())


def test_fitting_raises_the_likelihood_of_held_out_texts(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    total = lambda n: sum(r["score"] for r in lm.lm_scores(docs, PATH, rounds=n).collect() if r["held_out"])
    assert total(0) < total(1) < total(2)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "The the THE zzz"), (3, "The the THE zzz"), (None, "é the"), (9, "x" * 3000), (10, "the\x0bthe")]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "doc_id long, text string, n int, word string, block int")
    got = lm.lm_scores(df, PATH, rounds=1).collect()
    check(rows, got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.lm_scores(df.limit(0), PATH).count() == 0
    assert lm.lm_scores(df.where("doc_id = 9"), PATH).count() == 1
