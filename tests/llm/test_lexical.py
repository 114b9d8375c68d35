import math
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from quire.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(docs, items, k=50):
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    total, n_docs = sum(n for *_, n in found), len(found)
    df = Counter(t for _, c, _ in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c, n in found:
            m = 50 + (50 * n * n_docs) // total
            s = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def answers(spark, docs, items, k=50):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS item_id", "3 AS n").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 AS rank")
    return sorted(map(tuple, lexical.top_documents(d, q, k=k).collect()), key=str)


@pytest.mark.parametrize("postings", [1 << 21, 300])
def test_whole_table(spark, tiny, monkeypatch, postings):
    monkeypatch.setattr(lexical, "POSTINGS", postings)  # in this process only: tasks get the closure's module
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{tiny}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{tiny}/benchmark.parquet").to_pylist()]
    assert answers(spark, docs, items) == brute_force(docs, items)


def test_blocks_give_what_one_block_gives(tiny):
    """The algorithm itself, over blocks and steps of any size, with the k best carried along."""
    import numpy as np

    rng = np.random.default_rng(5)
    size, n = 40, 600
    counts = rng.integers(1, 20, n)
    terms = np.concatenate([np.sort(rng.choice(size, c, replace=False)) for c in counts])
    impacts = rng.integers(1, 50, len(terms))
    weights = rng.integers(1, 9, size)
    starts = np.cumsum(counts) - counts
    wanted = np.array([1, 5, 7, 30])
    scores = [sum(int(weights[t] * x) for t, x in zip(terms[s : s + c], impacts[s : s + c]) if t in wanted) for s, c in zip(starts, counts)]
    want = [(s, i) for s, i in sorted(((s, i) for i, s in enumerate(scores) if s), key=lambda x: (-x[0], x[1]))[:10]]
    for cuts in ([0, n], [0, 1, 7, 300, n], list(range(0, n + 1, 50))):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for a, b in zip(cuts, cuts[1:]):
            part = slice(starts[a], starts[b - 1] + counts[b - 1])
            held = lexical.Block(np.arange(a, b), counts[a:b], terms[part], impacts[part], size).best(wanted, weights[wanted], held, 10)
        assert list(zip(held[0].tolist(), held[1].tolist())) == want


def test_odd_rows(spark, monkeypatch):
    docs = [(0, None), (1, ""), (2, "... \n"), (3, "Foo bar foo"), (4, "foo"), (5, "BAR é,Éclair"), (5, "BAR é,Éclair"), (None, "foo bar"), (7, "x " * 50_000 + "rare"), (8, "z" * 100_000), (9, "foo"), (10, "q" * 3)]
    items = [(1, "foo, FOO!"), (1, "foo"), (2, None), (3, ""), (4, "nowhere"), (None, "éclair rare É"), (6, "bar " * 1000), (7, "Éclair"), (8, "z" * 100_000 + " x")]
    want = brute_force(docs, items)
    assert answers(spark, docs, items) == want
    monkeypatch.setattr(lexical, "MOST_ITEMS", 2)  # more blocks of queries
    assert answers(spark, docs, items) == want
    assert answers(spark, docs, items, k=2) == brute_force(docs, items, 2)
    assert answers(spark, [], items) == [] and answers(spark, docs, []) == [] and answers(spark, [(1, None)], items) == []
