import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire.llm import components as components_module, minhash
from quire.llm.components import connected_components
from quire.llm.minhash import near_duplicates, one_of_each
from quire.llm.queries import op4_minhash_near_dedup

FOLD = {i: i + 32 for i in range(65, 91)}


def sets_of(texts, k=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def components(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_force(rows, similarity=75):
    sets = sets_of([t for _, t in rows])
    index, edges = defaultdict(list), set()
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    shared = Counter(p for v in index.values() for p in combinations(v, 2))
    for (a, b), n in shared.items():
        if 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            edges.add((rows[a][0], rows[b][0]))
    comp = components([i for i, _ in rows], edges)
    return Counter((i, len(s), comp[i], comp[i] == i) for (i, _), s in zip(rows, sets, strict=True))


def edited(rnd, words, share):
    return " ".join(f"e{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words)


def corpus():
    rnd = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (5, "one Two three"), (6, "É x y z w v"), (7, "é x y z w v")]
    for base in range(6):
        words = [f"b{base}w{k}" for k in range(rnd.choice([12, 60, 300]))]
        for _ in range(40):
            rows.append((len(rows), edited(rnd, words, rnd.choice([0, 0.005, 0.02, 0.04, 0.08]))))
    chain = [f"c{k}" for k in range(100)]
    rows += [(len(rows) + k, " ".join(chain[k * 8 :] + [f"d{j}" for j in range(k * 8)])) for k in range(8)]
    rnd.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, sig string, cid int")
    got = Counter(map(tuple, near_duplicates(df).collect()))
    assert got == brute_force(rows)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{path}/documents.parquet").to_pylist()]
    assert Counter(map(tuple, op4_minhash_near_dedup(spark, path).collect())) == brute_force(rows)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (2, t), (2, "other words that are of no group at all"), (9, None)], "doc_id long, text string")
    got = Counter(map(tuple, near_duplicates(df).collect()))
    assert got == Counter({(None, 3, None, True): 1, (3, 3, 2, False): 2, (2, 3, 2, True): 1, (2, 5, 2, True): 1, (9, 0, 9, True): 1})
    assert near_duplicates(df.limit(0)).count() == 0
    assert one_of_each(df.limit(0)).count() == 0


def test_one_of_each_loses_no_text(spark):
    t, u = "a b c d e f g", "other words that are of no group at all"
    rows = [(None, t, 1), (3, t, 2), (3, t, 3), (2, t, 4), (2, u, 5), (9, None, 6), (9, None, 7), (9, "", 8), (None, u + " x y z w v", 9), (None, None, 10), (8, u + " x y z w v", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted(((r["doc_id"], r["text"]) for r in one_of_each(df.repartition(3)).collect()), key=str)
    assert got == sorted([(2, t), (2, u), (9, None), (9, ""), (None, None), (8, u + " x y z w v")], key=str)
    assert one_of_each(df).columns == df.columns
    assert sorted(map(str, one_of_each(df).collect())) == sorted(map(str, one_of_each(df.repartition(5, "key")).collect()))


@pytest.mark.parametrize("left", [10, 10**6])
def test_components(spark, monkeypatch, left):
    monkeypatch.setattr(components_module, "LEFT", left)
    rnd = random.Random(2)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(500 + k, 501 + k) for k in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = components({x for e in edges for x in e}, edges)
    got = {r["node"]: r["component"] for r in connected_components(df.repartition(7)).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert connected_components(df.limit(0)).count() == 0


def test_odd_sketches_never_overstate_a_difference():
    rnd = np.random.default_rng(6)
    sets = [rnd.choice(5000, rnd.integers(1, 900), replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([s.view(np.int64).tolist() for s in sets])], names=["cid", "shingles"])
    odd = minhash.OddSketches(next(minhash._odd_sketches(iter([batch]))).column(1))
    x, y = np.triu_indices(40, 1)
    got = odd.differing(x, y)
    true = np.array([len(set(sets[a].tolist()) ^ set(sets[b].tolist())) for a, b in zip(x, y, strict=True)])
    assert (got <= true).all() and (odd.differing(x, x) == 0).all()
    even = odd.size[x] == odd.size[y]
    assert got[even].sum() > 0.6 * true[even].sum()
