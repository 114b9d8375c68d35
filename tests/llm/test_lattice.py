import numpy as np
import pyarrow.parquet as pq
import pytest

from quire.llm import lattice
from quire.llm.queries import op2_lattice_near_dedup
from tests.llm.test_minhash import components


def brute_force(ids, vectors, cosine=0.95):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    comp = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(linked)), strict=True)])
    return sorted((i, int(n), comp[i], comp[i] == i) for i, n in zip(ids, linked.sum(axis=1), strict=True))


def test_e8_decoder_finds_the_nearest_point():
    x = np.random.default_rng(3).normal(size=(300, 8)) * 2
    got = lattice.nearest_e8(x)
    away = lambda p: ((x[:, None] - p / 2) ** 2).sum(-1)
    own, near = away(got[:, None]), away(got[:, None] + lattice.minimal_vectors()[None])
    assert len(lattice.minimal_vectors()) == 240 and (own <= near.min(axis=1, keepdims=True) + 1e-9).all()
    assert ((got & 1).sum(axis=1) % 8 == 0).all() and (got.sum(axis=1) % 4 == 0).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_whole_table(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    got = sorted(map(tuple, op2_lattice_near_dedup(spark, f"/root/testdata/{sf}").collect()))
    assert got == brute_force(t["vec_id"].to_pylist(), t["embedding"].to_pylist())


def test_pairs_at_the_threshold_are_found(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r = rng.normal(size=(300, 64))
    r -= (r * a).sum(1)[:, None] * a
    r /= np.linalg.norm(r, axis=1)[:, None]
    cos = np.linspace(0.952, 0.999, 300)[:, None]
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * r])
    df = spark.createDataFrame([(k, v.tolist(), 7) for k, v in enumerate(x)], "vec_id long, embedding array<double>, cid int")
    got = sorted(map(tuple, lattice.near_vectors(df).collect()))
    want = brute_force(list(range(600)), x)
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TILE", 3)
    v, w = [1.0] * 8, [1.0] * 7 + [1.01]
    bad = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 9]
    rows = [(k, x) for k, x in enumerate([v, v, w, [-1.0] * 8, *bad])] + [(20, v), (20, w), (None, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(df).collect()), key=str)
    want = [(0, 5, 0, True), (1, 5, 0, False), (2, 5, 0, False), (3, 0, 3, True)] + [(4 + k, 0, 4 + k, True) for k in range(7)] + [(20, 5, 0, False)] * 2 + [(None, 5, None, True)]
    assert got == sorted(want, key=str)
    assert lattice.near_vectors(df.limit(0)).count() == 0
