from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import __spark_entry__
import corpus_pipeline
from quire.llm import packing, secrets
from tests.llm.test_minhash import brute_force as components_of
from tests.llm.test_scans import base_rules
from tests.llm.test_substrings import brute_force as without_repeats
from tests.llm.test_tokens import library_ids


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    """Rows that each stage returned."""
    out, docs = [], spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, tiny).write.parquet(path)
        docs = spark.read.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        out.append([r.asDict() for r in docs.collect()])
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_quality_stage(stages, tiny):
    docs, quality = by_id(pq.read_table(f"{tiny}/documents.parquet").to_pylist()), dict(zip(*[c.to_pylist() for c in pq.read_table(f"{tiny}/labels.parquet", columns=["doc_id", "quality"]).columns], strict=True))
    kept = by_id(stages[0])
    assert all(docs[i] == r for i, r in kept.items())
    for i, d in docs.items():
        assert not (base_rules(d["text"])[-1] and i in kept)
        if quality.get(i) == 1 and not base_rules(d["text"])[-1]:
            assert i in kept


def test_dedup_stages(stages):
    first, second = by_id(stages[0]), by_id(stages[1])
    want = {i for i, _, _, kept in components_of([(i, r["text"]) for i, r in first.items()]) if kept}
    assert set(second) == want and all(first[i] == r for i, r in second.items())
    third = by_id(stages[2])
    ids = sorted(second)
    assert sorted(third) == ids
    for i, (_, _, kept) in zip(ids, without_repeats([second[i]["text"] for i in ids], 35), strict=True):
        assert b" ".join(third[i]["text"].encode().split()).decode() == kept and third[i]["n_chars"] == len(third[i]["text"])


def test_secret_and_packing_stages(stages):
    third, fourth = by_id(stages[2]), by_id(stages[3])
    assert {i: secrets.redact(r["text"]) for i, r in third.items()} == {i: r["text"] for i, r in fourth.items()}
    pieces, bins = defaultdict(int), Counter()
    for r in stages[4]:
        pieces[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]] += r["length"]
    ids = sorted(fourth)
    assert pieces == {i: len(t) + 1 for i, t in zip(ids, library_ids([fourth[i]["text"] for i in ids]), strict=True)}
    assert max(bins.values()) <= 1024
    runs, n = packing.best_fit_decreasing(Counter(r["length"] for r in stages[4]), 1024)
    assert len(bins) == n


def test_run_and_registry(spark, tiny, stages):
    got = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, tiny).collect())
    assert got == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in stages[4])
    names = __spark_entry__.queries()
    assert [next(q for q in names if q.startswith(f"op{n}_")) for n in range(1, 11)] and "pipeline" in names


def test_stages_on_an_empty_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, marks int, `quire marks` int"


def odd_rows():
    own = " ".join(f"o{i}" for i in range(70))
    shared = " ".join(f"s{i}" for i in range(40))
    two = [" ".join(f"{c}{i}" for i in range(60)) for c in "xy"]
    rows = [
        (1, None), (2, ""), (None, None), (3, own), (3, own), (None, own), (4, two[0]), (4, two[1]), (5, f"{two[0]} {shared} tail{5}"), (6, f"{two[1]} {shared} tail"),
        (None, "password=abcdefghijkl12 " + " ".join(f"p{i}" for i in range(60))), (7, " ".join(f"long{i}" for i in range(30_000))),
    ]
    return [(i, t, "en", "web", None if t is None else len(t), "k", 1, 2) for i, t in rows]


def test_stages_on_odd_rows(spark, tiny):
    """Nulls, repeated rows, one id with two texts, a long text and columns whose names the stages use themselves."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, tiny)
    assert kept.columns == docs.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} <= {r[:2] for r in rows if r[1]}
    single = stage["MinHash near-dedup"](spark, docs, tiny)
    assert single.columns == docs.columns
    texts = {r[1] for r in rows}
    want = Counter({(1, None): 1, (2, ""): 1, (None, None): 1} | {(min((r[0] for r in rows if r[1] == t and r[0] is not None), default=None), t): 1 for t in texts if t})
    assert Counter((r["doc_id"], r["text"]) for r in single.collect()) == want
    cut = stage["substring dedup"](spark, docs, tiny)
    assert cut.columns == docs.columns
    left = Counter((r["doc_id"], None if r["text"] is None else " ".join(r["text"].split())) for r in cut.collect())
    assert left == Counter((r[0], None if r[1] is None else w[2]) for r, w in zip(rows, without_repeats([r[1] for r in rows], 35), strict=True))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.collect())
    hidden = stage["secret scans"](spark, docs, tiny)
    assert hidden.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in hidden.collect()) == Counter((r[0], secrets.redact(r[1])) for r in rows)
    pieces = Counter()
    for r in stage["best-fit packing"](spark, docs, tiny).collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == sum((Counter({r[0]: len(library_ids([r[1] or ""])[0]) + 1}) for r in rows), Counter())


def test_run_leaves_nothing(spark, tiny):
    import os

    from quire.llm.tables import scratch

    with scratch(spark) as folder:
        assert corpus_pipeline.run(spark, tiny).count()
    assert not os.path.exists(folder.removeprefix("file://"))
