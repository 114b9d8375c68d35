import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from quire.llm.queries import op1_substring_dedup
from quire.llm.substrings import cut_repeats, without_repeats


def brute_force(texts, size):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in docs for i in range(len(w) - size + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def frame(spark, texts):
    rows = [(i, t, "a", 1, 2, [0]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, k1 string, first int, marks int, windows array<int>")


@pytest.mark.parametrize("size,gram,words", [(7, 3, 3), (12, 4, 2), (12, 12, 4), (35, 8, 6)])
def test_equals_brute_force(spark, size, gram, words):
    rnd = random.Random(size)
    shared = [" ".join(rnd.choices("abcdef"[:words], k=n)) for n in (size, size + 1, size * 2, size - 1, size * 3)]
    texts = [None, "", " \t\n", "a " * 200, "é x\x0by"]
    for _ in range(60):
        parts = [rnd.choice([rnd.choice(shared), " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 40)))]) for _ in range(rnd.randrange(1, 5))]
        texts.append(rnd.choice([" ", "\n"]).join(parts))
    texts += [texts[10]] * 3 + [texts[11] + " tail"]
    got = without_repeats(frame(spark, texts), size, gram).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in got] == brute_force(texts, size)
    for r in got:
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"] and all(b - a >= size for a, b in r["spans"])


def test_whole_table(spark, tiny):
    docs = pq.read_table(f"{tiny}/documents.parquet").sort_by("doc_id").to_pylist()
    want = brute_force([d["text"] for d in docs], 35)
    got = op1_substring_dedup(spark, tiny).orderBy("doc_id").collect()
    assert sum(n for _, n, _ in want) > 0
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == [(n, m, hashlib.sha256(t.encode()).hexdigest()) for n, m, t in want]


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(map(str, range(10)))
    df = spark.createDataFrame([(1, text), (1, text), (None, "own words " * 2), (2, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in without_repeats(df, 5, 2).collect())
    assert got == Counter({(1, 10, 10, ""): 2, (None, 4, 0, "own words own words"): 1, (2, 0, 0, ""): 1})
    assert without_repeats(df.limit(0), 5, 2).count() == 0


def test_cut_keeps_columns_and_white_space(spark):
    shared = " ".join(f"s{i}" for i in range(6))
    df = spark.createDataFrame([(1, f"one\n{shared}  two\n", "x", 5), (2, f"{shared}\nthree", "y", 5), (3, None, None, None)], "doc_id long, text string, marks string, n_chars long")
    got = cut_repeats(df, 6, 2).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "one\ntwo\n", "x", 8), (2, "three", "y", 5), (3, None, None, None)]


def test_alike_rows_hot_anchors_and_columns_that_clash(spark):
    rnd = random.Random(3)
    line = " ".join(f"h{i}" for i in range(22))  # holds an anchor that most texts share, and no match by itself
    texts = [f"{rnd.choice('ab')} l{rnd.randrange(3)} {line} r{rnd.randrange(3)} " + " ".join(f"x{rnd.randrange(5)}" for _ in range(20)) for _ in range(300)]
    texts += [" ".join(f"u{k}" for k in range(90))] * 2
    rows = [(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)] + [(7, texts[7], "x", 1, 2, "y")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, n int, anchor int, s1 string")
    want = brute_force([r[1] for r in rows], 35)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in without_repeats(df).collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert sum(m for _, m, _ in want) > 0
    cut = cut_repeats(df, length_col=None)
    assert cut.columns == df.columns
    assert Counter((r["doc_id"], " ".join(r["text"].split())) for r in cut.collect()) == Counter((r[0], w[2]) for r, w in zip(rows, want, strict=True))


def test_nothing_is_left_in_the_folder(spark):
    import os

    from quire.llm.tables import scratch

    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")
    with scratch(spark) as folder:
        assert sum(r["n_removed"] for r in without_repeats(df).collect()) == 100
        assert os.path.isdir(folder.removeprefix("file://"))
    assert not os.path.exists(folder.removeprefix("file://"))
