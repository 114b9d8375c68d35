import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from quire import registry
from quire.operators import joins, ordering
from quire.plans import catalog as C, search as S
from quire.sources import entries as E
from quire.sources.stores import fixed_records
from quire.streaming import gestures, logs, navigation, ordered, screens

PAGE = "<html><head><title>{0}</title></head><body><p>{0} <a href='x'>q</a> <a href=\"{1}\">l</a></p></body></html>"


def entry_rows():
    rows = [
        (0, "A/Knot", "Knot", False, "text/html; charset=utf-8", PAGE.format("Knot", "Foo_Bar#part")),
        (1, "a/foo", "Foo  Bar", False, "text/html", PAGE.format("Foo", "Knot")),
        (2, "B/knot", "Other", False, "text/html", "rejected"),
        (3, "-/style", "Style", False, "text/html", "rejected"),
        (4, "_meta", "Meta", False, "text/html", "rejected"),
        (5, "bare", "foo bar", False, "text/html", "second of its title"),
        (6, "A/pic", "Pic", False, "image/png", "rejected"),
        (7, "A/redirect", "Red", True, "text/html", "rejected"),
        (8, "A/Caf%C3%A9", "", False, "text/html", "decoded in one pass only"),
        (9, "A/Plain_title", "", False, "text/html", PAGE.format("Plain", "Nowhere")),
        (10, "A/none", " ", False, "text/html", "no title"),
        (11, "A/empty", "Empty entry", False, "text/html", ""),
    ]
    return [(*r[:5], bytearray(r[5].encode())) for r in rows]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(entry_rows(), "entry_id long, path string, title string, is_redirect boolean, mimetype string, content binary")


def test_title_map(entries):
    got = {r["title_norm"]: (r["article_id"], r["entry_id"]) for r in C.title_map(entries).collect()}
    assert got == {"knot": (0, 0), "foo bar": (1, 1), "café": (2, 8), "plain title": (3, 9), "empty entry": (4, 11)}
    assert C.title_map(entries, limit=2).count() == 2 and C.title_map(entries.limit(0)).count() == 0


def test_build_write_load_and_read(spark, entries, tmp_path):
    path = str(tmp_path / "catalog")
    C.CatalogBuilder(block_bytes=40, chunk_bytes=200, sparse_step=2, name="wikipedia_en_all_maxi_2026-05.zim").write(entries, path)
    made = C.load(spark, path)
    assert S.full_article(made.articles, 0).first()["html"] == '<body><p>Knot q <a href="/wiki/1">l</a></p></body>'
    assert S.full_article(made.articles, 3).first()["html"] == "<body><p>Plain q l</p></body>"  # unknown targets are unwrapped
    assert S.full_article(made.articles, 2).count() == 0  # a hole: the second pass does not decode the path
    assert S.article_block(made.articles, 0, 0).first()["num_blocks"] == 2 and S.article_block(made.articles, 0, 2).count() == 0 and S.article_block(made.articles, 99, 0).count() == 0
    assert S.full_article(made.articles, 4).first()["html"] == "" and S.article_block(made.articles, 4, 0).count() == 0
    ids = {r["article_id"]: (r["chunk_id"], r["offset"], r["length"]) for r in made.ids.collect()}
    assert sorted(ids) == [0, 1, 2, 3, 4] and ids[2] == (0, 0, 0) and ids[0][:2] == (0, 0)
    meta = {r["key"]: r["value"] for r in made.meta.collect()}
    assert meta["article_count"] == "4" and meta["db_name"] == "English: All Maxi May 2026" and meta["sparse_step"] == "2"
    assert E.catalog_settings(made.meta).first()["article_count"] == 4
    engine = S.SearchEngine(made.index, made.words, made.title31)
    assert [r["title"] for r in engine.prefix("FOO").collect()] == ["foo bar"] and engine.prefix("").count() == 0 and engine.prefix("x" * 61).count() == 0
    assert [r["article_id"] for r in engine.contains("bar").collect()] == [1] and engine.contains("the").count() == 0 and engine.contains("it's").count() == 0
    assert [tuple(r)[:3] for r in engine.go("knot").collect()] == [(0, 1, 0)] and [(r["section"], r["article_id"] is None) for r in engine.go("title").orderBy("section").collect()] == [(1, True), (2, False)]
    assert engine.exact("Knot").first()["article_id"] == 0 and engine.exact("é").count() == 0
    assert [r["section"] for r in engine.desktop("o").collect()] == [1, 1] and engine.info("n").first()["article_count"] == 4
    assert S.SearchEngine(made.index, device_compat=True).exact("Foo  Bar").count() == 0 and engine.exact("Foo  Bar").count() == 1
    assert made.images.count() == 0
    assert "StringStartsWith(title_key,foo)" in engine.prefix("Foo")._jdf.queryExecution().executedPlan().toString()


def test_colliding_and_cut_titles(spark):
    titles = spark.createDataFrame([("a" * 60 + "x", 0), ("a" * 60 + "y", 1), ("b" * 25 + " endword", 2)], "title_norm string, article_id long")
    index = titles.select(F.substring("title_norm", 1, 60).alias("title_key"), "article_id")
    engine = S.SearchEngine(index, C.word_index(titles), C.title_index(titles))
    assert engine.exact("a" * 60).first()["article_id"] == 0
    assert engine.contains("endword").count() == 0  # it runs past the 31st byte
    assert [r["title"] for r in engine.contains("b endw").collect()] == []


def test_posting_cap_comes_before_the_filter(spark):
    pairs = spark.range(501).select(F.lit("word").alias("word"), F.col("id").alias("article_id"))
    row = C.listed_postings(pairs, 500).first()
    assert row["ids_count"] == 500 and row["article_ids"][-1] == 499 and row["ids_start"] == 0


def python_chunks(lengths, limit):
    chunk = offset = 0
    out = []
    for n in lengths:
        if offset + n > limit:
            chunk, offset = chunk + 1, 0
        out.append((chunk, offset))
        offset += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.lists(st.integers(0, 40), max_size=6), st.lists(st.integers(0, 40), max_size=6), st.integers(1, 25))
def test_chunks_from_range_to_range(lengths, cuts, batches, limit):
    """What the ranges' steps say equals a walk over all blobs, wherever ranges and the batches of a range begin."""
    bounds = [0, *sorted(min(c, len(lengths)) for c in cuts), len(lengths)]
    reach, chunk, out = limit, 0, []
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        parts = [np.array(x, np.int64) for x in np.split(lengths[a:b], sorted({min(max(k - a, 0), b - a) for k in batches}))]
        places, run = ordering._Places(limit, reach, chunk), ordering._Summary(limit)
        for part in parts:
            which, offset = places.take(part)
            out += zip(which.tolist(), offset.tolist())
            run.take(part)
        if reach >= run.total:
            reach -= run.total
        else:
            low, then, count = [s for s in run.steps() if s[0] <= reach][-1]
            reach, chunk = then, chunk + count
        assert (places.reach - run.total, places.chunk) == (reach, chunk)
    assert out == python_chunks(lengths, limit)


def test_chunks(spark):
    rnd = np.random.default_rng(3)
    for lengths in ([], [50], [0, 0, 50, 3], rnd.integers(0, 30, 400).tolist()):
        df = spark.createDataFrame(list(enumerate(lengths)), "id long, length long").repartition(3)
        got = [(r["chunk_id"], r["offset"]) for r in ordering.chunked(df, 20).orderBy("id").collect()]
        assert got == python_chunks(lengths, 20)


def test_positions(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "k long").repartition(5)
    assert [(r["k"], r["p"]) for r in ordering.with_position(df, F.col("k"), "p").orderBy("k").collect()] == [(k, k) for k in range(101)]
    words = sorted({f"{a}{b}é" for a in "abé" for b in range(9)} | {"", "a"}, key=str.encode)
    df = spark.createDataFrame([(w, 2) for w in words], "w string, n long").repartition(5)
    assert [r["w"] for r in ordering.with_text_position(df, "w", "p").orderBy("p").collect()] == words
    assert [r["t"] for r in ordering.with_text_running_total(df, "w", "n", "t").orderBy("t").collect()] == [2 * k for k in range(len(words))]
    assert ordering.with_position(df.limit(0), "n", "p").count() == 0


def test_ranges_are_even_whatever_the_keys(spark):
    """Hot prefixes, ids that are hashes, and one key that most rows share."""
    hot = spark.range(4000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("the same beginning "), F.col("id").cast("string"))).otherwise(F.hex("id")).alias("k"), "id")
    hashes = spark.range(4000).select(F.xxhash64("id").alias("k"), "id")
    equal = spark.range(4000).select(F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df in (hot, hashes, equal):
            sizes = [r["count"] for r in ordering.ranged(df, ["k", "id"], "r").groupBy("r").count().collect()]
            assert len(sizes) == 4 and max(sizes) < 2 * 4000 / 4
            placed = ordering.with_position(df, "k", "p", ("id",)).orderBy("k", "id").collect()
            assert [r["p"] for r in placed] == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_picture_names(spark):
    df = spark.createDataFrame([(0, "x/a.png", 1, 1), (1, "y/a.png", 2, 2), (2, "a.png", 3, 3), (3, "x/a.png", 4, 4), (4, "z/b.png", 5, 5), (5, "q/b.png", 6, 6)], "img_id long, path string, w int, h int")
    names = {r["key"]: r["img_id"] for r in joins.image_names(df).collect()}
    assert names == {"x/a.png": 3, "y/a.png": 1, "a.png": 2, "z/b.png": 4, "q/b.png": 5, "b.png": 4}
    src = spark.createDataFrame([(1, "./../y/a.png"), (1, "gone/b.png"), (2, "none")], "k int, src string")
    assert {(r["k"], r["src"]): r["img_id"] for r in joins.resolved_images(src, joins.image_names(df), ["k"]).collect()} == {(1, "./../y/a.png"): 1, (1, "gone/b.png"): 4}


def test_pictures_are_resolved_without_broadcasts(spark, tmp_path):
    """Names repeat, so the file is small, and the candidates of its rows, which are many, once went to the driver."""
    path = str(tmp_path / "pictures")
    spark.range(3000).selectExpr("id AS img_id", "concat('d', id % 7, '/', id % 5, '.png') AS path", "1 AS w", "2 AS h").write.parquet(path)
    images = spark.read.parquet(path)
    sources = images.select(F.col("img_id").alias("k"), F.concat(F.lit("../"), "path").alias("src"))
    names = joins.image_names(images)
    found = joins.resolved_images(sources, names, ["k"])
    for df in (names, found):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    last = {f"d{i % 7}/{i % 5}.png": i for i in range(3000)}
    assert {r["key"]: r["img_id"] for r in names.collect()} == last | {f"{i}.png": i for i in range(5)}
    assert {r["k"]: r["img_id"] for r in found.collect()} == {i: last[f"d{i % 7}/{i % 5}.png"] for i in range(3000)}


def test_sources(spark, tmp_path):
    (tmp_path / "meta.txt").write_text("article_count=3\nextra\ndb_name=a=b\nunknown=1\n")
    meta = E.metadata(spark, str(tmp_path / "meta.txt"))
    assert {r["key"]: r["value"] for r in meta.collect()} == {"article_count": "3", "db_name": "a=b", "unknown": "1"}
    assert tuple(E.catalog_settings(meta).first()) == (3, 64, "a=b") and E.catalog_settings(meta.where("key <> 'article_count'")).count() == 0
    (tmp_path / "r.bin").write_bytes(b"abcdefgh")
    assert [bytes(r["record"]) for r in fixed_records(spark, str(tmp_path / "r.bin"), 3, parts=2).orderBy("pos").collect()] == [b"abc", b"def"]
    assert E.optional_table(spark, str(tmp_path / "nothing"), "a int").count() == 0


# streams


def samples(device, *rows):
    return [(device, ms, down, x, y) for ms, down, x, y in rows]


TOUCHES = [
    *samples("tap", (0, True, 5, 5), (50, True, 6, 6), (100, False, 0, 0)),
    *samples("slow", (0, True, 5, 5), (500, False, 0, 0)),
    *samples("far", (0, True, 5, 5), (20, True, 45, 5), (100, False, 0, 0)),
    *samples("near", (0, True, 5, 5), (20, True, 44, 5), (100, False, 0, 0)),
    *samples("swipe", (0, True, 5, 50), (20, True, 5, 25), (60, False, 0, 0)),
    *samples("less", (0, True, 5, 50), (20, True, 5, 26), (60, False, 0, 0)),
    *samples("hold", (0, True, 5, 5), (499, True, 5, 5), (500, True, 5, 19), (599, True, 5, 19), (600, True, 5, 19), (700, False, 0, 0)),
    *samples("moved", (0, True, 5, 5), (500, True, 5, 20), (600, False, 0, 0)),
    *samples("bounce", (0, True, 5, 5), (10, False, 0, 0), (59, True, 9, 9), (60, True, 8, 8), (90, False, 0, 0)),
]
WANT = {("tap", 100, "TAP", 5, 5, 0), ("near", 100, "TAP", 5, 5, 0), ("swipe", 60, "SWIPE_UP", 0, 0, -25), ("less", 60, "TAP", 5, 50, 0), ("hold", 500, "HOLD", 5, 5, 0), ("hold", 600, "HOLD", 5, 5, 0), ("bounce", 10, "TAP", 5, 5, 0), ("bounce", 90, "TAP", 8, 8, 0)}


def test_gestures(spark):
    df = spark.createDataFrame(TOUCHES, "device string, ts_ms long, pressed boolean, x int, y int")
    assert {tuple(r) for r in gestures.gestures(df).collect()} == WANT


def run_stream(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_streams_equal_batches(spark, tmp_path):
    schema = "device string, ts_ms long, pressed boolean, x int, y int"
    rows = pd.DataFrame(TOUCHES, columns=["device", "ts_ms", "pressed", "x", "y"])
    for k, (lo, hi) in enumerate(((0, 55), (55, 10**9))):
        part = rows[(rows.ts_ms >= lo) & (rows.ts_ms < hi)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "touch"))
        assert len(part) and k < 2
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "touch"))
    assert {tuple(r) for r in run_stream(gestures.stream_gestures(stream), "touches")} == WANT
    actions = [("s", k, a, t) for k, (a, t) in enumerate([("open", 1), ("follow", 2), ("next", None), ("follow", 3), ("back", None), ("image", None), ("back", None), ("tap", None), ("back", None), ("back", None), ("search", None)])]
    spark.createDataFrame(actions, "session string, seq long, action string, article_id long").coalesce(1).write.parquet(str(tmp_path / "nav"))
    stream = spark.readStream.schema("session string, seq long, action string, article_id long").parquet(str(tmp_path / "nav"))
    got = sorted(tuple(r) for r in run_stream(navigation.stream_sessions(stream), "nav"))
    assert got == sorted(tuple(r) for r in navigation.sessions(spark.read.parquet(str(tmp_path / "nav"))).collect())
    assert [(g[3], g[4], g[6]) for g in got] == [("ARTICLE", 1, 0), ("ARTICLE", 2, 1), ("ARTICLE", 2, 1), ("ARTICLE", 3, 2), ("ARTICLE", 2, 1), ("IMAGE", 2, 1), ("IMAGE", 2, 1), ("ARTICLE", 2, 1), ("ARTICLE", 1, 0), ("SEARCH", None, 0), ("SEARCH", None, 0)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("[touch] press\nplain\n")
    assert {tuple(r) for r in run_stream(logs.tail(spark, str(tmp_path / "log")), "lines")} == {("[touch] press", "touch"), ("plain", None)}


def test_streams_in_any_order(spark, tmp_path):
    """Shuffled micro-batches give the batch's result, for gestures and for first-wins results; what comes too late is counted."""
    schema = "device string, ts_ms long, pressed boolean, x int, y int"
    base = 10**8  # times are well above the first watermark, which is 0
    rows = [*((d, base + ms, *r) for d, ms, *r in TOUCHES), ("none", None, True, 1, 1)]
    order = np.random.default_rng(4).permutation(len(rows))
    batches = [[rows[k] for k in order[a::4]] for a in range(4)] + [[("end", base + 10**7, False, 0, 0)], [("tap", base + 5, True, 9, 9), ("end", base + 2 * 10**7, False, 0, 0)], [("tap", base + 6, True, 9, 9)]]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "touch"))
        time.sleep(0.02)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "touch"))
    query = gestures.stream_gestures(stream, idle_ms=5000, delay="1 hour").writeStream.format("memory").queryName("any_order").outputMode("append").start()
    query.processAllAvailable()
    late = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    query.stop()
    assert {(d, ms - base, *r) for d, ms, *r in spark.table("any_order").collect()} == WANT and late == 1
    results = [(k % 7, (k * 37) % 100 // 2, f"v{k}", 1000 + k * 10) for k in range(100)]
    shuffled = [results[k] for k in np.random.default_rng(5).permutation(100)]
    for a in range(4):
        spark.createDataFrame(shuffled[a::4] if a < 3 else [*shuffled[a::4], (99, 0, "end", 10**8)], "k long, o long, v string, ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "first"))
    stream = spark.readStream.schema("k long, o long, v string, ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "first"))
    got = {tuple(r) for r in run_stream(ordered.stream_first_of_each(stream, "k", "o", "ms", 5000, "1 hour"), "first")}
    want = logs.first_of_each(spark.createDataFrame(results, "k long, o long, v string, ms long"), "k", "o")
    assert {(r[0], r[1]) for r in got} == {(r["k"], r["o"]) for r in want.collect()} and len(got) == 7


def test_sessions_in_any_order(spark, tmp_path):
    story = [("open", 1), ("follow", 2), ("next", None), ("follow", 3), ("back", None), ("image", None), ("back", None), ("tap", None), ("back", None), ("back", None), ("search", None)]
    schema = "session string, seq long, action string, article_id long, ts_ms long"
    rows = [(s, k, a, t, 10**8 + 10 * k) for s in ("s", "t") for k, (a, t) in enumerate(story)]
    order = np.random.default_rng(2).permutation(len(rows))
    for part in [*([rows[k] for k in order[a::3]] for a in range(3)), [("end", 0, "open", 1, 2 * 10**8)], [("end", 1, "open", 1, 3 * 10**8)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "nav"))
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "nav"))
    got = sorted((tuple(r) for r in run_stream(navigation.stream_sessions(stream, delay="1 hour"), "any_nav") if r["session"] != "end"), key=str)
    assert got == sorted((tuple(r) for r in navigation.sessions(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_state_of_idle_keys_goes():
    class State:
        exists, hasTimedOut, gone = True, True, False

        def remove(self):
            self.gone = True

    for make, columns in ((gestures.stream_gestures, "device string, ts_ms long, pressed boolean, x int, y int"), (navigation.stream_sessions, "session string, seq long, action string, article_id long")):
        held = {}

        class Frame:
            def where(self, _):
                return self

            def groupBy(self, _):
                return self

            def applyInPandasWithState(self, run, *rest):
                held["run"], held["timeout"] = run, rest[-1]

        make(Frame(), 1000)
        state = State()
        assert list(held["run"](("k",), iter([]), state)) == [] and state.gone and held["timeout"] == "ProcessingTimeTimeout" and columns


def tap(x, y, **more):
    return ("TAP", x, y, 0, more)


def test_screens(spark):
    keys = [tap(30, 40), tap(20, 130), tap(10, 180), tap(30, 150), tap(20, 220), tap(5, 110), tap(5, 220)]  # box, a key, shift, A, numbers, 1, numbers
    story = [
        *keys, tap(300, 180), ("HOLD", 300, 180, 0, {}), tap(40, 100), tap(300, 230, found=30), ("SWIPE_UP", 0, 0, -40, {}), tap(300, 10), tap(50, 100, result_id=7),
        ("SWIPE_UP", 0, 0, -100, {"height": 900}), tap(230, 10, height=900), tap(50, 90, height=900, img_id=3), ("SWIPE_UP", 0, 0, -9, {}), tap(1, 1), tap(50, 90, height=900, link_id=8),
        tap(10, 10), tap(100, 10), tap(10, 10), tap(30, 30), tap(300, 230, found=1, exact_id=9),
    ]
    columns = ("found", "result_id", "exact_id", "height", "img_id", "link_id")
    rows = [("s", k, kind, x, y, dy, *(more.get(c) for c in columns)) for k, (kind, x, y, dy, more) in enumerate(story)]
    df = spark.createDataFrame(rows, "session string, seq long, type string, x int, y int, dy int, found int, result_id long, exact_id long, height int, img_id long, link_id long")
    got = screens.screens(df.repartition(3)).orderBy("seq").collect()
    assert [r["query"] for r in got[:10]] == ["", "q", "q", "qA", "qA", "qA1", "qA1", "qA", "q", "qw"]
    assert [(r["screen"], r["action"], r["article_id"], r["img_id"], r["scroll"], r["depth"]) for r in got[10:]] == [
        ("SEARCH", "search", None, None, 0, 0), ("SEARCH", "scroll", None, None, 2, 0), ("SEARCH", "scroll", None, None, 19, 0), ("ARTICLE", "open", 7, None, 0, 0),
        ("ARTICLE", "scroll", 7, None, 100, 0), ("ARTICLE", "scroll", 7, None, 0, 0), ("IMAGE", "picture", 7, 3, 0, 0), ("IMAGE", "", 7, 3, 0, 0), ("ARTICLE", "close", 7, None, 0, 0), ("ARTICLE", "follow", 8, None, 0, 1),
        ("ARTICLE", "back", 7, None, 0, 0), ("ARTICLE", "", 7, None, 0, 0), ("SEARCH", "back", 7, None, 19, 0), ("SEARCH", "keyboard", 7, None, 19, 0), ("ARTICLE", "open", 9, None, 0, 0),
    ]


def test_history_drops_the_oldest():
    state = ("ARTICLE", 0, 0, [])
    for k in range(1, 40):
        state = navigation.step(state, "follow", k)
    assert len(state[3]) == 30 and state[3][0] == 9


def test_first_of_each_and_samples(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, "c")], "k int, o int, v string")
    assert {(r["k"], r["v"]) for r in logs.first_of_each(df, "k", "o").collect()} == {(1, "a"), (2, "c")}
    raw = spark.createDataFrame([("d", k, k, -k) for k in range(6)], "device string, seq long, x long, y long")
    assert [tuple(r) for r in logs.sampled(raw).collect()] == [("d", 0, 1, -1)]


# the registry against SQL


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_equal_sql(spark, tiny, duck, name):
    df = __spark_entry__.queries()[name](spark, tiny)
    rows, sql = df.collect(), __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda values: repr([round(v, 6) if isinstance(v, float) else v for v in values])
    assert sorted(key([r[c] for c in sorted(columns)]) for r in rows) == sorted(key([r[columns.index(c)] for c in sorted(columns)]) for r in found.fetchall())


def test_links_by_titles_with_a_place_in_them(spark, tmp_path):
    """What is before the "#" of a title may be the title of another page: links lead there, and not back. Titles that can't stand without
    quotes are escaped there."""
    import duckdb

    titles = ["Anre.", "Anre.### x", "to", "# y", "to#", "x#y", "Plain &amp; b = c", "TO#z", "= &quot;8078&quot;", "&quot;8078&quot;", "=", "a\tb\u00a0c", "`d'/"]
    rows = [(k, f"http://x.example/{k}", f"<html><head><title>{t}</title></head><body>b</body></html>") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df = __spark_entry__.queries()["spelt_links"](spark, str(tmp_path))
    found = sorted(tuple(r) for r in df.select("article_id", "links", "id_sum", "shown").collect())
    assert found == sorted(con.execute(__spark_entry__.oracle_sql()["spelt_links"]).fetchall())
    assert [r[1] for r in found] == [6, 0, 6, 0, 0, 0, 6, 0, 6, 6, 6, 6, 6]
    entries = spark.createDataFrame([(0, "A/a", "Anre.", False, "text/html", bytearray()), (1, "A/b", "Anre.### x", False, "text/html", bytearray(b"<a href='Anre.### x'>b</a>"))], "entry_id long, path string, title string, is_redirect boolean, mimetype string, content binary")
    cleaned = C.CatalogBuilder(with_images=False).cleaned(entries, C.title_map(entries))
    assert {r["article_id"]: r["html"] for r in cleaned.collect()}[1] == '<a href="/wiki/0">b</a>'


def test_documents_without_a_first_line_are_no_articles(spark, tmp_path):
    """Their ids are no titles: they would become words, and move the ids of all articles after them."""
    import duckdb

    texts = ["Plain words\nbody", "\nbody words", "", None, " \t\nbody", "Other words", "\r\nbody", "plain  WORDS", "1003 words\n"]
    spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name, columns in (("written_words", ["word", "ids_count", "ids", "ids_start"]), ("title_map_documents", ["title_norm", "article_id", "entry_id"])):
        found = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).select(columns).collect())
        assert found == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert found == [("1003 words", 2, 1008), ("other words", 1, 1005), ("plain words", 0, 1000)]


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["article_id", "title"]
