import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import raster as R
from quire.plans import catalog as C, search as S
from quire.plans.blocks import BlockIndex
from quire.plans.search import SearchEngine
from quire.sources import archives, entries as E, files, stores, versions


def test_files_of_a_catalog(spark, tmp_path):
    titles = spark.createDataFrame([("knot theory", 0), ("a" * 59 + "é", 1), ("the knot", 3)], "title_norm string, article_id long")
    index = titles.selectExpr("title_norm AS title_key", "article_id", "article_id * 10 AS offset", "4000000000L AS length")
    path = lambda n: str(tmp_path / n)
    made = index.select("title_key", "article_id", files.index_record("title_key", "article_id", "offset", "length").alias("record"))
    assert files.write_records(made, ["title_key", "article_id"], path("index.bin")) == 3
    raw = (tmp_path / "index.bin").read_bytes()
    assert len(raw) == 240 and raw[:60] == b"a" * 59 + b"\xef" and struct.unpack_from("<III8s", raw, 60) == (1, 10, 4000000000, b"\0" * 8)
    assert [(r["pos"], r["title_key"], r["article_id"], r["length"]) for r in files.index_rows(spark, path("index.bin")).orderBy("pos").collect()] == [(0, "a" * 59 + "�", 1, 4000000000), (1, "knot theory", 0, 4000000000), (2, "the knot", 3, 4000000000)]
    words = C.word_index(titles)
    files.write_words(words, path("words.bin"))
    got = {r["word"]: r["article_ids"] for r in files.word_rows(spark, path("words.bin")).collect()}
    assert got == {r["word"]: r["article_ids"] for r in words.collect()} and got["knot"] == [0, 3]
    places = spark.createDataFrame([(0, 0, 0, 5), (2, 1, 0, 7)], "id long, chunk_id long, offset long, length long")
    dense = C.id_index(places)
    files.write_records(dense.select("article_id", files.place_record("chunk_id", "offset", "length").alias("record")), ["article_id"], path("ids.bin"))
    assert sorted(map(tuple, files.place_rows(spark, path("ids.bin")).collect())) == [(0, 0, 0, 5), (1, 0, 0, 0), (2, 1, 0, 7)]
    shown = C.title_index(titles)
    files.write_records(shown.select("article_id", files.title_record("title31").alias("record")), ["article_id"], path("titles.bin"))
    assert [r["title31"] for r in files.title_rows(spark, path("titles.bin")).orderBy("article_id").collect()] == ["knot theory", "a" * 31, "the knot"]
    assert [bytes(r[0]) for r in index.orderBy("title_key").select(files.sparse_record("title_key")).collect()][1] == b"knot theory\0"
    meta = spark.createDataFrame([("b", "x=y"), ("a", "1")], "key string, value string")
    files.write_metadata(meta, path("meta.txt"))
    assert (tmp_path / "meta.txt").read_text() == "a=1\nb=x=y\n" and E.metadata(spark, path("meta.txt")).count() == 2
    assert files.as_json(meta.limit(1)).first()["json"].startswith("{")


def test_pictures_of_a_build(spark, tmp_path):
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:300, 0:500]
    photo = np.stack([x % 256, y % 256, (x + y) % 256], 2).astype(np.uint8)
    plain = np.zeros((60, 80, 3), np.uint8)
    noisy = rng.integers(0, 256, (60, 80, 3)).astype(np.uint8)
    rows = [
        (5, "I/photo.jpg", "image/jpeg", False, R.jpeg_encode(photo)), (2, "I/plain.png", "image/png", False, R.png_encode(plain)), (3, "I/tiny.png", "image/png", False, R.png_encode(plain[:40])),
        (4, "_mw_/x.png", "image/png", False, R.png_encode(plain)), (6, "I/broken.jpg", "image/jpeg", False, b"\xff\xd8\xff"), (7, "I/noisy.jpg", "image/jpeg", False, R.jpeg_encode(noisy, 100)), (8, "I/none.png", "image/png", False, None), (9, "I/p.jpg", "image/jpeg", True, R.jpeg_encode(plain)),
    ]
    df = spark.createDataFrame([(*r[:4], None if r[4] is None else bytearray(r[4])) for r in rows], "entry_id long, path string, mimetype string, is_redirect boolean, content binary")
    builder, path = C.CatalogBuilder(image_chunk_bytes=4000), str(tmp_path / "c")
    builder.write_images(df, path)
    got = {r["path"]: r for r in versions.table(spark, path, "images").collect()}
    assert {p: (r["img_id"], r["w"], r["h"], r["diagram"]) for p, r in got.items()} == {"I/plain.png": (0, 80, 60, True), "I/photo.jpg": (1, 320, 192, False), "I/noisy.jpg": (2, 80, 60, False)}
    assert bytes(got["I/plain.png"]["data"][:4]) == b"qoif" and bytes(got["I/photo.jpg"]["data"][:2]) == b"\xff\xd8"
    assert np.abs(R.pixels_of(bytes(got["I/noisy.jpg"]["data"]))[:, :, :3].astype(int) - noisy).mean() < 12
    places = versions.table(spark, path, "image_places")
    meta = {r["key"]: r["value"] for r in versions.table(spark, path, "image_meta").collect()}
    assert meta["image_count"] == "3" and meta["chunk_size"] == "4000"
    folder = str(tmp_path / "files")
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / f"img_{int(meta['chunk_count']):04d}.dat").write_bytes(b"stale")
    blobs = versions.table(spark, path, "images").join(places, "img_id").select("chunk_id", "offset", "data")
    assert files.write_chunks(blobs, folder, "img") == int(meta["chunk_count"])
    assert len(list((tmp_path / "files").glob("img_*.dat"))) == int(meta["chunk_count"])
    assert not list((tmp_path / "files").glob("_staging*"))
    back = files.read_places(places, folder, "img", "img_id").collect()
    assert {r["img_id"]: bytes(r["data"]) for r in back} == {r["img_id"]: bytes(r["data"]) for r in got.values()}
    assert S.image(versions.table(spark, path, "images"), 1).first()["img_id"] == 1 and S.image(versions.table(spark, path, "images"), 9).count() == 0


def test_parts_of_a_build(spark, tmp_path):
    rows = [(k, f"A/t{k}", f"title number {k}", False, "text/html", bytearray(f"<p>{k} {'x' * (k * 7 % 90)}</p>".encode())) for k in range(40)]
    entries = spark.createDataFrame(rows, "entry_id long, path string, title string, is_redirect boolean, mimetype string, content binary")
    path, builder = str(tmp_path / "c"), C.CatalogBuilder(chunk_bytes=300, with_images=False)
    builder.write(entries, path)
    made = C.load(spark, path)
    assert made.index.count() == 40
    chunks = made.articles.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("offset", "data"))).alias("p")).select("chunk_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("content"))
    assert S.article_at(chunks, made.ids, 17).first()["html"] == f"<p>17 {'x' * 29}</p>" and S.article_at(chunks, made.ids, 400).count() == 0
    assert files.write_chunks(made.articles, str(tmp_path / "dat"), "data") == made.articles.agg(F.max("chunk_id")).first()[0] + 1
    assert S.article_in_files(made.ids, str(tmp_path / "dat"), "data", 17).first()["html"] == f"<p>17 {'x' * 29}</p>" and S.article_in_files(made.ids, str(tmp_path / "dat"), "data", 400).count() == 0
    words = sorted(map(str, made.words.collect()))
    gone = versions.Build(spark, path)
    gone.keep(spark.createDataFrame([("gone", [1], 1, 0)], "word string, article_ids array<long>, ids_count int, ids_start long"), "words")
    gone.publish()
    assert [r["word"] for r in C.load(spark, path).words.collect()] == ["gone"]
    builder.write_words(spark, path)
    assert sorted(map(str, C.load(spark, path).words.collect())) == words
    counts = C.counters(made.titles, made.articles, versions.table(spark, path, "places")).first()
    assert (counts["titles"], counts["written"], counts["skipped"]) == (40, 40, 0) and counts["chunks"] > 1


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    folder = str(tmp_path / "f")
    rows = spark.range(40).select((F.col("id") % 4).alias("chunk_id"), F.col("id").alias("offset"), F.lit(b"old").alias("data"))
    assert files.write_chunks(rows, folder, "c") == 4
    bad = F.udf(lambda k: b"new" if k < 30 else 1 / 0, "binary")
    with pytest.raises(Exception):
        files.write_chunks(rows.withColumn("data", bad("offset")), folder, "c")
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == [f"c_{k:04d}.dat" for k in range(4)]
    assert all(p.read_bytes() == b"old" * 10 for p in (tmp_path / "f").iterdir())
    assert files.write_chunks(rows.where("chunk_id = 1 and offset > 0").withColumn("data", F.lit(b"n")), folder, "c") == 2
    assert {p.name: p.read_bytes() for p in (tmp_path / "f").iterdir()} == {"c_0000.dat": b"", "c_0001.dat": b"n" * 10}
    with pytest.raises(Exception, match="several tasks"):
        stores.write_parts(rows.repartition(3).select(F.lit(0).cast("long").alias("part"), "data"), folder, stem="c")
    assert files.write_chunks(rows.limit(0), folder, "c") == 0 and not list((tmp_path / "f").iterdir())


def test_records_by_ranges(spark, tmp_path):
    data = np.arange(1000, dtype="<u4")
    (tmp_path / "r.bin").write_bytes(b"head" + data.tobytes() + b"xy")
    want = [(k, int(k).to_bytes(4, "little")) for k in range(1000)]
    for parts in (1, 3, 2000):
        df = files.fixed_records(spark, str(tmp_path / "r.bin"), 4, head=4, parts=parts)
        assert sorted((r["pos"], bytes(r["record"])) for r in df.collect()) == want
        assert df.rdd.getNumPartitions() == min(parts, 1000)
    assert files.fixed_records(spark, str(tmp_path / "r.bin"), 4, head=4, count=7, parts=3).count() == 7
    (tmp_path / "e.bin").write_bytes(b"")
    assert files.fixed_records(spark, str(tmp_path / "e.bin"), 4, parts=3).count() == 0


def test_only_asked_bytes_are_read():
    class File:
        def __init__(self, path):
            opened.append(path)

        def size(self):
            return 10**9

        def read_at(self, n, at):
            read.append(n)
            return bytes(n)

        def close(self):
            pass

    opened, read = [], []
    rows = [(k, f"c{k // 10}", 10**7 * k, 3) for k in range(30)] + [(99, "c9", 10**9, 1), (100, "c9", 0, 0)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a : a + 7])], names=["key", "path", "offset", "length"]) for a in range(0, len(rows), 7)]
    got = [k for b in stores._ranged(iter(batches), File) for k in b.column(0).to_pylist()]
    assert got == [*range(30), 100] and opened == ["c0", "c1", "c2", "c9"] and sum(read) == 90


def test_archives(spark, tmp_path):
    rows = [(f"A/t{k}", f"title {k}" if k % 3 else "", k == 7, "text/html", f"<p>{k}".encode() * k) for k in range(20)] + [("-/s.css", "", False, "text/css", b""), ("main", "M", False, "text/html", b"x" * 5000), ("A/" + "long" * 3000, "é", False, "text/html", b"y")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.zim").write_bytes(archives.packed(rows[:12], cluster_bytes=30))
    (tmp_path / "a" / "two.zim").write_bytes(archives.packed(rows[12:]))
    got = archives.archive_entries(spark, str(tmp_path / "a"), entries_of_task=5).collect()
    want = {p: (t or p.removeprefix("A/").removeprefix("-/"), r, None if r else m, None if r else c) for p, t, r, m, c in rows}
    assert {r["path"]: (r["title"], r["is_redirect"], r["mimetype"], None if r["content"] is None else bytes(r["content"])) for r in got} == want
    assert sorted(r["entry_id"] for r in got) == list(range(len(rows)))
    assert archives.archive_entries(spark, str(tmp_path / "a"), "path string").where("path like 'A/%'").count() == 21
    whole = bytearray((tmp_path / "a" / "one.zim").read_bytes())
    whole[-40:] = bytes(40)  # the last clusters are broken
    (tmp_path / "b.zim").write_bytes(whole)
    columns = "entry_id long, path string, content binary"
    read = archives.archive_entries(spark, str(tmp_path / "b.zim"), columns).count()
    faults = archives.archive_entries(spark, str(tmp_path / "b.zim"), columns + ", error string").where("error is not null").count()
    assert 0 < read < 12 and read + faults == 12
    (tmp_path / "c.zim").write_bytes(archives.packed([]))
    assert archives.archive_entries(spark, str(tmp_path / "c.zim")).count() == 0
    for data in (lambda b: archives.lzma.compress(b), lambda b: b):  # other compressions, and 64-bit bounds
        kind = archives.XZ if data(b"a") != b"a" else 1
        bounds = struct.pack("<3Q", 24, 25, 27)
        made = archives.packed([("A/x", "", False, "m", b""), ("A/y", "", False, "m", b"")])
        head = list(struct.unpack_from(archives.HEADER, made))
        begin = struct.unpack_from("<Q", made, head[8])[0]
        made = made[:begin] + bytes([kind | archives.WIDE]) + data(bounds + b"abc")
        head[-1] = len(made)
        (tmp_path / "d.zim").write_bytes(struct.pack(archives.HEADER, *head) + made[80:])
        assert [bytes(r["content"]) for r in archives.archive_entries(spark, str(tmp_path / "d.zim")).orderBy("path").collect()] == [b"a", b"bc"]


def test_a_failed_build_leaves_the_old_catalog(spark, tmp_path, monkeypatch):
    entries = lambda n: spark.createDataFrame([(k, f"A/t{k}", f"title number {k}", False, "text/html", bytearray(b"<p>x")) for k in range(n)], "entry_id long, path string, title string, is_redirect boolean, mimetype string, content binary")
    path, builder = str(tmp_path / "c"), C.CatalogBuilder(with_images=False)
    assert versions.current(spark, path) == {}
    builder.write(entries(5), path)
    before = versions.current(spark, path)
    monkeypatch.setattr(C, "sparse_index", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        builder.write(entries(9), path)
    assert versions.current(spark, path) == before and C.load(spark, path).index.count() == C.load(spark, path).titles.count() == 5
    monkeypatch.undo()
    builder.write(entries(7), path)
    assert C.load(spark, path).index.count() == 7
    assert len(versions.vacuum(spark, path, keep=1)) == 2 and C.load(spark, path).words.count() > 0
    one, two = versions.Build(spark, path), versions.Build(spark, path)
    for b in (one, two):
        b.keep(spark.range(3), "extra")
    one.publish()
    monkeypatch.setattr(versions, "_numbers", lambda *_: [1])  # as two saw it before
    with pytest.raises(RuntimeError, match="another build"):
        two.publish()


def test_blocks_are_pruned_and_made_anew_when_stale(spark, tmp_path):
    path = str(tmp_path / "c")

    def publish(n):
        build = versions.Build(spark, path)
        build.keep(spark.createDataFrame([(f"{k:04d} knot{k % 7}", k) for k in range(n)], "title_key string, article_id long"), "index")
        build.publish()

    publish(200)
    first = BlockIndex.opened(spark, path, 4, 5)
    assert first.rebuilt and not BlockIndex.opened(spark, path, 4, 5).rebuilt and first.sparse.count() == 50
    found = first.contains("knot3", 4)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    every = SearchEngine(first.blocks.select("title_key", "article_id")).contains_by_blocks("knot3", first.sparse.withColumnRenamed("block", "pos"), first.blocks.select("title_key", "article_id", "pos"), 4, 4)
    assert found.collect() == every.collect() and found.count() > 0
    assert BlockIndex.opened(spark, path, 8, 5).rebuilt  # other sizes
    publish(300)
    again = BlockIndex.opened(spark, path, 8, 5)
    assert again.rebuilt and again.blocks.count() == 300 and versions.table(spark, path, "index").count() == 300
