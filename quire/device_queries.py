"""Queries over formats, pictures and screens of the device, with their SQL; registered beside those of the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import ascii, binary as B, html as H, images as I, raster, text as T
from quire.operators import joins, ordering
from quire.operators.staging import fresh_path, staged
from quire.plans import catalog as C, search as S
from quire.registry import _BLOCKS, _DOCS, _KEYS, _MAP, _NAMES, _PAGES, _PICTURES, _WORDS, _cut, _keys, _listed, _page_entries, _pictures, _titles, query
from quire.sources import archives, entries as E, files
from quire.sources.versions import Build, table


def _pick(values: tuple, number: Column) -> Column:
    """The value that a number, modulo their count, picks."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _sql_pick(values: tuple, number: str) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][({number}) % {len(values)} + 1]"


# entries and settings

_PATHS = ("A/x", "a/x", "B/x", "-/style", "_meta", "x", "A/y/z")
_MIMES = ("text/html", "text/html; charset=utf-8", "image/png", None, "text/htm")


@query(f"""WITH e AS (SELECT doc_id, {_sql_pick(_PATHS, 'doc_id')} AS path, {_sql_pick(_MIMES, 'doc_id // 7')} AS mime, doc_id % 3 = 0 AS redirect FROM documents)
SELECT doc_id, coalesce(NOT redirect AND NOT starts_with(path, '_') AND NOT starts_with(path, '-') AND (NOT contains(path, '/') OR lower(path)[1:2] = 'a/') AND starts_with(mime, 'text/html'), false) AS article FROM e""")
def article_entries(read):
    at = F.col("doc_id")
    return read("documents").select("doc_id", E.is_article_entry(_pick(_PATHS, at), _pick(_MIMES, F.floor(at / 7)), at % 3 == 0).alias("article"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || 'é+' END AS decoded, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || '%C3%A9+' END AS plain FROM part""")
def titles_from_paths(read):
    path = F.concat(F.lit("A/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("%C3%A9+"))
    title = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("")
    return read("part").select("p_partkey", T.title_or_path(title, path).alias("decoded"), T.title_or_path(title, path, decode=False).alias("plain"))


@query(f"WITH {_PICTURES} SELECT entry_id, path FROM pictures WHERE entry_id < 100000 AND regexp_matches(path, '(?i)\\.(png|jpg|svg)$') ORDER BY entry_id LIMIT 5")
def first_images(read):
    return E.first_images(_pictures(read))


@query("""SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(count(*) AS BIGINT) AS article_count, 'a=' || max(n_name) AS db_name FROM nation GROUP BY n_regionkey""")
def stored_settings(read):
    lines = read("nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("n_name").alias("m"))
    texts = F.array(F.concat(F.lit("article_count="), F.col("n").cast("string")), F.lit("no pair"), F.lit("unknown=1"), F.concat(F.lit("db_name=a="), F.col("m")))
    parsed = E.settings_of(lines.select(F.explode(texts).alias("value"), F.col("n_regionkey").cast("long").alias("region")), "region")
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return parsed.groupBy("region").agg(of("article_count").cast("long").alias("article_count"), of("db_name").alias("db_name"))


@query(f"WITH {_DOCS}, {_MAP}, {_KEYS} SELECT article_id, title_key AS title FROM keyed ORDER BY title_key, article_id LIMIT 11 OFFSET 5")
def key_window(read):
    return S.window_of_results(_keys(_titles(read)).select("article_id", F.col("title_key").alias("title")), ["title", "article_id"], 5, 212)


@query(f"""WITH RECURSIVE {_PAGES}, {_MAP}, rows AS (SELECT article_id, octet_length(encode(html)) AS length, row_number() OVER (ORDER BY article_id) AS k FROM titles JOIN pages ON entry_id = page_id WHERE article_id % 5 <> 1),
walk AS (SELECT k, length, CAST(CASE WHEN length > 20000 THEN 1 ELSE 0 END AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS "offset" FROM rows WHERE k = 1
UNION ALL SELECT r.k, r.length, CASE WHEN w."offset" + w.length + r.length > 20000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w."offset" + w.length + r.length > 20000 THEN 0 ELSE w."offset" + w.length END FROM walk w JOIN rows r ON r.k = w.k + 1)
SELECT (SELECT count(*) FROM titles) AS titles, (SELECT count(*) FROM rows) AS written, (SELECT count(*) FROM titles) - (SELECT count(*) FROM rows) AS skipped, CAST((SELECT sum(length) FROM rows) AS BIGINT) AS total_bytes,
(SELECT max(chunk) + 1 FROM walk) AS chunks, CAST((SELECT count(*) FROM rows) // 64 + 1 AS BIGINT) AS sparse_entries""")
def build_counters(read):
    entries = _page_entries(read)
    titles = C.title_map(entries)
    articles = titles.where("article_id % 5 <> 1").join(entries, "entry_id").select("article_id", F.col("content").alias("data"))
    return C.counters(titles, articles, C.CatalogBuilder(chunk_bytes=20000).places(articles))


# articles by block and by place


def _blobs(read) -> DataFrame:
    """Pages as packed articles of small blocks."""
    return read("pages").select(F.col("page_id").alias("article_id"), B.packed_articles(1000)("page_id", F.concat(F.lit("T"), F.col("page_id").cast("string")), "html").alias("data"))


def _whole() -> Column:
    return F.aggregate("a.blocks", F.lit(b""), lambda a, b: F.concat(a, b))


@query(f"WITH RECURSIVE {_BLOCKS}, n AS (SELECT page_id, count(*) AS blocks FROM cut GROUP BY page_id) SELECT page_id AS article_id, 'T' || page_id AS title, 'article' AS kind, CAST(coalesce(blocks, 0) AS INTEGER) AS blocks, md5(html) AS html_md5 FROM pages LEFT JOIN n USING (page_id)")
def article_blobs(read):
    found = _blobs(read).select(B.unpacked_articles("data").alias("a"), B.kind_of("data").alias("kind"))
    return found.select("a.article_id", "a.title", "kind", F.size("a.blocks").alias("blocks"), F.md5(_whole()).alias("html_md5"))


@query("SELECT page_id AS article_id, 'L' || page_id AS title, CASE WHEN html = '' THEN 0 ELSE 1 END AS blocks, md5(html) AS html_md5 FROM pages")
def legacy_blobs(read):
    found = read("pages").select(B.unpacked_articles(B.packed_legacy("page_id", F.concat(F.lit("L"), F.col("page_id").cast("string")), "html")).alias("a"))
    return found.select("a.article_id", "a.title", F.size("a.blocks").alias("blocks"), F.md5(_whole()).alias("html_md5"))


@query("SELECT doc_id, octet_length(encode(text)) AS size, md5(text) AS text_md5 FROM documents")
def lz4_round_trip(read):
    packed = read("documents").select("doc_id", B.compressed("text").alias("c"))
    return packed.select("doc_id", B.little_endian("c", 0, 4).alias("size"), F.md5(B.decompressed("c")).alias("text_md5"))


@query(f"WITH RECURSIVE {_BLOCKS} SELECT page_id AS article_id, 'T' || page_id AS title, block_num, md5(substr(rest, 1, n)) AS hex_md5 FROM cut WHERE (page_id, block_num) IN ((3, 0), (4, 1))")
def block_load(read):
    blobs = _blobs(read)
    asked = [(3, 0), (4, 1), (4, 100_000), (10**12, 0)]  # the last two are out of range
    rows = [S.article_block(blobs, a, b) for a, b in asked]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).select("article_id", "title", "block_num", F.md5(F.hex("data")).alias("hex_md5"))


@query("SELECT page_id AS article_id, md5(html) AS html_md5 FROM pages WHERE page_id IN (5, 6)")
def article_load(read):
    blobs = _blobs(read)
    every = S.full_article(blobs, 5).unionByName(S.full_article(blobs, 6)).unionByName(S.full_article(blobs, 10**12))
    return every.select("article_id", F.md5("html").alias("html_md5"))


@query("SELECT page_id AS id, octet_length(encode(html)) AS length, md5(html) AS html_md5 FROM pages WHERE html <> ''")
def chunk_reads(read):
    """Pages written to chunk files, one task a file, and read back by their places."""
    pages = read("pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("data"))
    places = ordering.chunked(pages.select("id", F.octet_length("data").alias("length")), 20000)
    folder = fresh_path(pages.sparkSession, "chunks")
    files.write_chunks(pages.join(places, "id"), folder, "pages")
    return files.read_places(places, folder, "pages", "id").select("id", F.octet_length("data").cast("long").alias("length"), F.md5("data").alias("html_md5"))


@query(f"""WITH {_DOCS}, {_MAP}, {_WORDS}, ranked AS (SELECT word, article_id, row_number() OVER (PARTITION BY word ORDER BY article_id) AS r FROM postings)
SELECT {_cut("word", 13)} AS word, n, ids_md5 FROM (SELECT word, count(*) AS n, md5(array_to_string(list(article_id ORDER BY article_id), ',')) AS ids_md5 FROM ranked WHERE r <= 500 GROUP BY word)""")
def word_file_reads(read):
    """The word index written to one file by all tasks, and read back: its records by ranges, its lists by place."""
    titles = _titles(read)
    path = f"{fresh_path(titles.sparkSession, 'words')}/words.bin"
    files.write_words(staged(C.word_index(titles), "words"), path)
    return files.word_rows(titles.sparkSession, path).select("word", F.size("article_ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("article_ids", lambda x: x.cast("string")), ",")).alias("ids_md5"))


@query("""SELECT CASE WHEN page_id % 5 = 0 THEN '' ELSE 'A/' END || 'p' || page_id AS path, 'page ' || page_id AS title, page_id % 10 = 3 AS is_redirect,
CASE WHEN page_id % 10 <> 3 THEN 'text/' || (CASE WHEN page_id % 3 = 0 THEN 'plain' ELSE 'html' END) END AS mimetype, CASE WHEN page_id % 10 <> 3 THEN md5(html) END AS content_md5 FROM pages""")
def archive_reads(read):
    """Pages written to a folder of archives by tasks, and read back by ranges of entries."""
    key = F.col("page_id")
    path = F.concat(F.when(key % 5 == 0, F.lit("")).otherwise(F.lit("A/")), F.lit("p"), key.cast("string"))
    mime = F.concat(F.lit("text/"), F.when(key % 3 == 0, F.lit("plain")).otherwise(F.lit("html")))
    made = read("pages").select(key.alias("entry_id"), path.alias("path"), F.concat(F.lit("page "), key.cast("string")).alias("title"), (key % 10 == 3).alias("is_redirect"), mime.alias("mimetype"), F.col("html").cast("binary").alias("content"))
    folder = fresh_path(made.sparkSession, "archives")
    archives.write_archives(made, folder, most_bytes=100_000)
    found = archives.archive_entries(made.sparkSession, folder, entries_of_task=10)
    return found.select("path", "title", "is_redirect", "mimetype", F.md5("content").alias("content_md5"))


# records


def _sql_little(x: str, n: int) -> str:
    return " || ".join(f"substr(printf('%016x', CAST({x} AS BIGINT)), {15 - 2 * k}, 2)" for k in range(n))


@query(f"""WITH {_DOCS}, {_MAP}, {_KEYS} SELECT article_id, upper(rpad(hex(encode(title_key))[:120], 120, '0') || {_sql_little("article_id", 4)} || {_sql_little("article_id * 7", 4)} || {_sql_little("4294967295 - article_id", 4)} || repeat('0', 16)) AS record FROM keyed""")
def index_records(read):
    rows = _keys(_titles(read))
    made = files.index_record("title_key", "article_id", F.col("article_id") * 7, F.lit(4294967295) - F.col("article_id"))
    return rows.select("article_id", F.hex(made).alias("record"))


@query(f"""WITH {_DOCS}, {_MAP}, {_KEYS} SELECT row_number() OVER (ORDER BY title_key, article_id) - 1 AS pos, title_key, article_id, article_id * 7 AS "offset", 4294967295 - article_id AS length FROM keyed""")
def index_reads(read):
    """The index written to one file by all tasks, and read back by ranges of records."""
    rows = _keys(_titles(read))
    made = files.index_record("title_key", "article_id", F.col("article_id") * 7, F.lit(4294967295) - F.col("article_id"))
    path = f"{fresh_path(rows.sparkSession, 'index')}/index.bin"
    files.write_records(rows.select("title_key", "article_id", made.alias("record")), ["title_key", "article_id"], path)
    return files.index_rows(rows.sparkSession, path).select("pos", "title_key", "article_id", "offset", "length")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS little, l_suppkey AS big, CASE l_orderkey % 7 WHEN 0 THEN 'article' WHEN 1 THEN 'legacy' WHEN 2 THEN 'qoi' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'png' ELSE 'unknown' END AS kind FROM lineitem")
def binary_numbers(read):
    magic = _pick((b"WKI2..", b"WIKI", b"qoif", b"\xff\xd8\xff\xe0", b"\x89PNG", b"WK", b""), F.col("l_orderkey"))
    big = F.unhex(F.lpad(F.hex("l_suppkey"), 8, "0"))
    return read("lineitem").select("l_orderkey", "l_linenumber", B.little_endian(files.number("l_partkey", 4), 0, 4).alias("little"), B.big_endian(big, 0, 4).alias("big"), B.kind_of(magic).alias("kind"))


# pictures


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 IN (4, 5) THEN NULL ELSE CAST(s_suppkey % 300 + 1 AS INTEGER) END AS w, CASE WHEN s_suppkey % 7 IN (4, 5) THEN NULL ELSE CAST(s_suppkey % 200 + 1 AS INTEGER) END AS h FROM supplier""")
def picture_headers(read):
    """Sizes by headers: JPEG with a segment of 0 to 64 kB before the frame, two such segments, progressive, none, cut off; QOI, PNG."""
    four = lambda x, n=4: F.lpad(F.hex(x), n, "0")
    n = F.col("s_suppkey") * 331 % 65534
    segment = F.concat(F.lit("FFE1"), four(n + 2), F.repeat(F.lit("AB"), n.cast("int")))
    w, h = F.col("s_suppkey") % 300 + 1, F.col("s_suppkey") % 200 + 1
    frame = lambda m: F.concat(F.lit(f"FF{m}000B08"), four(h), four(w), F.lit("01011100"))
    soi = F.lit("FFD8")
    kinds = (
        F.concat(soi, segment, frame("C0")), F.concat(soi, segment, segment, frame("C2")), F.concat(F.lit("716F6966"), four(w, 8), four(h, 8), F.lit("0300")),
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(w, 8), four(h, 8)), F.concat(soi, segment, F.lit("FFDA000C")), F.concat(soi, segment, F.lit("FFC0000B0800")),
        F.concat(soi, F.lit("FFE00002FFFF"), F.substring(frame("C1"), 3, 99)),
    )
    data = F.unhex(F.element_at(F.array(*kinds), (F.col("s_suppkey") % 7 + 1).cast("int")))
    return read("supplier").select("s_suppkey", B.picture_size(data).alias("p")).select("s_suppkey", "p.w", "p.h")


_PIXEL = "(p_partkey * 7 + i * 13) % 256"
_SHAPED = "s AS (SELECT p_partkey, p_size % 7 + 1 AS w, p_partkey % 5 + 1 AS h FROM part), v AS (SELECT *, list_transform(range(0, w * h * 3), lambda i: CASE WHEN i % 21 < 9 THEN 230 ELSE (p_partkey * 7 + i * 13) % 256 END) AS px FROM s)"


def _raw_pictures(read) -> DataFrame:
    w, h = F.col("p_size") % 7 + 1, (F.col("p_partkey") % 5 + 1).cast("int")
    byte = lambda i: F.when(i % 21 < 9, F.lit(230)).otherwise((F.col("p_partkey") * 7 + i * 13) % 256)
    raw = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), w * h * 3 - 1), lambda i: F.lpad(F.hex(byte(i).cast("long")), 2, "0")), ""))
    return read("part").select("p_partkey", w.cast("int").alias("w"), h.alias("h"), raw.alias("raw"))


@query(f"""WITH {_SHAPED}, p AS (SELECT p_partkey, w, h, list_transform(range(0, w * h), lambda k: [px[3 * k + 1], px[3 * k + 2], px[3 * k + 3]]) AS t FROM v),
c AS (SELECT p_partkey, w, h, list_transform(t, lambda x: CASE WHEN list_min(x) >= 220 THEN 65535 ELSE ((x[1] >> 3) << 11) | ((x[2] >> 2) << 5) | (x[3] >> 3) END) AS q FROM p)
SELECT p_partkey, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, array_to_string(list_transform(q, lambda x: upper(printf('%02x%02x', CAST(x % 256 AS INTEGER), CAST(x // 256 AS INTEGER)))), '') AS rgb565 FROM c""")
def qoi_pictures(read):
    shown = _raw_pictures(read).select("p_partkey", I.decoded(I.stored("raw", "w", "h"), F.lit(1)).alias("d"))
    return shown.select("p_partkey", "d.w", "d.h", F.hex("d.rgb565").alias("rgb565"))


@query(f"WITH {_SHAPED} SELECT p_partkey, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, md5(array_to_string(list_transform(px, lambda x: upper(printf('%02x', CAST(x AS INTEGER)))), '')) AS rgb_md5 FROM v")
def png_pictures(read):
    shown = _raw_pictures(read).select("p_partkey", raster.rgb_of(raster.as_png(I.stored("raw", "w", "h"))).alias("d"))
    return shown.select("p_partkey", "d.w", "d.h", F.md5(F.hex("d.rgb")).alias("rgb_md5"))


@query("""SELECT p_partkey AS img_id, CAST(p_size % 7 + 1 AS INTEGER) AS w FROM part WHERE p_partkey IN (1, 2, 7)""")
def image_load(read):
    images = _raw_pictures(read).select(F.col("p_partkey").alias("img_id"), I.stored("raw", "w", "h").alias("data"))
    found = [S.image(images, k) for k in (1, 2, 7, 10**9)]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return every.select("img_id", B.picture_size("data")["w"].alias("w"))


# texts and screens


@query(f"WITH named AS ({_NAMES}) SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'Simple English' WHEN 1 THEN 'French' WHEN 2 THEN 'Xx' WHEN 3 THEN 'Nopic German' ELSE 'English' END || '|' || CASE n_nationkey % 3 WHEN 0 THEN 'All Maxi|May 2026' WHEN 1 THEN 'All|Maxi 2025-13' ELSE 'All|Maxi Part' END AS lines FROM named JOIN nation USING (n_nationkey)")
def boot_lines(read):
    from quire.registry import _archive_path

    return read("nation").select("n_nationkey", F.array_join(T.name_lines(T.display_name(_archive_path())), "|").alias("lines"))


@query("""WITH t AS (SELECT p_partkey, p_name, 'x<a href="/wiki/' || p_partkey || '">' || p_name || '</a><img h="' || p_size || '" src="/img/' || p_partkey * 3 || '" w="' || p_size * 2 || '"/><a href="/x">y</a>' AS html FROM part)
SELECT p_partkey, replace(html, 'href="/wiki/' || p_partkey || '"', 'href="#" onclick="loadArticle(' || p_partkey || ');return false;"') AS viewer, p_partkey AS link, p_partkey * 3 AS img_id, p_size * 2 AS w, p_size AS h,
CASE WHEN p_size % 3 > 0 THEN '<a href="/wiki/4294967293">&lt; Prev page</a><p></p>' ELSE '' END || 'x' || CASE WHEN p_size % 2 = 0 THEN '<p></p><a href="/wiki/4294967294">Next page &gt;</a>' ELSE '' END AS paged,
substr(p_name || p_name, 1, 34) AS typed, substr(p_name, 1, 18) || ' p.' || (p_size % 3 + 1) AS page_title, lower(string_split('Dir/' || p_name || '.JpEg', '.')[-1]) AS extension FROM t JOIN part USING (p_partkey, p_name)""")
def entry_markup(read):
    key, size = F.col("p_partkey"), F.col("p_size")
    html = F.concat(F.lit('x<a href="/wiki/'), key.cast("string"), F.lit('">'), "p_name", F.lit('</a><img h="'), size.cast("string"), F.lit('" src="/img/'), (key * 3).cast("string"), F.lit('" w="'), (size * 2).cast("string"), F.lit('"/><a href="/x">y</a>'))
    image = F.get(H.entry_images(html), F.lit(0))
    paged = H.with_page_links(F.lit("x"), size % 3, size % 2 == 0)
    return read("part").select("p_partkey", T.viewer_links(html).alias("viewer"), F.get(H.entry_links(html), F.lit(0)).alias("link"), image["img_id"].alias("img_id"), image["w"].alias("w"), image["h"].alias("h"), paged.alias("paged"),
        T.query_line(F.concat("p_name", "p_name")).alias("typed"), T.page_title("p_name", size % 3).alias("page_title"), T.extension(F.concat(F.lit("Dir/"), "p_name", F.lit(".JpEg"))).alias("extension"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN -c_custkey END AS article_id, c_name || ' & <lt; A  cafe? ?' AS plain FROM customer""")
def requests_and_runs(read):
    key = F.col("c_custkey")
    url = F.concat(F.lit("http://h/api/article/"), _pick(("", "-", "x", "1/"), key), key.cast("string"))
    return read("customer").select("c_custkey", T.api_article_id(url).alias("article_id"), ascii.to_ascii(T.decode_entities(F.concat("c_name", F.lit(" &amp; &lt;lt; &#65;&nbsp;&#8212;café‐ 中")))).alias("plain"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey % 25 AS page, l_partkey % 320 AS x, l_suppkey % 240 AS y FROM lineitem),
hit AS (SELECT t.*, n_regionkey * 7 + page * 100 AS img_id, n_regionkey AS seq FROM t JOIN region ON true JOIN (SELECT DISTINCT n_regionkey FROM nation) ON n_regionkey = r_regionkey WHERE y >= r_regionkey * 90 AND y < r_regionkey * 90 + 30),
first AS (SELECT l_orderkey, l_linenumber, page, x, y, arg_min(img_id, seq) AS img_id FROM hit GROUP BY ALL),
link AS (SELECT t.l_orderkey, t.l_linenumber, t.page, t.x, t.y, arg_min(n_nationkey + t.page * 1000, n_nationkey) AS article_id FROM t JOIN nation ON t.x >= n_nationkey * 12 AND t.x < n_nationkey * 12 + 40 AND t.y >= n_regionkey * 50 AND t.y < n_regionkey * 50 + 16 GROUP BY ALL)
SELECT coalesce(f.l_orderkey, k.l_orderkey) AS l_orderkey, coalesce(f.l_linenumber, k.l_linenumber) AS l_linenumber, f.img_id, CASE WHEN f.img_id IS NULL THEN k.article_id END AS article_id FROM first f FULL JOIN link k ON f.l_orderkey = k.l_orderkey AND f.l_linenumber = k.l_linenumber AND f.page = k.page AND f.x = k.x AND f.y = k.y""")
def tap_targets(read):
    taps = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 25).alias("page"), (F.col("l_partkey") % 320).alias("x"), (F.col("l_suppkey") % 240).alias("y"))
    pages = read("lineitem").sparkSession.range(25).withColumnRenamed("id", "page")
    nation, region = read("nation"), read("region")
    links = pages.crossJoin(nation).select("page", F.col("n_nationkey").alias("seq"), (F.col("n_nationkey") * 12).alias("x"), (F.col("n_regionkey") * 50).alias("y"), F.lit(40).alias("w"), F.lit(16).alias("h"), (F.col("n_nationkey") + F.col("page") * 1000).alias("article_id"))
    images = pages.crossJoin(region).select("page", F.col("r_regionkey").alias("seq"), (F.col("r_regionkey") * 90).alias("doc_y"), F.lit(30).alias("thumb_h"), (F.col("r_regionkey") * 7 + F.col("page") * 100).alias("img_id"))
    return joins.tapped(taps, links, images).select("l_orderkey", "l_linenumber", "img_id", "article_id")


@query("""SELECT l_orderkey, l_linenumber, CAST(l_partkey % 700 AS INTEGER) AS length, CASE WHEN l_partkey % 700 <= 200 THEN 1 WHEN l_partkey % 700 <= 400 THEN 2 WHEN l_partkey % 700 <= 600 THEN 3 ELSE 4 END AS pages FROM lineitem WHERE l_partkey % 700 > 0""")
def page_counts(read):
    """Pages of entries that were stored whole and hold no tag, so that all cuts are hard."""
    rows = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 700).cast("int").alias("length")).where("length > 0")
    return rows.select("*", F.size(H.page_bounds(200)(F.repeat(F.lit("x"), F.col("length")))).alias("pages"))


# whole builds


def _published(df: DataFrame, name: str) -> str:
    """The path of a catalog that has only this table."""
    path = fresh_path(df.sparkSession, "catalog")
    build = Build(df.sparkSession, path)
    build.keep(df, name)
    build.publish()
    return path


@query(f"WITH {_PAGES}, {_MAP}, {_KEYS} SELECT article_id, title_key, entry_id, title31, count(*) OVER () AS articles FROM keyed")
def written_catalog(read):
    """A build of all pages, published and read again: titles, index, title index, articles and counts agree."""
    entries = _page_entries(read)
    path = fresh_path(entries.sparkSession, "catalog")
    C.CatalogBuilder(with_images=False).write(entries, path)
    made = C.load(entries.sparkSession, path)
    rows = made.index.select("article_id", "title_key").join(made.titles.select("article_id", "entry_id"), "article_id").join(made.title31, "article_id").join(made.articles.select("article_id"), "article_id")
    count = made.meta.where("key = 'article_count'").select(F.col("value").cast("long").alias("articles"))
    return rows.crossJoin(F.broadcast(count)).select("article_id", "title_key", "entry_id", "title31", "articles")  # one row


@query(_listed(500))
def written_words(read):
    """Only the word index, made anew from a published index."""
    keys = _keys(_titles(read))
    path = _published(keys, "index")
    C.CatalogBuilder().write_words(keys.sparkSession, path)
    words = table(keys.sparkSession, path, "words")
    return words.select("word", F.col("ids_count").cast("long").alias("ids_count"), F.array_join("article_ids", ",").alias("ids"), "ids_start")


@query(f"WITH {_PICTURES} SELECT img_id, entry_id, path, diagram, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM stored")
def written_pictures(read):
    """Only the pictures, published beside what was there."""
    path = _published(read("region"), "titles")
    C.CatalogBuilder().write_images(_pictures(read), path)
    return table(read("region").sparkSession, path, "images")


@query("SELECT p_partkey, len(list_distinct(list_transform(range(p_size * 8), lambda i: i * p_partkey % (p_size + 3)))) AS colours, len(list_distinct(list_transform(range(p_size * 8), lambda i: i * p_partkey % (p_size + 3)))) <= 16 AS few FROM part")
def picture_colours(read):
    """Distinct colours of arrays of pixels."""
    pixels = F.transform(F.sequence(F.lit(0), F.col("p_size") * 8 - 1), lambda i: i * F.col("p_partkey") % (F.col("p_size") + 3))
    return read("part").select("p_partkey", I.colour_count(pixels).cast("long").alias("colours")).withColumn("few", F.col("colours") <= 16)
