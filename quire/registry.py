"""All queries of the catalog engine by name, with their SQL counterparts for the same tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import ascii, binary, geometry as G, html as H, text as T
from quire.operators import joins, ordering
from quire.operators.staging import fresh_path
from quire.plans import catalog as C
from quire.plans.blocks import BlockIndex
from quire.plans.search import SearchEngine
from quire.schemas import STOP_WORDS
from quire.sources import entries as E
from quire.sources.versions import Build
from quire.streaming import gestures, logs, navigation

FLAGSHIP = "prefix_search"
_QUERIES: dict = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (read, spark), read giving tables by name, under its own name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from quire import device_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)


# SQL parts

_SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(translate({x}, '{T.DASHES}', '{'-' * len(T.DASHES)}')), '{_SPACE}', ' ', 'g'))"


def _entities(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_PAGE_TITLE = _entities("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")
_PAGES = f"named AS (SELECT page_id AS entry_id, {_norm(_PAGE_TITLE)} AS title_norm FROM pages)"
_DOCS = f"named AS (SELECT doc_id AS entry_id, {_norm('string_split(text, chr(10))[1]')} AS title_norm FROM documents)"
_MAP = """first AS (SELECT title_norm, min(entry_id) AS entry_id FROM named WHERE title_norm <> '' GROUP BY title_norm),
titles AS (SELECT title_norm, entry_id, row_number() OVER (ORDER BY entry_id) - 1 AS article_id FROM first)"""


def _cut(x: str, n: int) -> str:
    """SQL of the first n bytes of a text; a broken last character gives U+FFFD."""
    part = _whole(x, n)
    return f"{part} || CASE WHEN octet_length(encode({x})) > {n} AND octet_length(encode({part})) < {n} THEN chr(65533) ELSE '' END"


def _whole(x: str, n: int) -> str:
    """SQL of the characters of a text that fit n bytes."""
    return f"substr({x}, 1, list_max(list_filter(range(0, {n + 1}), lambda k: octet_length(encode(substr({x}, 1, k))) <= {n})))"


_KEYS = f"""keyed AS (SELECT article_id, entry_id, {_cut("title_norm", 60)} AS title_key, {_cut("title_norm", 31)} AS title31 FROM titles)"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = rf"""{_KEYS}, raw AS (SELECT article_id, unnest(string_split(trim(title_key), ' ')) AS r FROM keyed),
cleaned AS (SELECT article_id, regexp_replace(regexp_replace(r, '[^\p{{L}}\p{{N}}-]', '', 'g'), '^-+|-+$', '', 'g') AS w FROM raw),
postings AS (SELECT DISTINCT substr(w, 1, 13) AS word, article_id FROM cleaned WHERE length(w) >= 3 AND w NOT IN ({_STOP}))"""


def _page_entries(read) -> DataFrame:
    return E.entries_of_pages(read("pages"))


def _titles(read, table: str = "documents") -> DataFrame:
    return C.title_map(_page_entries(read) if table == "pages" else E.entries_of_documents(read("documents")))


def _keys(titles: DataFrame) -> DataFrame:
    """(title_key, article_id): the index's keys, cut to 60 bytes."""
    return titles.select(T.key_text(T.title_key("title_norm")).alias("title_key"), "article_id")


# building


@query(f"WITH {_PAGES}, {_MAP} SELECT title_norm, article_id, entry_id FROM titles")
def title_map(read):
    return _titles(read, "pages").select("title_norm", "article_id", "entry_id")


@query(f"WITH {_DOCS}, {_MAP} SELECT title_norm, article_id, entry_id FROM titles")
def title_map_documents(read):
    return _titles(read).select("title_norm", "article_id", "entry_id")


@query(f"WITH {_PAGES}, {_MAP} SELECT title_norm, article_id FROM titles WHERE article_id < 100")
def title_map_limited(read):
    return C.title_map(_page_entries(read), limit=100).select("title_norm", "article_id")


@query(f"""WITH {_DOCS}, {_MAP}, cut AS (SELECT article_id, title_norm AS t, {_whole("title_norm", 60)} AS p FROM titles)
SELECT article_id, hex(encode(p)) || CASE WHEN octet_length(encode(t)) > 60 THEN substr('EFBFBD', 1, 2 * (60 - octet_length(encode(p)))) ELSE '' END AS key_bytes FROM cut""")
def title_keys(read):
    return _titles(read).select("article_id", F.hex(T.title_key("title_norm")).alias("key_bytes"))


@query(f"WITH {_DOCS}, {_MAP}, {_KEYS} SELECT article_id, title_key, title31 FROM keyed")
def title_index(read):
    titles = _titles(read)
    return _keys(titles).join(C.title_index(titles), "article_id").select("article_id", "title_key", "title31")


def _listed(cap: int) -> str:
    return f"""WITH {_DOCS}, {_MAP}, {_WORDS}, ranked AS (SELECT word, article_id, row_number() OVER (PARTITION BY word ORDER BY article_id) AS r FROM postings),
listed AS (SELECT word, count(*) AS ids_count, array_to_string(list(article_id ORDER BY article_id), ',') AS ids FROM ranked WHERE r <= {cap} GROUP BY word)
SELECT word, ids_count, ids, CAST(coalesce(sum(ids_count) OVER (ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ids_start FROM listed"""


@query(_listed(500))
def word_index(read):
    return _word_rows(_titles(read), 500)


@query(_listed(5))
def posting_cap(read):
    return _word_rows(_titles(read), 5)


def _word_rows(titles: DataFrame, cap: int) -> DataFrame:
    return C.word_index(titles, cap).select("word", F.col("ids_count").cast("long").alias("ids_count"), F.array_join("article_ids", ",").alias("ids"), "ids_start")


@query(f"""WITH {_DOCS}, {_MAP}, {_WORDS} SELECT count(DISTINCT word) AS words, count(DISTINCT article_id) AS articles, max(article_id) AS last_id, count(*) AS pairs FROM postings""")
def word_statistics(read):
    pairs = _keys(_titles(read)).select(F.explode(T.title_words("title_key")).alias("word"), "article_id")
    return pairs.agg(F.countDistinct("word").alias("words"), F.countDistinct("article_id").alias("articles"), F.max("article_id").alias("last_id"), F.count("*").alias("pairs"))


@query(f"""WITH {_DOCS}, {_MAP}, {_KEYS}, placed AS (SELECT title_key, row_number() OVER (ORDER BY title_key, article_id) - 1 AS pos FROM keyed)
SELECT CAST(pos // 64 AS BIGINT) AS pos, {_cut("title_key", 12)} AS sparse_key FROM placed WHERE pos % 64 = 0""")
def sparse_index(read):
    return C.sparse_index(_keys(_titles(read)), 64)


@query(f"""WITH {_DOCS}, {_MAP}, top AS (SELECT max(entry_id) AS m FROM titles), ids AS (SELECT unnest(range(0, (SELECT m + 1 FROM top))) AS id)
SELECT id, coalesce(article_id, -1) AS article_id FROM ids LEFT JOIN titles ON entry_id = id""")
def dense_ids(read):
    rows = _titles(read).select(F.col("entry_id").alias("id"), "article_id")
    return joins.dense(rows, "id", None, {"article_id": -1})


@query(f"""WITH {_DOCS}, {_MAP} SELECT id FROM (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM documents))) AS id) WHERE id NOT IN (SELECT entry_id FROM titles)""")
def id_holes(read):
    last = read("documents").agg(F.max("doc_id")).first()[0]
    return joins.holes(_titles(read).select(F.col("entry_id").alias("id")), "id", last if last is not None else -1)


@query("""WITH RECURSIVE rows AS (SELECT page_id AS id, octet_length(encode(html)) AS length, row_number() OVER (ORDER BY page_id) AS k FROM pages),
walk AS (SELECT k, id, length, CAST(CASE WHEN length > 20000 THEN 1 ELSE 0 END AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS "offset" FROM rows WHERE k = 1
UNION ALL SELECT r.k, r.id, r.length, CASE WHEN w."offset" + w.length + r.length > 20000 THEN w.chunk_id + 1 ELSE w.chunk_id END,
CASE WHEN w."offset" + w.length + r.length > 20000 THEN 0 ELSE w."offset" + w.length END FROM walk w JOIN rows r ON r.k = w.k + 1)
SELECT id, length, chunk_id, "offset" FROM walk""")
def chunk_packing(read):
    return ordering.chunked(read("pages").select(F.col("page_id").alias("id"), F.octet_length("html").alias("length")), 20000)


@query("""SELECT count(*) AS articles, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes, round(sum(octet_length(encode(text))) / 1024.0 / count(*), 6) AS average_kb,
round(count(*) * 80 / 1048576.0, 6) AS index_mb, CAST(count(*) // 64 + 1 AS BIGINT) AS sparse_entries FROM documents""")
def article_sizes(read):
    made = C.sizes(read("documents").select(F.col("text").cast("binary").alias("data")))
    return made.select("articles", "total_bytes", F.round("average_kb", 6).alias("average_kb"), F.round("index_mb", 6).alias("index_mb"), "sparse_entries")


@query("""SELECT count(*) AS entry_count, count(*) FILTER (WHERE p_size % 4 < 3) AS media_count FROM part""")
def archive_statistics(read):
    return E.archive_statistics(_pictures(read))


_NAMES = """SELECT n_nationkey, n_name, 'wikipedia_' || CASE n_regionkey WHEN 0 THEN 'en_simple' WHEN 1 THEN 'fr' WHEN 2 THEN 'xx' WHEN 3 THEN 'de_nopic' ELSE 'en' END || '_all_maxi_' ||
CASE n_nationkey % 3 WHEN 0 THEN '2026-05' WHEN 1 THEN '2025-13' ELSE 'part' END || '.zim' AS path FROM nation"""


@query(f"""WITH named AS ({_NAMES}) SELECT n_nationkey, CASE WHEN path LIKE 'wikipedia_en_simple%' THEN 'Simple English' WHEN path LIKE 'wikipedia_fr%' THEN 'French' WHEN path LIKE 'wikipedia_xx%' THEN 'Xx' WHEN path LIKE 'wikipedia_de_nopic%' THEN 'Nopic German' ELSE 'English' END || ': All Maxi ' || CASE n_nationkey % 3 WHEN 0 THEN 'May 2026' WHEN 1 THEN '2025-13' ELSE 'Part' END AS name FROM named""")
def display_names(read):
    return read("nation").select("n_nationkey", T.display_name(_archive_path()).alias("name"))


def _archive_path():
    region = F.element_at(F.array(*map(F.lit, ("en_simple", "fr", "xx", "de_nopic", "en"))), F.col("n_regionkey").cast("int") + 1)
    date = F.element_at(F.array(*map(F.lit, ("2026-05", "2025-13", "part"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return F.concat(F.lit("/data/wikipedia_"), region, F.lit("_all_maxi_"), date, F.lit(".zim"))


# search


def _engine(read) -> SearchEngine:
    titles = _titles(read)
    keys = _keys(titles)
    words = C.grouped_postings(keys.select(F.explode(T.title_words("title_key")).alias("word"), "article_id"))
    return SearchEngine(keys, words, C.title_index(titles))


_SEARCHED = f"WITH {_DOCS}, {_MAP}, {_KEYS}"
_CAPPED = "capped AS (SELECT article_id FROM (SELECT article_id, row_number() OVER (ORDER BY article_id) AS r FROM postings WHERE word = '{0}') WHERE r <= 500)"


@query(f"{_SEARCHED} SELECT article_id, title_key AS title FROM keyed WHERE starts_with(title_key, 'the') ORDER BY title_key, article_id LIMIT 20")
def prefix_search(read):
    return _engine(read).prefix(" THE ", 20)


@query(f"{_SEARCHED} SELECT min(article_id) AS article_id, title_key AS title FROM keyed WHERE title_key = (SELECT min(title_key) FROM keyed WHERE starts_with(title_key, 'the ')) GROUP BY title_key")
def exact_search(read):
    engine = _engine(read)
    wanted = engine.index.where(F.col("title_key").startswith("the ")).agg(F.upper(F.min("title_key")))
    return engine.exact(wanted.scalar())


@query(f"""WITH {_DOCS}, {_MAP}, {_WORDS}, {_CAPPED.format("ering")}
SELECT article_id, title31 AS title FROM keyed JOIN capped USING (article_id) WHERE contains(title31, 'ering') AND NOT starts_with(title31, 'ering') ORDER BY article_id LIMIT 20""")
def contains_search(read):
    return _engine(read).contains("Ering", 20)


@query(f"""WITH {_DOCS}, {_MAP}, {_WORDS}, {_CAPPED.format("erin")},
a AS (SELECT 0 AS section, row_number() OVER (ORDER BY title_key, article_id) AS rank, article_id, title_key AS title FROM keyed WHERE starts_with(title_key, 'erin')),
b AS (SELECT 2 AS section, row_number() OVER (ORDER BY article_id) AS rank, article_id, title31 AS title FROM keyed JOIN capped USING (article_id) WHERE contains(title31, 'erin') AND NOT starts_with(title31, 'erin'))
SELECT section, rank, article_id, title FROM a WHERE rank <= 20 UNION ALL SELECT 1, 1, NULL, '' FROM b WHERE rank = 1 UNION ALL SELECT section, rank, article_id, title FROM b WHERE rank <= 20""")
def go_search(read):
    return _engine(read).go("erin", 20).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{_SEARCHED}, found AS (SELECT CASE WHEN starts_with(title_key, 'to') THEN 0 ELSE 1 END AS section, article_id, title_key AS title FROM keyed WHERE contains(title_key, 'to'))
SELECT section, article_id, title FROM found ORDER BY section, title, article_id LIMIT 40""")
def desktop_search(read):
    return _engine(read).desktop(" To", 40)


_BLOCK_SEARCH = f"""{_SEARCHED}, placed AS (SELECT title_key, article_id, row_number() OVER (ORDER BY title_key, article_id) - 1 AS pos FROM keyed),
blocks AS (SELECT pos // 64 AS block FROM placed WHERE pos % 64 = 0 AND contains({_cut("title_key", 12)}, 'er') AND NOT starts_with(title_key, 'er') ORDER BY pos LIMIT 15)
SELECT article_id, title_key AS title FROM placed JOIN blocks ON pos // 64 = block WHERE contains(title_key, 'er') AND NOT starts_with(title_key, 'er') ORDER BY pos LIMIT 20"""


@query(_BLOCK_SEARCH)
def block_search(read):
    keys = _keys(_titles(read))
    placed = ordering.with_text_position(keys, "title_key", "pos", ("article_id",))
    return SearchEngine(keys).contains_by_blocks("er", C.sparse_index(keys, 64), placed, 64, 20)


@query(_BLOCK_SEARCH)
def pruned_block_search(read):
    """The same over stored blocks, of which only the folders of the picked ones are read."""
    keys = _keys(_titles(read))
    path = fresh_path(keys.sparkSession, "catalog")
    build = Build(keys.sparkSession, path)
    build.keep(keys, "index")
    build.publish()
    return BlockIndex.opened(keys.sparkSession, path, 64, 4).contains("er", 20)


@query(f"WITH {_DOCS}, {_MAP} SELECT count(*) AS article_count, 'Pages' AS db_name FROM titles")
def catalog_info(read):
    return _engine(read).info("Pages")


@query(f"WITH {_DOCS}, {_MAP} SELECT article_id, title_norm AS title FROM titles ORDER BY title_norm, article_id LIMIT 11 OFFSET 5")
def result_window(read):
    from quire.plans.search import window_of_results

    return window_of_results(_titles(read).select("article_id", F.col("title_norm").alias("title")), ["title", "article_id"], 5, 212)


# links and HTML


_LINKS = """hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
targets AS (SELECT page_id, href, href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'http') AND NOT starts_with(href, './') AND NOT starts_with(href, '../') AND NOT contains(href, '://') AS internal FROM hrefs)"""


@query(f"""WITH {_LINKS}, {_DOCS}, {_MAP}, {_WORDS}, dictionary AS (SELECT '/' || word AS word, row_number() OVER (ORDER BY word) - 1 AS article_id FROM (SELECT DISTINCT word FROM postings)),
named AS (SELECT page_id, internal, CASE WHEN internal THEN {_norm("replace(string_split(href, '#')[1], '_', ' ')")} END AS target FROM targets)
SELECT page_id, count(*) AS links, count(*) FILTER (WHERE internal) AS internal_links, count(d.article_id) AS resolved, coalesce(CAST(sum(d.article_id) AS BIGINT), -1) AS id_sum
FROM named LEFT JOIN dictionary d ON target = d.word GROUP BY page_id""".replace(f"{_DOCS}", _DOCS.replace("named AS", "title_rows AS")).replace("FROM named WHERE title_norm", "FROM title_rows WHERE title_norm"))
def link_graph(read):
    words = _keys(_titles(read)).select(F.explode(T.title_words("title_key")).alias("word")).distinct()
    placed = ordering.with_text_position(words, "word", "article_id").select(F.concat(F.lit("/"), F.col("word")).alias("title_norm"), "article_id")
    links = read("pages").select("page_id", F.explode(H.hrefs("html")).alias("href"))
    out = joins.resolved_links(links, placed).groupBy("page_id")
    return out.agg(F.count("*").alias("links"), F.count_if("internal").alias("internal_links"), F.count("article_id").alias("resolved"), F.coalesce(F.sum("article_id"), F.lit(-1)).alias("id_sum"))


@query(f"SELECT page_id, {_PAGE_TITLE} AS title FROM pages")
def decoded_titles(read):
    return _page_entries(read).select(F.col("entry_id").alias("page_id"), "title")


@query(r"""WITH tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<([^<>]*)>', 1)) AS tag FROM pages), named AS (SELECT page_id, trim(tag) AS tag FROM tags WHERE trim(tag) <> '')
SELECT page_id, lower(string_split(ltrim(tag, '/'), ' ')[1]) AS name, count(*) FILTER (WHERE starts_with(tag, '/')) AS closing, count(*) FILTER (WHERE NOT starts_with(tag, '/')) AS opening FROM named GROUP BY ALL""")
def html_tokens(read):
    rows = H.token_rows(read("pages"), "html", "page_id").where("kind = 'tag'")
    return rows.groupBy("page_id", "name").agg(F.count_if("closing").alias("closing"), F.count_if(~F.col("closing")).alias("opening"))


#: A document whose links to its own title are spelt in each way that HTML allows, one to a title that no page has, and ones that don't count.
_SPELLINGS = ("<A HREF='{0}'>1</A>", '<a class="x" href = "{0}">2</a>', "<a href={1}>3</a>", '<a title=">" href="{0}#part">4</a>', "<a\nhRef='{0}'/>5", '<a href="&#32;{0}">6</a>', "<script>'<a href=\"{0}\">'</script>", "<!-- <a href='{0}'> -->", '<a href="no such page">7</a>', "<a href='./{0}'>8</a>", "<a name={1}>9</a>")


@query(f"""WITH {_PAGES}, {_MAP} SELECT article_id, CAST(n AS BIGINT) AS links, CAST(n * article_id AS BIGINT) AS id_sum, '1 2 3 4 5 6 7 8 9' AS shown
FROM (SELECT article_id, CASE WHEN contains(title_norm, '#') THEN 0 ELSE 6 END AS n FROM titles)""")
def spelt_links(read):
    """Pages that link to themselves by title in all spellings: as many links as were planted come out of a build (none if the title has
    a "#", which begins a place in a page: such links lead to the page titled by what is before it, if there is one, and don't count)."""
    entries = _page_entries(read)
    quoted = T.html_escape("title")
    plain = F.regexp_replace(quoted, T.WHITE, "_")  # HTML allows neither blanks nor these in a value without quotes
    for c in "'=`":
        plain = F.replace(plain, F.lit(c), F.lit(f"&#{ord(c)};"))
    link = lambda x: F.concat(*[p for i, bit in enumerate(re.split(r"(\{\d\})", x)) for p in [F.lit(bit) if i % 2 == 0 else {"{0}": F.replace(quoted, F.lit("'"), F.lit("&#39;")), "{1}": plain}[bit]]])
    body = F.concat(F.lit("<html><body>"), *[F.concat(link(x), F.lit(" ")) for x in _SPELLINGS], F.lit("</body></html>"))
    planted = entries.withColumn("content", body.cast("binary"))
    cleaned = C.CatalogBuilder(with_images=False).cleaned(planted, C.title_map(planted))
    ids = F.filter(H.entry_links("html"), lambda x: (x == F.col("article_id")) | ~F.col("title").contains("#"))
    shown = F.btrim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), " +", " "))
    return cleaned.select("article_id", F.size(ids).cast("long").alias("links"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), shown.alias("shown"))


@query()
def cleaned_pages(read):
    entries = _page_entries(read)
    return C.CatalogBuilder(with_images=False).cleaned(entries, C.title_map(entries))


@query()
def packed_articles(read):
    entries = _page_entries(read)
    builder = C.CatalogBuilder(block_bytes=1000, with_images=False)
    blobs = builder.packed(builder.cleaned(entries, C.title_map(entries)))
    read_back = blobs.select(binary.unpacked_articles("data").alias("a"), binary.kind_of("data").alias("kind"), F.octet_length("data").alias("bytes"))
    whole = F.aggregate("a.blocks", F.lit(b""), lambda a, b: F.concat(a, b))
    return read_back.select("a.article_id", "a.title", "kind", "bytes", F.size("a.blocks").alias("blocks"), F.md5(whole).alias("html_md5"), binary.rolling_checksum(F.get("a.blocks", F.lit(0))).alias("checksum"))


_BLOCKS = """src AS (SELECT page_id, hex(encode(html)) AS h FROM pages),
cut AS (SELECT page_id, 0 AS block_num, h AS rest, CASE WHEN length(h) <= 2000 THEN length(h) ELSE coalesce(list_max(list_filter(range(1, 1000), lambda i: substr(h, 2 * i + 1, 2) = '3E')) * 2 + 2, 2000) END AS n FROM src WHERE h <> ''
UNION ALL SELECT page_id, block_num + 1, substr(rest, n + 1), CASE WHEN length(rest) - n <= 2000 THEN length(rest) - n ELSE coalesce(list_max(list_filter(range(1, 1000), lambda i: substr(rest, n + 2 * i + 1, 2) = '3E')) * 2 + 2, 2000) END FROM cut WHERE length(rest) > n)"""


@query(f"WITH RECURSIVE {_BLOCKS} SELECT page_id, block_num, n // 2 AS bytes, md5(substr(rest, 1, n)) AS hex_md5 FROM cut")
def html_blocks(read):
    blocks = read("pages").select("page_id", F.posexplode(H.html_blocks(1000)("html")).alias("block_num", "data"))
    return blocks.select("page_id", "block_num", F.octet_length("data").cast("long").alias("bytes"), F.md5(F.hex("data")).alias("hex_md5"))


@query()
def page_layouts(read):
    entries = _page_entries(read)
    cleaned = C.CatalogBuilder(with_images=False).cleaned(entries, C.title_map(entries))
    laid = cleaned.select("article_id", H.page_layout(ascii.to_ascii(T.decode_entities("html"))).alias("p"))
    return laid.select("article_id", F.size("p.links").alias("links"), F.size("p.images").alias("images"), "p.content_height", F.md5(F.to_json("p")).alias("regions_md5"))


#: Independent of the engine's table: the database strips accents itself, what has none is said here.
_ASCII = r"regexp_replace(strip_accents(replace(replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '…', '...')), '[^\x{00}-\x{7f}]', '?', 'g')"


@query(f"SELECT doc_id, md5({_ASCII}) AS ascii_md5 FROM documents")
def transliterated(read):
    return read("documents").select("doc_id", F.md5(ascii.to_ascii("text")).alias("ascii_md5"))


@query("""SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(substr(c_name, i, 1)) AS BIGINT))), lambda c, b: (c * 31 + b) % 4294967296) AS BIGINT) AS checksum FROM customer""")
def checksums(read):
    return read("customer").select("c_custkey", binary.rolling_checksum(F.col("c_name").cast("binary")).alias("checksum"))


# pictures

_PICTURES = """pictures AS (SELECT p_partkey AS entry_id, '_assets_/' || (p_partkey % 97) || '/' || replace(p_name, ' ', '_') || CASE p_size % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.svg' ELSE '' END AS path,
CASE p_size % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'image/svg+xml; charset=utf-8' ELSE 'text/css' END AS mimetype, p_size * 12 AS orig_w, (51 - p_size) * 9 AS orig_h, p_partkey % 500 AS colours, p_partkey % 11 = 0 AS is_redirect FROM part),
kept AS (SELECT * FROM pictures WHERE NOT is_redirect AND mimetype <> 'text/css' AND (mimetype LIKE 'image/svg%' OR (orig_w >= 50 AND orig_h >= 50))),
stored AS (SELECT row_number() OVER (ORDER BY entry_id) - 1 AS img_id, entry_id, path, (mimetype LIKE 'image/svg%' OR path LIKE '%.png' OR colours <= 256) AS diagram,
CASE WHEN orig_w <= 320 AND orig_h <= 212 THEN orig_w WHEN orig_w * 212 >= orig_h * 320 THEN 320 ELSE greatest(1, CAST(floor(orig_w * 212 / orig_h + 0.5) AS INTEGER)) END AS w,
CASE WHEN orig_w <= 320 AND orig_h <= 212 THEN orig_h WHEN orig_w * 212 >= orig_h * 320 THEN greatest(1, CAST(floor(orig_h * 320 / orig_w + 0.5) AS INTEGER)) ELSE 212 END AS h FROM kept)"""


def _pictures(read) -> DataFrame:
    kind = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_size") % 4 + 1).cast("int"))
    name = F.concat(F.lit("_assets_/"), (F.col("p_partkey") % 97).cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), kind(".png", ".jpg", ".svg", ""))
    mime = kind("image/png", "image/webp", "image/svg+xml; charset=utf-8", "text/css")
    return read("part").select(F.col("p_partkey").alias("entry_id"), name.alias("path"), mime.alias("mimetype"), (F.col("p_size") * 12).alias("orig_w"), ((51 - F.col("p_size")) * 9).alias("orig_h"), (F.col("p_partkey") % 500).alias("colours"), (F.col("p_partkey") % 11 == 0).alias("is_redirect"))


@query(f"WITH {_PICTURES} SELECT img_id, entry_id, path, diagram, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM stored")
def image_table(read):
    return C.image_table(_pictures(read))


@query(f"""WITH {_PICTURES}, p AS (SELECT path AS key, max(img_id) AS img_id FROM stored GROUP BY path), b AS (SELECT string_split(path, '/')[3] AS key, min(img_id) AS img_id FROM stored GROUP BY 1)
SELECT key, img_id FROM p UNION ALL SELECT key, img_id FROM b WHERE key NOT IN (SELECT key FROM p)""")
def image_names(read):
    return joins.image_names(C.image_table(_pictures(read)).select("img_id", "path", "w", "h")).select("key", "img_id")


@query(f"""WITH {_PICTURES}, p AS (SELECT path AS key, max(img_id) AS img_id FROM stored GROUP BY path), b AS (SELECT string_split(path, '/')[3] AS key, min(img_id) AS img_id FROM stored GROUP BY 1),
names AS (SELECT key, img_id FROM p UNION ALL SELECT key, img_id FROM b WHERE key NOT IN (SELECT key FROM p))
SELECT entry_id, coalesce(d.img_id, e.img_id) AS img_id FROM pictures LEFT JOIN names d ON d.key = path LEFT JOIN names e ON e.key = string_split(path, '/')[3] WHERE coalesce(d.img_id, e.img_id) IS NOT NULL""")
def image_resolution(read):
    pictures = _pictures(read)
    names = joins.image_names(C.image_table(pictures).select("img_id", "path", "w", "h"))
    return joins.resolved_images(pictures.select("entry_id", F.concat(F.lit(".././"), F.col("path")).alias("src")), names, ["entry_id"]).select("entry_id", "img_id")


@query("""SELECT p_partkey, CAST(least(greatest(CASE WHEN p_size * 8 > 0 THEN p_size * 8 // 2 ELSE 60 END, 8), 120) AS INTEGER) AS thumb_h,
CASE WHEN p_size * 30 // 2 <= 120 THEN 2 WHEN p_size * 30 // 4 <= 120 THEN 4 ELSE 8 END AS scale, CASE WHEN p_size * 8 < 320 THEN (320 - p_size * 8) // 2 ELSE 0 END AS left_edge FROM part""")
def thumbnail_arithmetic(read):
    size = F.col("p_size")
    return read("part").select("p_partkey", G.thumbnail_height(size * 8).alias("thumb_h"), G.decode_scale((size * 30).cast("long"), F.lit(120)).alias("scale"), G.centred(size * 8, 320).alias("left_edge"))


@query("""SELECT l_orderkey, l_linenumber, ((l_partkey % 256) >> 3 << 11) | ((l_suppkey % 256) >> 2 << 5) | ((l_orderkey % 256) >> 3) AS pixel FROM lineitem""")
def rgb565_pixels(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", G.rgb565(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256).alias("pixel"))


# touch and screens


@query("""SELECT l_orderkey, l_linenumber, l_partkey, min(n_nationkey) AS rect_id FROM lineitem JOIN nation ON l_partkey % 320 >= n_nationkey * 12 AND l_partkey % 320 < n_nationkey * 12 + 40
AND l_orderkey % 240 >= n_regionkey * 50 AND l_orderkey % 240 < n_regionkey * 50 + 60 GROUP BY ALL""")
def hit_test(read):
    points = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 320).alias("x"), (F.col("l_orderkey") % 240).alias("y"))
    rects = read("nation").select(F.col("n_nationkey").alias("rect_id"), (F.col("n_nationkey") * 12).alias("left"), (F.col("n_regionkey") * 50).alias("top"), F.lit(40).alias("width"), F.lit(60).alias("height"))
    return joins.hits(points, rects).select("l_orderkey", "l_linenumber", "l_partkey", "rect_id")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 3000 AS total, l_suppkey * 7 - 50 AS scroll FROM lineitem),
u AS (SELECT *, least(greatest(scroll, 0), greatest(total - 212, 0)) AS shown FROM t)
SELECT l_orderkey, l_linenumber, shown, CASE WHEN total > 212 THEN greatest(16, 44944 // total) END AS thumb, CASE WHEN total > 212 THEN 28 + shown * (212 - greatest(16, 44944 // total)) // (total - 212) END AS top FROM u""")
def scroll_bars(read):
    t = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3000).alias("total"), (F.col("l_suppkey") * 7 - 50).alias("scroll"))
    t = t.withColumn("shown", G.scroll_clamp("scroll", "total"))
    return t.select("l_orderkey", "l_linenumber", "shown", G.thumb_height("total").alias("thumb"), F.when(F.col("total") > 212, G.thumb_top("shown", "total")).alias("top"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 320 AS x, l_orderkey % 144 AS y, l_linenumber % 2 = 0 AS shift, l_suppkey % 3 = 0 AS num FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE y // 36
WHEN 0 THEN CASE WHEN num AND shift THEN substr('!@#$%^&*()', x // 32 + 1, 1) WHEN num THEN substr('1234567890', x // 32 + 1, 1) WHEN shift THEN substr('QWERTYUIOP', x // 32 + 1, 1) ELSE substr('qwertyuiop', x // 32 + 1, 1) END
WHEN 1 THEN CASE WHEN x >= 304 THEN NULL WHEN num THEN substr('-/:;()$&@', greatest(x - 16, 0) // 32 + 1, 1) WHEN shift THEN substr('ASDFGHJKL', greatest(x - 16, 0) // 32 + 1, 1) ELSE substr('asdfghjkl', greatest(x - 16, 0) // 32 + 1, 1) END
WHEN 2 THEN CASE WHEN x < 48 THEN chr(1) WHEN x >= 272 THEN chr(8) WHEN num THEN substr('!''"`,.?', (x - 48) // 32 + 1, 1) WHEN shift THEN substr('ZXCVBNM', (x - 48) // 32 + 1, 1) ELSE substr('zxcvbnm', (x - 48) // 32 + 1, 1) END
ELSE CASE WHEN x < 32 THEN chr(2) WHEN x < 176 THEN ' ' WHEN x < 224 THEN chr(3) ELSE chr(13) END END AS key FROM t""")
def keyboard_hits(read):
    t = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 320).alias("x"), (F.col("l_orderkey") % 144).alias("y"), (F.col("l_linenumber") % 2 == 0).alias("shift"), (F.col("l_suppkey") % 3 == 0).alias("num"))
    return t.select("l_orderkey", "l_linenumber", G.key_at("x", "y", 0, F.col("shift"), F.col("num")).alias("key"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey * 5 % 4096 AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, least(greatest(CAST(trunc((raw - 300) * 319 / 3400) AS BIGINT), 0), 319) AS x, CAST((l_orderkey % 400) + 16 - 100 > 0 AND (l_orderkey % 400) - 100 < 212 AS BOOLEAN) AS visible FROM t""")
def touch_mapping(read):
    t = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 5 % 4096).alias("raw"))
    return t.select("l_orderkey", "l_linenumber", G.touch_to_screen("raw", 300, 3700, 319).alias("x"), G.line_visible(F.col("l_orderkey") % 400, 16, F.lit(100)).alias("visible"))


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, CAST(floor(abs(value) * 100) AS BIGINT) % 4096 AS x FROM events)
SELECT user_id AS device, CAST(seq // 4 AS BIGINT) AS sample, CAST(trunc(avg(x)) AS INTEGER) AS x FROM r GROUP BY ALL HAVING count(*) = 4""")
def touch_samples(read):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    raw = read("events").select(F.col("user_id").alias("device"), seq.alias("seq"), (F.floor(F.abs("value") * 100) % 4096).alias("x"))
    return logs.sampled(raw.withColumn("y", F.col("x"))).select("device", "sample", "x")


@query("""WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS device, epoch_us(ts) // 10000 AS ms, event_id % 5 <> 0 AS p, CAST(trunc(abs(value) % 320) AS INTEGER) AS x, CAST(trunc(abs(value) * 7 % 240) AS INTEGER) AS y FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ms, p, x, y) AS k FROM s),
walk AS (SELECT device, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS ms, false AS down, 0 AS x0, 0 AS y0, 0 AS x1, 0 AS y1, CAST(-1 AS BIGINT) AS since, 0 AS moved, CAST(-1 AS BIGINT) AS hold, '' AS type, 0 AS x, 0 AS y, 0 AS dy FROM (SELECT DISTINCT device FROM s)
UNION ALL SELECT w.device, r.k, r.ms, CASE WHEN r.p AND NOT w.down THEN NOT (w.since >= 0 AND r.ms - w.since < 60) ELSE r.p END,
CASE WHEN r.p AND NOT w.down AND NOT (w.since >= 0 AND r.ms - w.since < 60) THEN r.x ELSE w.x0 END, CASE WHEN r.p AND NOT w.down AND NOT (w.since >= 0 AND r.ms - w.since < 60) THEN r.y ELSE w.y0 END,
CASE WHEN r.p AND (w.down OR NOT (w.since >= 0 AND r.ms - w.since < 60)) THEN r.x ELSE w.x1 END, CASE WHEN r.p AND (w.down OR NOT (w.since >= 0 AND r.ms - w.since < 60)) THEN r.y ELSE w.y1 END,
CASE WHEN r.p AND NOT w.down AND NOT (w.since >= 0 AND r.ms - w.since < 60) THEN r.ms ELSE w.since END,
CASE WHEN r.p AND w.down THEN w.moved + r.y - w.y1 WHEN r.p AND NOT (w.since >= 0 AND r.ms - w.since < 60) THEN 0 ELSE w.moved END,
CASE WHEN r.p AND w.down THEN CASE WHEN abs(w.moved + r.y - w.y1) < 15 AND CASE WHEN w.hold >= 0 THEN r.ms >= w.hold ELSE r.ms - w.since >= 500 END THEN r.ms + 100 ELSE w.hold END WHEN r.p AND NOT (w.since >= 0 AND r.ms - w.since < 60) THEN -1 ELSE w.hold END,
CASE WHEN r.p AND w.down AND abs(w.moved + r.y - w.y1) < 15 AND CASE WHEN w.hold >= 0 THEN r.ms >= w.hold ELSE r.ms - w.since >= 500 END THEN 'HOLD'
WHEN NOT r.p AND w.down AND w.hold < 0 AND abs(w.moved) >= 25 THEN CASE WHEN w.moved < 0 THEN 'SWIPE_UP' ELSE 'SWIPE_DOWN' END
WHEN NOT r.p AND w.down AND w.hold < 0 AND trunc(sqrt((w.x1 - w.x0) * (w.x1 - w.x0) + (w.y1 - w.y0) * (w.y1 - w.y0))) < 40 AND r.ms - w.since < 500 THEN 'TAP' ELSE '' END,
CASE WHEN NOT r.p AND w.down AND abs(w.moved) >= 25 THEN 0 ELSE w.x0 END, CASE WHEN NOT r.p AND w.down AND abs(w.moved) >= 25 THEN 0 ELSE w.y0 END, CASE WHEN NOT r.p AND w.down AND abs(w.moved) >= 25 THEN w.moved ELSE 0 END
FROM walk w JOIN r ON r.device = w.device AND r.k = w.k + 1)
SELECT device, ms AS ts_ms, type, x, y, dy FROM walk WHERE type <> ''""")
def touch_gestures(read):
    ms = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 10)
    samples = read("events").select(F.col("user_id").cast("string").alias("device"), ms.alias("ts_ms"), (F.col("event_id") % 5 != 0).alias("pressed"), (F.abs("value") % 320).cast("int").alias("x"), (F.abs("value") * 7 % 240).cast("int").alias("y"))
    return gestures.gestures(samples)


@query("""WITH RECURSIVE a AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, ['open', 'follow', 'follow', 'next', 'back', 'follow', 'image', 'tap', 'previous'][event_id % 9 + 1] AS action, event_id * 7 % 1000 AS target FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS k FROM a),
walk AS (SELECT session, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, '' AS action, 'SEARCH' AS screen, CAST(-1 AS BIGINT) AS article, 0 AS page, CAST([] AS BIGINT[]) AS history FROM (SELECT DISTINCT session FROM a)
UNION ALL SELECT w.session, r.k, r.seq, r.action,
CASE WHEN w.screen = 'SEARCH' THEN CASE WHEN r.action = 'open' THEN 'ARTICLE' ELSE 'SEARCH' END WHEN w.screen = 'IMAGE' THEN CASE WHEN r.action = 'tap' THEN 'ARTICLE' ELSE 'IMAGE' END
WHEN r.action = 'back' AND len(w.history) = 0 THEN 'SEARCH' WHEN r.action = 'image' THEN 'IMAGE' ELSE 'ARTICLE' END,
CASE WHEN w.screen = 'SEARCH' AND r.action = 'open' THEN r.target WHEN w.screen = 'ARTICLE' AND r.action = 'follow' THEN r.target WHEN w.screen = 'ARTICLE' AND r.action = 'back' THEN coalesce(w.history[-1], -1) ELSE w.article END,
CASE WHEN w.screen = 'SEARCH' AND r.action = 'open' THEN 0 WHEN w.screen <> 'ARTICLE' THEN w.page WHEN r.action IN ('follow', 'back') THEN 0 WHEN r.action = 'next' THEN w.page + 1 WHEN r.action = 'previous' THEN greatest(w.page - 1, 0) ELSE w.page END,
CASE WHEN w.screen = 'SEARCH' AND r.action = 'open' THEN CAST([] AS BIGINT[]) WHEN w.screen <> 'ARTICLE' THEN w.history WHEN r.action = 'follow' THEN list_append(w.history, w.article)[-30:] WHEN r.action = 'back' THEN w.history[:-2] ELSE w.history END
FROM walk w JOIN r ON r.session = w.session AND r.k = w.k + 1)
SELECT session, seq, action, screen, CASE WHEN article >= 0 THEN article END AS article_id, page, CAST(len(history) AS INTEGER) AS depth FROM walk WHERE k > 0""")
def reading_sessions(read):
    action = F.element_at(F.array(*map(F.lit, ("open", "follow", "follow", "next", "back", "follow", "image", "tap", "previous"))), (F.col("event_id") % 9 + 1).cast("int"))
    actions = read("events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") * 7 % 1000).alias("article_id"))
    return navigation.sessions(actions)


@query("""SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '/')[-1] AS base, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '') AS page_no,
page_id % 6 NOT IN (0, 1, 2, 5) AS internal, substr(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), 1, 36) AS shown FROM pages""")
def url_parts(read):
    path = F.parse_url("url", F.lit("PATH"))
    href = F.concat(F.element_at(F.array(*map(F.lit, ("https://", "#", "../", "", "/", "http"))), (F.col("page_id") % 6 + 1).cast("int")), F.regexp_replace(path, "^/+", ""), F.lit("x"))
    return read("pages").select("page_id", T.base_name(path).alias("base"), T.api_query("url", "page").alias("page_no"), T.is_internal_link(href).alias("internal"), T.result_row(T.html_escape("url")).alias("shown"))


@query("""WITH q AS (SELECT c_custkey, 'ab ' || lower(c_name) || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' firstofequal13 lastofequal145' WHEN 2 THEN ' ab' ELSE ' customer#00000000' END AS name FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'lastofequal14' WHEN 3 THEN 'customer#0000' ELSE substr(string_split(name, ' ')[2], 1, 13) END AS word FROM q""")
def query_words(read):
    more = F.element_at(F.array(*map(F.lit, ("", " FirstOfEqual13 LastOfEqual145", " ab", " Customer#00000000"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return read("customer").select("c_custkey", T.query_word(T.device_key(F.concat(F.lit(" ab "), "c_name", more))).alias("word"))
