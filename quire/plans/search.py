"""The query surface of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.binary import unpacked_articles
from quire.functions.text import device_key, normalise_title, query_word
from quire.schemas import API_RESULTS, SERVER_RESULTS, SPARSE_BLOCKS, SPARSE_KEY_BYTES, SPARSE_STEP, UI_RESULTS
from quire.sources.files import read_places


class SearchEngine:
    """Searches over index (title_key, article_id, ..), words (word, article_ids) and title31 (article_id, title31).

    Queries are folded as titles are; with device_compat as the device does it (ASCII case only, inner blanks kept).
    """

    def __init__(self, index: DataFrame, words: DataFrame | None = None, title31: DataFrame | None = None, device_compat: bool = False):
        self.index, self.words, self.title31 = index, words, title31
        self.fold = device_key if device_compat else normalise_title

    def _q(self, query: str | Column) -> Column:
        return self.fold(F.lit(query) if isinstance(query, str) else query)

    def exact(self, query: str | Column) -> DataFrame:
        """The article of this title; of titles with equal keys the least id."""
        return self.index.where((F.col("title_key") == self._q(query)) & (self._q(query) != "")).orderBy("article_id").limit(1).select("article_id", F.col("title_key").alias("title"))

    def prefix(self, query: str, n: int = API_RESULTS) -> DataFrame:
        """The first titles, in byte order, that begin with the query. The filter reaches the scan."""
        found = self.index.where(F.col("title_key").startswith(self._q(query)) & (self._q(query) != ""))
        return found.orderBy("title_key", "article_id").limit(n).select("article_id", F.col("title_key").alias("title"))

    def contains(self, query: str, n: int = API_RESULTS) -> DataFrame:
        """Titles, by article id, that hold the query elsewhere than at their start: those of the query word's postings."""
        q = self._q(query)
        row = self.words.where(F.col("word") == query_word(q)).select(F.explode("article_ids").alias("article_id"))
        found = row.join(self.title31, "article_id").where(F.col("title31").contains(q) & ~F.col("title31").startswith(q))
        return found.orderBy("article_id").limit(n).select("article_id", F.col("title31").alias("title"))

    def contains_by_blocks(self, query: str, sparse: DataFrame, placed: DataFrame, step: int = SPARSE_STEP, n: int = API_RESULTS) -> DataFrame:
        """The same without word index: only blocks of the index whose sparse key holds the query's first word count, 15 at most.
        placed: the index with pos, the place in key order."""
        q = self._q(query)
        head = F.substring(F.substring_index(q, " ", 1), 1, SPARSE_KEY_BYTES)
        likely = sparse.where(F.col("sparse_key").contains(head) & ~F.col("sparse_key").startswith(F.substring(q, 1, SPARSE_KEY_BYTES)) & (q != ""))
        blocks = likely.orderBy("pos").limit(SPARSE_BLOCKS).select(F.col("pos").alias("block"))
        rows = placed.withColumn("block", (F.col("pos") / step).cast("long")).join(blocks, "block")
        found = rows.where(F.col("title_key").contains(q) & ~F.col("title_key").startswith(q))
        return found.orderBy("pos").limit(n).select("article_id", F.col("title_key").alias("title"))

    def go(self, query: str, n: int = UI_RESULTS) -> DataFrame:
        """(section, rank, article_id, title): section 0 titles that begin with the query, 2 those that hold it, with a divider (no
        article) as section 1 between them if there are any; a first title that is the query stands alone."""
        ranked = lambda df, section, *order: df.withColumns({"section": F.lit(section), "rank": F.row_number().over(_window(order))})
        first = ranked(self.prefix(query, n), 0, "title", "article_id")
        second = ranked(self.contains(query, n), 2, "article_id")
        divider = second.where("rank = 1").select(F.lit(None).cast("long").alias("article_id"), F.lit("").alias("title"), F.lit(1).alias("section"), F.lit(1).alias("rank"))
        hit = first.where((F.col("rank") == 1) & (F.trim("title") == self._q(query))).agg((F.count("*") > 0).alias("hit"))
        every = first.unionByName(divider).unionByName(second).crossJoin(F.broadcast(hit))  # one row
        return every.where(~F.col("hit") | ((F.col("section") == 0) & (F.col("rank") == 1))).select("section", "rank", "article_id", "title")

    def desktop(self, query: str, n: int = SERVER_RESULTS) -> DataFrame:
        """(section, article_id, title): titles that begin with the query, then those that hold it, by lower-cased title."""
        q = F.lower(F.trim(F.lit(query)))
        section = F.when(F.col("title_key").startswith(q), 0).when(F.col("title_key").contains(q), 1)
        found = self.index.select(section.alias("section"), "article_id", F.col("title_key").alias("title")).where(F.col("section").isNotNull() & (q != ""))
        return found.orderBy("section", F.lower("title"), "article_id").limit(n)

    def info(self, name: Column | str = "") -> DataFrame:
        return self.index.agg(F.count("*").alias("article_count")).withColumn("db_name", F.lit(name) if isinstance(name, str) else name)


def _window(order):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def article_block(articles: DataFrame, article_id: int, block: int) -> DataFrame:
    """(article_id, title, block_num, num_blocks, data): a block; no row where id or block are out of range."""
    read = articles.where(F.col("article_id") == article_id).select(unpacked_articles("data").alias("a")).select("a.*")
    rows = read.select("article_id", "title", F.size("blocks").alias("num_blocks"), F.posexplode("blocks").alias("block_num", "data"))
    return rows.where(F.col("block_num") == block).select("article_id", "title", "block_num", "num_blocks", "data")


def full_article(articles: DataFrame, article_id: int) -> DataFrame:
    """(article_id, title, html): all blocks in one; characters that a cut had split are whole again."""
    read = articles.where((F.col("article_id") == article_id) & (F.octet_length("data") > 0)).select(unpacked_articles("data").alias("a")).select("a.*")
    whole = F.aggregate("blocks", F.lit(b""), lambda a, b: F.concat(a, b))
    return read.where(F.col("article_id").isNotNull()).select("article_id", "title", F.make_valid_utf8(whole.cast("string")).alias("html"))


def image(images: DataFrame, img_id: int, most: int = 200_000) -> DataFrame:
    """The picture of an id, if it is there and of 1 to most bytes."""
    size = F.octet_length("data")
    return images.where((F.col("img_id") == img_id) & (size > 0) & (size <= most)).select("img_id", "data")


def chunk_slice(chunks: DataFrame, places: DataFrame, id_col: str) -> DataFrame:
    """(id, data) of places (id, chunk_id, offset, length) in chunks (chunk_id, content)."""
    data = F.substring("content", (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return places.where("length > 0").join(chunks, "chunk_id").select(id_col, data.alias("data"))


def article_at(chunks: DataFrame, ids: DataFrame, article_id: int) -> DataFrame:
    """(article_id, title, html) of an entry read by its place (chunk_id, offset, length) in chunk files (chunk_id, content); no row
    for holes and ids out of range."""
    return full_article(chunk_slice(chunks, ids.where(F.col("article_id") == article_id), "article_id"), article_id)


def article_in_files(ids: DataFrame, folder: str, stem: str, article_id: int) -> DataFrame:
    """The same from chunk files folder/stem_NNNN.dat, of which only the entry's bytes are read."""
    return full_article(read_places(ids.where(F.col("article_id") == article_id), folder, stem), article_id)


def window_of_results(results: DataFrame, order: list[str], scroll: int, height: int, row: int = 18) -> DataFrame:
    """The rows of a result list that a view of this height shows from a scroll position on."""
    return results.orderBy(*order).offset(scroll).limit(height // row)
