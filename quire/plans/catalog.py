"""Building the catalog: title map, cleaned and packed articles, sorted index, word index, pictures and metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.functions import html as H, images as I, raster
from quire.functions.binary import packed_articles
from quire.functions.geometry import fitted
from quire.functions.text import cut_bytes, display_name, key_text, normalise_title, title_key, title_or_path, title_words
from quire.operators import joins, ordering
from quire.operators.staging import shuffle_partitions, staged
from quire.schemas import ARTICLE_CHUNK_BYTES, BLOCK_BYTES, IMAGE_CHUNK_BYTES, JPEG_QUALITY, MAX_ARTICLE_BYTES, POSTING_CAP, SPARSE_KEY_BYTES, SPARSE_STEP, THUMB_HEIGHT, THUMB_WIDTH, TITLE_ENTRY_BYTES
from quire.sources.entries import is_article_entry
from quire.sources.versions import Build, current, table


def title_map(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """(title_norm, article_id, entry_id): normalised titles of articles, numbered in order of first appearance."""
    norm = normalise_title(title_or_path("title", "path"))
    named = entries.where(is_article_entry()).select("entry_id", norm.alias("title_norm")).where("title_norm <> ''")
    first = named.groupBy("title_norm").agg(F.min("entry_id").alias("entry_id"))
    out = ordering.with_position(first, F.col("entry_id"), "article_id").select("title_norm", F.col("article_id").cast("long"), "entry_id")
    return out if limit is None else out.where(F.col("article_id") < limit)


def index_records(titles: DataFrame, places: DataFrame) -> DataFrame:
    """(title_key text, article_id, chunk_id, offset, length) of written articles."""
    keyed = titles.select(key_text(title_key("title_norm")).alias("title_key"), "article_id")
    return keyed.join(places.withColumnRenamed("id", "article_id"), "article_id").select("title_key", "article_id", "chunk_id", "offset", "length")


def sparse_key(key: Column | str) -> Column:
    """The first bytes of a key; a broken last character becomes U+FFFD."""
    return F.make_valid_utf8(cut_bytes(key, SPARSE_KEY_BYTES).cast("string"))


def sparse_index(index: DataFrame, step: int = SPARSE_STEP) -> DataFrame:
    """(pos, sparse_key): the first bytes of every step-th key of the sorted index."""
    placed = ordering.with_text_position(index.select("title_key", "article_id"), "title_key", "pos", ("article_id",))
    return placed.where(F.col("pos") % step == 0).select((F.col("pos") / step).cast("long").alias("pos"), sparse_key("title_key").alias("sparse_key"))


def id_index(places: DataFrame) -> DataFrame:
    """(article_id, chunk_id, offset, length) for every id up to the largest; holes are zeros."""
    rows = places.select(F.col("id").alias("article_id"), "chunk_id", "offset", "length")
    return joins.dense(rows, "article_id", None, {"chunk_id": 0, "offset": 0, "length": 0})


def postings(pairs: DataFrame, cap: int = POSTING_CAP) -> DataFrame:
    """The cap least articles of each word of (word, article_id). Partial limits keep frequent words from piling up."""
    rank = F.row_number().over(Window.partitionBy("word").orderBy("article_id"))
    return pairs.withColumn("r", rank).where(F.col("r") <= cap).drop("r")


def grouped_postings(pairs: DataFrame, cap: int = POSTING_CAP) -> DataFrame:
    """(word, article_ids): sorted postings. A filter on the word goes down to the pairs."""
    return postings(pairs, cap).groupBy("word").agg(F.array_sort(F.collect_list("article_id")).alias("article_ids"))


def listed_postings(pairs: DataFrame, cap: int = POSTING_CAP) -> DataFrame:
    """(word, article_ids, ids_count, ids_start): sorted postings, and where they begin in the list of all postings by word."""
    return ordering.with_text_running_total(grouped_postings(pairs, cap).withColumn("ids_count", F.size("article_ids")), "word", "ids_count", "ids_start")


def word_index(titles: DataFrame, cap: int = POSTING_CAP) -> DataFrame:
    """The postings of the words of titles as the index has them, cut to 60 bytes."""
    return listed_postings(titles.select(F.explode(title_words(key_text(title_key("title_norm")))).alias("word"), "article_id"), cap)


def title_index(titles: DataFrame) -> DataFrame:
    """(article_id, title31): titles cut to 31 bytes."""
    return titles.select("article_id", key_text(cut_bytes(F.make_valid_utf8(title_key("title_norm").cast("string")), TITLE_ENTRY_BYTES)).alias("title31"))


def image_table(image_entries: DataFrame, width: int = THUMB_WIDTH, height: int = THUMB_HEIGHT) -> DataFrame:
    """(img_id, entry_id, path, diagram, w, h) of the pictures that are kept, in entry order, at the size they are stored in."""
    kept = image_entries.where(I.is_image_entry("path", "mimetype", "is_redirect") & I.is_large_enough("mimetype", "orig_w", "orig_h"))
    w, h = fitted("orig_w", "orig_h", width, height)
    shown = kept.select("entry_id", "path", I.is_diagram("path", "mimetype", "colours").alias("diagram"), w.alias("w"), h.alias("h"))
    return ordering.with_position(shown, F.col("entry_id"), "img_id").select(F.col("img_id").cast("long"), "entry_id", "path", "diagram", "w", "h")


def stored_pictures(image_entries: DataFrame, width: int = THUMB_WIDTH, height: int = THUMB_HEIGHT, quality: int = JPEG_QUALITY) -> DataFrame:
    """(img_id, entry_id, path, diagram, w, h, data) of picture entries (with content): decoded, fitted, encoded, numbered in entry order."""
    wanted = image_entries.where(I.is_image_entry("path", "mimetype", "is_redirect")).select("entry_id", "path", "mimetype", "content")
    made = wanted.mapInArrow(raster.prepare(width, height, quality), raster.PREPARED).where(I.is_large_enough("mimetype", "orig_w", "orig_h"))
    return made.select("entry_id", "path", "diagram", "w", "h", "data")


def numbered_pictures(pictures: DataFrame) -> DataFrame:
    """Pictures with img_id in front, their place in entry order; only entry ids are put in order, the data is joined to them."""
    ids = ordering.with_position(pictures.select("entry_id"), "entry_id", "img_id").select("entry_id", F.col("img_id").cast("long").alias("img_id"))
    return pictures.join(ids, "entry_id").select("img_id", *pictures.columns)


def counters(titles: DataFrame, articles: DataFrame, places: DataFrame) -> DataFrame:
    """One row on a build: titles, articles written and skipped, bytes, chunks, entries of the sparse index."""
    found = titles.select("article_id").join(places.select(F.col("id").alias("article_id"), "length", "chunk_id"), "article_id", "left")
    made = found.agg(F.count("*").alias("titles"), F.count("length").alias("written"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), F.coalesce(F.max("chunk_id") + 1, F.lit(0)).alias("chunks"))
    return made.select("titles", "written", (F.col("titles") - F.col("written")).alias("skipped"), "total_bytes", "chunks", (F.floor(F.col("written") / SPARSE_STEP) + 1).alias("sparse_entries"))


@dataclass
class Catalog:
    """Tables of one catalog."""

    titles: DataFrame
    articles: DataFrame  # article_id, title, data
    index: DataFrame
    ids: DataFrame
    sparse: DataFrame
    words: DataFrame
    title31: DataFrame
    meta: DataFrame
    images: DataFrame | None = None
    skipped: DataFrame | None = None


@dataclass
class CatalogBuilder:
    """Options of a build. write() makes all of a catalog, write_images() and write_words() only those parts of it."""

    limit: int | None = None
    sparse_step: int = SPARSE_STEP
    block_bytes: int = BLOCK_BYTES
    chunk_bytes: int = ARTICLE_CHUNK_BYTES
    image_chunk_bytes: int = IMAGE_CHUNK_BYTES
    posting_cap: int = POSTING_CAP
    thumb: tuple[int, int] = (THUMB_WIDTH, THUMB_HEIGHT)
    jpeg_quality: int = JPEG_QUALITY
    with_images: bool = True
    name: str = ""

    def cleaned(self, entries: DataFrame, titles: DataFrame, image_info: DataFrame | None = None) -> DataFrame:
        """(article_id, title, html): of each title's first entry. Pages are parsed once, to texts with holes; joins resolve what the
        holes name, links and pictures, and another pass fills them."""
        title = title_or_path("title", "path", decode=False)
        named = entries.where(is_article_entry()).select("entry_id", title.alias("title"), normalise_title(title).alias("title_norm"))
        chosen = named.groupBy("title_norm").agg(F.min("entry_id").alias("entry_id"), F.min_by("title", "entry_id").alias("title"))
        chosen = chosen.join(titles.select("title_norm", "article_id"), "title_norm").select("entry_id", "article_id", "title")
        spread = entries.repartition(shuffle_partitions(entries.sparkSession), "entry_id")  # the join's own shuffle; parsing is spread even if it needs none
        pages = spread.join(chosen.select("entry_id", "article_id", F.col("title").alias("shown")), "entry_id").select("article_id", F.col("shown").alias("title"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
        parsed = staged(pages.select("article_id", "title", H.skeletons("html").alias("s")).select("article_id", "title", "s.parts", "s.holes"), "skeletons")
        wanted = parsed.select("article_id", F.explode(H.hole_keys("holes", "a")).alias("title_norm"))
        known = wanted.join(titles.select("title_norm", F.col("article_id").alias("target")), "title_norm")
        targets = known.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("title_norm", "target"))).alias("targets"))
        out = parsed.join(targets, "article_id", "left")
        if image_info is not None:
            sources = parsed.select("article_id", F.explode(H.hole_keys("holes", "img")).alias("src"))
            found = joins.resolved_images(sources, image_info, ["article_id"])
            shown = found.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("src", F.struct("img_id", "w", "h")))).alias("images"))
            out = out.join(shown, "article_id", "left")
        else:
            out = out.withColumn("images", F.lit(None).cast("map<string,struct<img_id:bigint,w:int,h:int>>"))
        return out.select("article_id", "title", H.filled("parts", "holes", "targets", "images").alias("html"))

    def packed(self, cleaned: DataFrame) -> DataFrame:
        """(article_id, title, data): blobs; those over the size limit are left out."""
        blobs = cleaned.select("article_id", "title", packed_articles(self.block_bytes)("article_id", "title", "html").alias("data"))
        return blobs.where(F.octet_length("data") <= MAX_ARTICLE_BYTES)

    def image_info(self, image_entries: DataFrame) -> DataFrame:
        return joins.image_names(image_table(image_entries, *self.thumb))

    def build(self, entries: DataFrame, image_entries: DataFrame | None = None) -> Catalog:
        titles = title_map(entries, self.limit)
        info = self.image_info(image_entries) if self.with_images and image_entries is not None else None
        articles = self.packed(self.cleaned(entries, titles, info))
        return self.assemble(titles, articles, image_table(image_entries, *self.thumb) if info is not None else None)

    def assemble(self, titles: DataFrame, articles: DataFrame, images: DataFrame | None = None, places: DataFrame | None = None) -> Catalog:
        if places is None:
            places = self.places(articles)
        index = index_records(titles, places)
        written = titles.join(articles.select("article_id"), "article_id", "left_semi")
        counts = places.agg(F.count("*").alias("article_count"), (F.coalesce(F.max("chunk_id"), F.lit(0)) + 1).alias("chunk_count"))
        settings = {"record_size": 80, "chunk_size": self.chunk_bytes, "sparse_step": self.sparse_step, "sparse_key_len": SPARSE_KEY_BYTES}
        meta = _settings(counts, settings, {"db_name": display_name(F.lit(self.name))})
        skipped = titles.join(articles.select("article_id"), "article_id", "left_anti")
        return Catalog(titles, articles, index, id_index(places), sparse_index(index, self.sparse_step), word_index(written, self.posting_cap), title_index(written), meta, images, skipped)

    def places(self, articles: DataFrame) -> DataFrame:
        """(id, length, chunk_id, offset) of blobs."""
        return ordering.chunked(articles.select(F.col("article_id").alias("id"), F.octet_length("data").cast("long").alias("length")), self.chunk_bytes)

    def write(self, entries: DataFrame, path: str, image_entries: DataFrame | None = None) -> None:
        """All tables under path, published together at the end: articles by chunk, the index sorted by key, so that prefixes skip row
        groups. A build that fails leaves what was published before."""
        build = Build(entries.sparkSession, path)
        keep = build.keep
        titles = keep(title_map(entries, self.limit), "titles")
        info = None
        if self.with_images and image_entries is not None:
            info = joins.image_names(self._kept_images(image_entries, build))
        blobs = keep(self.packed(self.cleaned(entries, titles, info)), "blobs")
        places = keep(self.places(blobs), "places")
        made = self.assemble(titles, blobs, None, places)
        index = keep(made.index.repartitionByRange("title_key", "article_id").sortWithinPartitions("title_key", "article_id"), "index")
        keep(blobs.join(index.select("article_id", "chunk_id", "offset"), "article_id").repartition("chunk_id"), "articles", partitionBy="chunk_id")
        keep(sparse_index(index, self.sparse_step), "sparse")
        for name, df in (("ids", made.ids), ("words", made.words), ("title31", made.title31), ("meta", made.meta)):
            keep(df, name)
        build.publish()

    def write_images(self, image_entries: DataFrame, path: str) -> DataFrame:
        """Pictures only; articles stay as they are. Entries with content are decoded and stored, others give their sizes alone."""
        build = Build(image_entries.sparkSession, path)
        images = self._kept_images(image_entries, build)
        build.publish()
        return images

    def _kept_images(self, image_entries: DataFrame, build: Build) -> DataFrame:
        if "content" not in image_entries.columns:
            return build.keep(image_table(image_entries, *self.thumb), "images")
        images = build.keep(numbered_pictures(build.keep(stored_pictures(image_entries, *self.thumb, self.jpeg_quality), "pictures")), "images")
        places = build.keep(image_chunks(images, self.image_chunk_bytes), "image_places")
        counts = places.agg(F.count("*").alias("image_count"), F.coalesce(F.max("chunk_id") + 1, F.lit(0)).alias("chunk_count"))
        build.keep(_settings(counts, {"chunk_size": self.image_chunk_bytes}), "image_meta")
        return images

    def write_words(self, spark: SparkSession, path: str) -> None:
        """Word and title index only, from the stored index."""
        build, keys = Build(spark, path), table(spark, path, "index").select(F.col("title_key").alias("title_norm"), "article_id")
        build.keep(word_index(keys, self.posting_cap), "words")
        build.keep(title_index(keys), "title31")
        build.publish()


def _settings(counts: DataFrame, fixed: dict[str, int], more: dict[str, Column] | None = None) -> DataFrame:
    """(key, value) rows: the columns of a one-row table, and fixed settings."""
    pairs = [(F.lit(k), F.col(k).cast("string")) for k in counts.columns] + [(F.lit(k), F.lit(str(v))) for k, v in fixed.items()]
    pairs += [(F.lit(k), v) for k, v in (more or {}).items()]
    return counts.select(F.explode(F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[v for _, v in pairs]))).alias("key", "value"))


def load(spark: SparkSession, path: str) -> Catalog:
    """The catalog published last under path."""
    found = current(spark, path)
    read = lambda name: spark.read.parquet(f"{path}/{found[name]}")
    images = read("images") if "images" in found else spark.createDataFrame([], "img_id long, entry_id long, path string, diagram boolean, w int, h int, data binary")
    return Catalog(*map(read, ("titles", "articles", "index", "ids", "sparse", "words", "title31", "meta")), images)


def image_chunks(images: DataFrame, limit: int = IMAGE_CHUNK_BYTES) -> DataFrame:
    """(img_id, length, chunk_id, offset) of pictures (img_id, data)."""
    return ordering.chunked(images.select(F.col("img_id").alias("id"), F.octet_length("data").cast("long").alias("length")), limit).withColumnRenamed("id", "img_id")


def sizes(articles: DataFrame, data_col: str = "data", step: int = SPARSE_STEP) -> DataFrame:
    """One row: number, total and average kB, MB of the index, entries and kB of the sparse index."""
    n, total = F.count(data_col), F.coalesce(F.sum(F.octet_length(data_col)), F.lit(0))
    entries = F.floor(n / step) + 1
    return articles.agg(n.alias("articles"), total.alias("total_bytes"), (total / 1024 / F.nullif(n, F.lit(0))).alias("average_kb"), (n * 80 / 1048576).alias("index_mb"), entries.alias("sparse_entries"), (entries * SPARSE_KEY_BYTES / 1024).alias("sparse_kb"))
