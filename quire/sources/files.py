"""The catalog's binary files: records as Column expressions, whole files out and in.

Tables stay Parquet inside the engine; these files are for devices that read them. Tasks write and read parts of files side by side
(quire.sources.stores).
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from quire.functions.binary import little_endian
from quire.functions.text import cut_bytes, key_text, padded, title_key
from quire.schemas import SPARSE_KEY_BYTES, TITLE_ENTRY_BYTES, TITLE_KEY_BYTES, WORD_KEY_CHARS
from quire.sources.entries import records_of
from quire.sources.stores import count_of_files, fixed_records, ranges_of_files, read_bytes, write_parts

INDEX_RECORD, PLACE_RECORD, WORD_RECORD, TITLE_RECORD = 80, 12, 20, 32


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str, n: int) -> Column:
    """Unsigned little-endian bytes of a whole number."""
    h = F.lpad(F.hex(_c(x).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(n)]))


def index_record(key: Column | str, article_id: Column | str, offset: Column | str, length: Column | str) -> Column:
    return F.concat(padded(title_key(key), TITLE_KEY_BYTES), number(article_id, 4), number(offset, 4), number(length, 4), F.lit(b"\0" * 8))


def sparse_record(key: Column | str) -> Column:
    return padded(cut_bytes(key, SPARSE_KEY_BYTES), SPARSE_KEY_BYTES)


def place_record(chunk_id: Column | str, offset: Column | str, length: Column | str) -> Column:
    return F.concat(number(chunk_id, 4), number(offset, 4), number(length, 4))


def word_record(word: Column | str, start: Column | str, count: Column | str) -> Column:
    return F.concat(padded(cut_bytes(word, WORD_KEY_CHARS), WORD_KEY_CHARS + 1), number(start, 4), number(count, 2))


def title_record(title: Column | str) -> Column:
    return padded(cut_bytes(title, TITLE_ENTRY_BYTES), TITLE_ENTRY_BYTES + 1)


def unpadded(record: Column | str, n: int) -> Column:
    """The text in the first n bytes of a record, without the zero bytes at its end; broken characters become U+FFFD. Bytes are trimmed,
    as a broken character would take the first zero with it."""
    return key_text(F.unhex(F.regexp_replace(F.hex(F.substring(_c(record), 1, n)), "(00)+$", "")))


def index_fields(record: Column | str) -> list[Column]:
    """title_key, article_id, offset, length of an index record; broken characters of keys become U+FFFD."""
    return [unpadded(record, TITLE_KEY_BYTES).alias("title_key"), *[little_endian(record, TITLE_KEY_BYTES + 4 * k, 4).alias(c) for k, c in enumerate(("article_id", "offset", "length"))]]


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    """(pos, title_key, article_id, offset, length) of an index file."""
    return fixed_records(spark, path, INDEX_RECORD).select("pos", *index_fields("record"))


def place_rows(spark: SparkSession, path: str, id_col: str = "article_id") -> DataFrame:
    """(id, chunk_id, offset, length) of a file of places; the position is the id."""
    return fixed_records(spark, path, PLACE_RECORD).select(F.col("pos").alias(id_col), *[little_endian("record", 4 * k, 4).alias(c) for k, c in enumerate(("chunk_id", "offset", "length"))])


def title_rows(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, title31) of a title file, holes left out."""
    return fixed_records(spark, path, TITLE_RECORD).select(F.col("pos").alias("article_id"), unpadded("record", TITLE_RECORD).alias("title31")).where("title31 <> ''")


def word_rows(spark: SparkSession, path: str) -> DataFrame:
    """(word, article_ids) of a word file: a count and the place of the ids, word records, ids. Records are read by ranges, ids by place."""
    count, ids_at = struct.unpack("<II", read_bytes(path, 0, 8))
    words = fixed_records(spark, path, WORD_RECORD, 8, count).select(
        unpadded("record", WORD_KEY_CHARS + 1).alias("word"),
        little_endian("record", WORD_KEY_CHARS + 1, 4).alias("start"), little_endian("record", WORD_KEY_CHARS + 5, 2).alias("n"),
    )
    lists = ranges_of_files(words.select(F.col("word").alias("key"), F.lit(path).alias("path"), (F.lit(ids_at) + F.col("start") * 4).alias("offset"), (F.col("n") * 4).alias("length")))
    return lists.select(F.col("key").alias("word"), F.transform(records_of("data", 4), lambda x: little_endian(x, 0, 4)).alias("article_ids"))


def write_records(records: DataFrame, order: list[str], path: str, head: bytes = b"") -> int:
    """Writes the binary column "record" in order to one file of the store, after head; returns the number of records. Tasks write the
    ranges of the order side by side, and the commit joins them; a failed run leaves the old file."""
    seen = Observation()
    rows = records.where("record is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = rows.select(F.spark_partition_id().cast("long").alias("part"), F.col("record").alias("data"))
    folder, _, name = path.rpartition("/")
    write_parts(parts.observe(seen, F.count("data").alias("n")), folder, file=name, head=head.hex())
    return seen.get["n"]


def write_chunks(blobs: DataFrame, folder: str, stem: str) -> int:
    """Chunk files folder/stem_NNNN.dat of (chunk_id, offset, data), all written in one job, each by one task; files of higher numbers,
    from an earlier run, are deleted. Returns their number."""
    rows = blobs.repartition("chunk_id").sortWithinPartitions("chunk_id", "offset")
    write_parts(rows.select(F.col("chunk_id").cast("long").alias("part"), "data"), folder, stem=stem)
    return count_of_files(folder, stem)


def read_places(places: DataFrame, folder: str, stem: str, id_col: str = "article_id") -> DataFrame:
    """(id, data) of places (id, chunk_id, offset, length) in chunk files: only those bytes are read. Holes, of length 0, give no row."""
    number = F.lpad(F.col("chunk_id").cast("string"), F.greatest(F.lit(4), F.length(F.col("chunk_id").cast("string"))), F.lit("0"))
    wanted = places.where("length > 0").select(F.col(id_col).alias("key"), F.concat(F.lit(f"{folder}/{stem}_"), number, F.lit(".dat")).alias("path"), "offset", "length")
    return ranges_of_files(wanted).withColumnRenamed("key", id_col)


def write_words(words: DataFrame, path: str) -> None:
    """The word file of (word, article_ids, ids_count, ids_start)."""
    n = words.count()
    parts = words.select(F.lit(0).alias("part"), F.col("word"), F.lit(0).alias("k"), word_record("word", "ids_start", "ids_count").alias("record"))
    ids = words.select(F.lit(1).alias("part"), F.col("word"), F.posexplode("article_ids").alias("k", "id")).select("part", "word", "k", number("id", 4).alias("record"))
    write_records(parts.unionByName(ids), ["part", "word", "k"], path, n.to_bytes(4, "little") + (8 + n * WORD_RECORD).to_bytes(4, "little"))


def write_metadata(meta: DataFrame, path: str) -> None:
    """(key, value) rows as key=value lines."""
    write_records(meta.select(F.concat("key", F.lit("="), "value", F.lit("\n")).cast("binary").alias("record"), "key"), ["key"], path)


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts, as a service answers."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
