"""The index of a catalog in blocks of its key order, kept between searches.

A sparse table has the first bytes of each block's first key; the blocks lie in folders by run of blocks, so that the few blocks which a
search picks from the sparse table prune the folders that are read.  Beside them is a row that says of which index they were made, and
how: opening a catalog whose index has been published anew, or that never had blocks, or with other sizes, makes them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import normalise_title
from quire.operators import ordering
from quire.plans.catalog import sparse_key
from quire.schemas import API_RESULTS, SPARSE_BLOCKS, SPARSE_KEY_BYTES, SPARSE_STEP
from quire.sources.versions import Build, current

RUN = 256  # blocks in a folder
TABLES = ("index_blocks", "index_sparse", "index_version")


@dataclass
class BlockIndex:
    blocks: DataFrame  # title_key, article_id, pos, block, run
    sparse: DataFrame  # block, run, sparse_key
    rebuilt: bool  # whether opening had to make it

    @classmethod
    def opened(cls, spark: SparkSession, path: str, step: int = SPARSE_STEP, run: int = RUN) -> BlockIndex:
        """The blocks of the catalog under path, made and published if they are not those of its index."""
        found = current(spark, path)
        wanted = (found["index"], step, run)
        read = lambda name: spark.read.parquet(f"{path}/{found[name]}")
        stale = any(name not in found for name in TABLES) or tuple(read("index_version").select("source", "step", "run").first()) != wanted
        if stale:
            build = Build(spark, path)
            keys = spark.read.parquet(f"{path}/{found['index']}").select("title_key", "article_id")
            placed = ordering.with_text_position(keys, "title_key", "pos", ("article_id",)).withColumn("block", F.floor(F.col("pos") / step))
            placed = placed.withColumn("run", F.floor(F.col("block") / run)).repartition("run").sortWithinPartitions("run", "pos")
            blocks = build.keep(placed, "index_blocks", partitionBy="run")
            build.keep(blocks.where(F.col("pos") % step == 0).select("block", F.col("run").cast("long").alias("run"), sparse_key("title_key").alias("sparse_key")), "index_sparse")
            build.keep(spark.createDataFrame([wanted], "source string, step int, run int"), "index_version")
            build.publish()
            found = current(spark, path)
        return cls(read("index_blocks"), read("index_sparse"), stale)

    def contains(self, query: str, n: int = API_RESULTS, most_blocks: int = SPARSE_BLOCKS) -> DataFrame:
        """(article_id, title) in key order, of keys that hold the query elsewhere than at their start, in the first most_blocks blocks
        whose sparse key holds the query's first word so."""
        q = normalise_title(F.lit(query))
        head = F.substring(F.substring_index(q, " ", 1), 1, SPARSE_KEY_BYTES)
        likely = self.sparse.where(F.col("sparse_key").contains(head) & ~F.col("sparse_key").startswith(F.substring(q, 1, SPARSE_KEY_BYTES)) & (q != ""))
        picked = likely.orderBy("block").limit(most_blocks).select("block", F.col("run").cast(self.blocks.schema["run"].dataType).alias("run"))
        rows = self.blocks.join(F.broadcast(picked), ["run", "block"])  # most_blocks rows
        return rows.where(F.col("title_key").contains(q) & ~F.col("title_key").startswith(q)).orderBy("pos").limit(n).select("article_id", F.col("title_key").alias("title"))
