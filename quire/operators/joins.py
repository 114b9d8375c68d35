"""Joins of the catalog: links, pictures, holes and points in rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.text import image_candidates, is_internal_link, link_target
from quire.schemas import SCREEN_WIDTH


def resolved_links(links: DataFrame, title_map: DataFrame) -> DataFrame:
    """links (.., href) with internal, target (normalised title of internal ones) and article_id (null if unknown)."""
    internal = is_internal_link("href")
    named = links.withColumn("internal", internal).withColumn("target", F.when(internal, link_target("href")))
    known = title_map.select(F.col("title_norm").alias("target"), "article_id")
    return named.join(known, "target", "left")


def resolved_images(sources: DataFrame, image_info: DataFrame, keys: list[str]) -> DataFrame:
    """sources (keys.., src) with img_id, w, h of the first candidate key that is known; rows without one are left out.

    Neither side is broadcast: the sizes of files say nothing of the candidates, five for each source, and both sides grow.
    """
    tried = sources.select(*keys, "src", F.posexplode(image_candidates("src")).alias("pos", "key"))
    hit = tried.join(image_info.hint("merge"), "key")
    best = F.min_by(F.struct("img_id", "w", "h"), "pos")
    return hit.groupBy(*keys, "src").agg(best.alias("i")).select(*keys, "src", "i.img_id", "i.w", "i.h")


def image_names(images: DataFrame) -> DataFrame:
    """(key, img_id, w, h) under which pictures (img_id, path, w, h) are known: their path (the last of equal paths), and their base
    name (the first of equal names) unless that is a path."""
    key = lambda x, whole: F.struct(x.alias("key"), F.lit(whole).alias("whole"))
    keys = F.explode(F.array(key(F.col("path"), True), key(F.substring_index("path", "/", -1), False))).alias("k")
    known = images.select(keys, F.struct("img_id", "w", "h").alias("v")).select("k.key", "k.whole", "v")
    path, base = F.when(F.col("whole"), F.col("v.img_id")), F.when(~F.col("whole"), F.col("v.img_id"))
    both = known.groupBy("key").agg(F.coalesce(F.max_by("v", path), F.min_by("v", base)).alias("v"))
    return both.select("key", "v.img_id", "v.w", "v.h")


def dense(rows: DataFrame, id_col: str, last: int | None, fill: dict[str, int]) -> DataFrame:
    """One row for each id from 0 to last (by default the largest), holes filled."""
    spark = rows.sparkSession
    top = last if last is not None else rows.agg(F.max(id_col)).first()[0]
    ids = spark.range(0, 0 if top is None else top + 1).withColumnRenamed("id", id_col)
    return ids.join(rows, id_col, "left").fillna(fill)


def holes(rows: DataFrame, id_col: str, last: int) -> DataFrame:
    """Ids from 0 to last that rows lack."""
    return rows.sparkSession.range(0, last + 1).withColumnRenamed("id", id_col).join(rows.select(id_col), id_col, "left_anti")


CELL = 32


def hits(points: DataFrame, rects: DataFrame) -> DataFrame:
    """points (.., x, y) with the rect_id of the first rectangle (rect_id, left, top, width, height) over each; others are left out.

    An equality join on the cells of a grid, so that no point meets rectangles elsewhere.
    """
    spread = lambda a, n: F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(a) + F.col(n) - 1) / CELL))
    tiles = rects.where("width > 0 and height > 0").withColumn("cx", F.explode(spread("left", "width"))).withColumn("cy", F.explode(spread("top", "height")))
    keyed = points.withColumn("cx", F.floor(F.col("x") / CELL)).withColumn("cy", F.floor(F.col("y") / CELL))
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("width")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("height"))
    return keyed.join(tiles, ["cx", "cy"]).where(inside).groupBy(*points.columns).agg(F.min("rect_id").alias("rect_id"))


def tapped(taps: DataFrame, links: DataFrame, images: DataFrame, width: int = SCREEN_WIDTH) -> DataFrame:
    """taps (.., page, x, y) on pages with the picture (img_id) or link (article_id) that each hits; others are left out.

    links (page, seq, x, y, w, h, article_id) and images (page, seq, doc_y, thumb_h, img_id) are regions in page order.  A picture
    takes the whole width of its rows and comes before any link; else the first region counts. A grid join on page and cell.
    """
    none = F.lit(None).cast("long")
    pictures = images.select("page", F.lit(0).alias("kind"), "seq", F.lit(0).alias("left"), F.col("doc_y").alias("top"), F.lit(width).alias("w"), F.col("thumb_h").alias("h"), "img_id", none.alias("article_id"))
    texts = links.select("page", F.lit(1).alias("kind"), "seq", F.col("x").alias("left"), F.col("y").alias("top"), "w", "h", none.alias("img_id"), "article_id")
    spread = lambda a, n: F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(a) + F.col(n) - 1) / CELL))
    regions = pictures.unionByName(texts).where("w > 0 and h > 0").withColumn("cx", F.explode(spread("left", "w"))).withColumn("cy", F.explode(spread("top", "h")))
    keyed = taps.withColumn("cx", F.floor(F.col("x") / CELL)).withColumn("cy", F.floor(F.col("y") / CELL))
    within = F.expr("x >= left and x < left + w and y >= top and y < top + h")
    first = F.min_by(F.struct("img_id", "article_id"), F.struct("kind", "seq")).alias("hit")
    return keyed.join(regions, ["page", "cx", "cy"]).where(within).groupBy(*taps.columns).agg(first).select(*taps.columns, "hit.img_id", "hit.article_id")
