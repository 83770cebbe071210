"""Rows that are one: readings of a page, rows of several desks, moments in other words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import components


def instant_key(said: Column) -> Column:
    """The moment that a text states, to the second, or else the text itself."""
    moment = F.coalesce(F.try_to_timestamp(said, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(said, F.lit("yyyy-MM-dd")), F.try_to_timestamp(said))
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), said)


def first_known(column: str, pos: str, where: Column | None = None) -> Column:
    """The value of the first row that states it."""
    known = F.col(column).isNotNull() if where is None else F.col(column).isNotNull() & where
    return F.min(F.when(known, F.struct(pos, column)))[column]


def same_page(rows: DataFrame) -> DataFrame:
    """page, key and one reading of `rows` (page, pos, url, title, day, place, kind, stated): the first title, the first stated place, a stated kind before a defaulted one."""
    own = F.when(F.col("url").isNotNull(), F.concat(F.lit("u"), "url")).otherwise(F.concat(F.lit("t"), F.lower("title")))
    keyed = rows.withColumn("key", F.concat(own, F.lit("|"), F.coalesce("day", F.lit(""))))
    return keyed.groupBy("page", "key").agg(
        F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.min_by("title", "pos").alias("title"), first_known("place", "pos").alias("place"),
        F.coalesce(first_known("kind", "pos", F.col("stated")), first_known("kind", "pos")).alias("kind"))


def desk_union(rows: DataFrame) -> DataFrame:
    """grp and one happening of `rows` (pos, desk, night, place, title, performer, kind, stated): rows of one night and place with one title or one performer, and whatever these join.

    A missing part joins nothing: a row without night or place, or with neither title nor performer, stays alone. The first
    row owns the title; a stated kind beats a defaulted one; `titles` counts the titles that a performer has brought together.
    """
    part = lambda c: F.nullif(F.trim(F.lower(F.col(c).cast("string"))), F.lit(""))
    known = part("night").isNotNull() & part("place").isNotNull()
    key = lambda tag, c: F.when(known & part(c).isNotNull(), F.concat_ws("~", part("night"), part("place"), F.concat(F.lit(tag), part(c))))
    keyed = rows.withColumn("by_performer", key("p:", "performer")).withColumn("by_title", key("t:", "title"))
    keyed = keyed.withColumn("own", F.coalesce("by_performer", "by_title"))
    found = components(keyed.select(F.col("by_performer").alias("src"), F.col("by_title").alias("dst")), keyed.select(F.col("own").alias("id")).where("id is not null"))
    grouped = keyed.join(found, F.col("own") == F.col("id"), "left").withColumn("grp", F.coalesce("component", F.concat(F.lit("row:"), F.col("pos").cast("string"))))
    return grouped.groupBy("grp").agg(
        F.count("*").alias("members"), F.count_distinct("desk").alias("desks"), F.min("pos").alias("first_pos"), F.min_by("title", "pos").alias("title"), F.count_distinct(part("title")).alias("titles"),
        F.coalesce(first_known("kind", "pos", F.col("stated")), first_known("kind", "pos")).alias("kind"))
