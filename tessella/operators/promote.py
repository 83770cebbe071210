"""Promotion, fills and ingest: what a batch writes, worked out as one table before any sink is touched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def promote(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """`fresh` (id, venue, title, start, ready) with outcome (promoted, duplicate or held) and event_id.

    A ready candidate is a duplicate of a stored event of the same venue, title and start, else of the
    first ready candidate of its own batch; of several stored ones the least id.
    """
    key = ["venue", "title", "start"]
    twins = stored.groupBy(*key).agg(F.min("id").alias("twin"))
    first = F.min(F.when(F.col("ready"), F.col("id"))).over(Window.partitionBy(*key))
    rows = fresh.withColumn("first_id", first).join(twins, key, "left")
    same = F.col("twin").isNotNull() | (F.col("id") != F.col("first_id"))
    return rows.select("id", F.when(~F.col("ready"), "held").when(same, "duplicate").otherwise("promoted").alias("outcome"), F.coalesce("twin", "first_id").alias("event_id"))


def fill_twins(rows: DataFrame, key: list[str], lo: int = 14400, hi: int = 21600) -> DataFrame:
    """id, venue and cancelled of `rows` (id, start, venue and the key): a twin fills a missing venue with the least one; a later twin without a venue, or `lo` to `hi` seconds off an earlier one, is cancelled.

    Twins are told by windows over a key's starts, so no pair is made.
    """
    at = F.unix_seconds(F.col("start").cast("timestamp"))
    own = Window.partitionBy(*key)
    near = lambda first, last: F.min("id").over(own.orderBy("at").rangeBetween(first, last)) < F.col("id")
    earlier = F.min("id").over(own) < F.col("id")
    ghost = F.when(F.col("venue").isNull(), earlier).otherwise(F.col("at").isNotNull() & (F.coalesce(near(-hi, -lo), F.lit(False)) | F.coalesce(near(lo, hi), F.lit(False))))
    keyed = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    rows = rows.select(*key, "id", "venue", at.alias("at"))
    return rows.select("id", F.when(keyed, F.coalesce("venue", F.min("venue").over(own))).otherwise(F.col("venue")).alias("venue"), (keyed & ghost).alias("cancelled"))


def fill_from_page(rows: DataFrame) -> DataFrame:
    """`rows` (status, night, place, stated_night, stated_place) filled from their own page; verdict is wall, unread, contested, filled or as_is."""
    read, both = F.col("status") == 200, F.col("night").isNotNull() & F.col("stated_night").isNotNull()
    contested = read & both & (F.col("night") != F.col("stated_night"))
    verdict = (
        F.when(F.col("status").isin(401, 402, 403, 407, 429), "wall").when(~read, "unread").when(contested, "contested")
        .when(F.col("night").isNull() & F.col("stated_night").isNotNull(), "filled").otherwise("as_is")
    )
    night = F.when(contested, None).when(read, F.coalesce("night", "stated_night")).otherwise(F.col("night"))
    return rows.withColumn("verdict", verdict).withColumn("night", night).withColumn("place", F.when(read, F.coalesce("place", "stated_place")).otherwise(F.col("place")))


def ingest_action(seen: Column, published: Column, drift: Column, held: Column) -> Column:
    """skip, dispute or fill a published row; reuse a standing candidate that didn't change; else hold or publish a new one."""
    return (
        F.when(seen & published, F.when(drift == "contradicts", "dispute").when(drift == "fills", "fill").otherwise("skip"))
        .when(seen & (drift == "same"), "reuse").when(held, "hold").otherwise("publish")
    )
