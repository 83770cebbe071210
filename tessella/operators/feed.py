"""Feed algebra over listings: windows, ranks, timing classes, facets and counts. No row is dropped for low confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import CONFIDENCE


def at(text: str) -> Column:
    """A literal moment without a zone."""
    return F.lit(text).cast("timestamp_ntz")


def bound(written: str) -> Column:
    """A window's bound from text; what can't be read raises instead of leaving the window open."""
    moment = F.try_to_timestamp(F.lit(written)).cast("timestamp_ntz")
    return F.coalesce(moment, F.raise_error(F.lit(f"unreadable bound {written!r}")).cast("timestamp_ntz"))


def existence(door_readable: Column, title: Column) -> Column:
    """exists, or which of the two proofs is missing."""
    return F.when(~F.coalesce(door_readable, F.lit(False)), "no_door").when(F.coalesce(F.trim(title), F.lit("")) == "", "no_title").otherwise("exists")


def confidence_rank(c: Column) -> Column:
    """0 for the most trusted label; labels outside the vocabulary sort last."""
    out = F.lit(len(CONFIDENCE))
    for i, name in reversed(list(enumerate(CONFIDENCE))):
        out = F.when(c == name, i).otherwise(out)
    return out


def within(start: Column, lo: str | None, hi: str | None, keep_null: bool = False) -> Column:
    """start within [lo, hi]; an open bound is no constraint, and keep_null lets rows without a start in."""
    test = F.lit(True)
    if lo is not None:
        test = test & (start >= at(lo))
    if hi is not None:
        test = test & (start <= at(hi))
    return test | start.isNull() if keep_null else test


def tonight(listings: DataFrame, venues: DataFrame, now: str, until: str, city: str | None = None, limit: int = 50) -> DataFrame:
    """Scheduled listings that start within [now, until], most trusted first, then by start and id."""
    rows = listings.where((F.col("status") == "scheduled") & within(F.col("start_time"), now, until)).join(venues, "venue_id", "left")
    if city:
        rows = rows.where(F.col("city").isNull() | (F.col("city") == city))
    rank = confidence_rank(F.col("confidence"))
    return rows.withColumn("rank", rank).orderBy("rank", F.asc_nulls_last("start_time"), "event_id").limit(limit)


def timing(start: Column, end: Column, now: str, date_only: Column | None = None) -> Column:
    """upcoming, on_now or ended; without an end a listing lasts three hours, a date-only one its whole day; no start counts as upcoming."""
    moment = at(now)
    last = F.coalesce(end, start + F.expr("interval 3 hours"))
    if date_only is not None:
        last = F.when(date_only, F.date_trunc("day", start).cast("timestamp_ntz") + F.expr("interval 1 day")).otherwise(last)
    return F.when(start.isNull(), "upcoming").when(last <= moment, "ended").when(start <= moment, "on_now").otherwise("upcoming")


def day_tabs(spark, first_day: str, days: int = 8, zone: str = "UTC") -> DataFrame:  # noqa: ANN001
    """tab, lo and hi (half open, in UTC) of consecutive days of a zone; a day on which clocks change is 23 or 25 hours long."""
    day = F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int"))
    edge = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone).cast("timestamp_ntz")
    return spark.range(days).select(F.col("id").cast("int").alias("tab"), edge(day).alias("lo"), edge(F.date_add(day, 1)).alias("hi"))


def in_tabs(listings: DataFrame, tabs: DataFrame, end: Column) -> DataFrame:
    """Listings with each tab they belong to: started in it, carried over into the first, or without a start (first tab)."""
    first = F.col("tab") == 0
    starts = (F.col("start_time") >= F.col("lo")) & (F.col("start_time") < F.col("hi"))
    carried = first & (F.col("start_time") < F.col("lo")) & (end > F.col("lo"))
    return listings.join(F.broadcast(tabs), starts | carried | (first & F.col("start_time").isNull()))  # one row a day in `tabs`


def apply_filters(rows: DataFrame, areas: Sequence[str] = (), cities: Sequence[str] = (), max_price: float | None = None) -> DataFrame:
    """Conjunctive filters; an empty set is no constraint, a null price never passes a price cap."""
    if areas:
        rows = rows.where(F.col("area").isin(*areas))
    if cities:
        rows = rows.where(F.col("city").isin(*cities))
    return rows.where(F.col("price") <= max_price) if max_price is not None else rows


def facet(rows: DataFrame, column: str, position: str) -> DataFrame:
    """Count of each non-empty value, most frequent first; equal counts in order of first appearance."""
    counted = rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(position).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen")


def date_bucket(start: Column, now: str) -> Column:
    """rich within 7 days, compact within 30, else (or without a date) line."""
    days = F.timestamp_diff("SECOND", at(now), start) / 86400.0
    return F.when(days <= 7, "rich").when(days <= 30, "compact").otherwise("line")


def day_part(hour: Column) -> Column:
    """evening from 17 on or without an hour, else earlier."""
    return F.when(hour.isNull() | (hour >= 17), "evening").otherwise("earlier")


def tri_state(*fields: Column) -> Column:
    """False if any field is known to be outside, else true if any is inside, else unknown (null)."""
    some_false, some_true = F.lit(False), F.lit(False)
    for f in fields:
        some_false = some_false | F.coalesce(~f, F.lit(False))
        some_true = some_true | F.coalesce(f, F.lit(False))
    return F.when(some_false, False).when(some_true, True)
