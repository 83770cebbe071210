"""Published listings against what a fresh read of their page states: match kinds, differences, and one decision a row.

`published` has page, row, ident, source, title, start and end; `parsed` has page, item,
ident, source, title, start, end and gate; `pages` has page, verdict and text. Moments
have no zone; a null field is never equal to anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import same_minute
from ..functions.text import folded_words, title_key

IDENTITY, TIME, TITLE = "identity", "time", "title"
COLLISION, UNTITLED, FAR = "collision", "untitled", "far"
#: A title alone carries a listing over so many hours.
TITLE_HOURS = 12


def match_kind(p: str, c: str, key: str | None = None) -> Column:
    """How the parsed listing `c` meets the published row `p` (column prefixes of structs); null where it doesn't.

    An identity decides both ways; other sources never match; then the minute, then the title. `key` names
    a field that holds the title's key already.
    """
    f = lambda side, name: F.col(f"{side}.{name}")
    pt, ct = (f(side, key) if key else title_key(f(side, "title")) for side in (p, c))
    minute = F.coalesce(same_minute(f(p, "start"), f(c, "start")), F.lit(False))
    same_title = F.coalesce(pt == ct, F.lit(False))
    apart = F.abs(F.timestamp_diff("MINUTE", f(p, "start"), f(c, "start")))
    return (
        F.when(f(p, "ident") == f(c, "ident"), IDENTITY)
        .when(f(p, "ident") != f(c, "ident"), F.when(minute, COLLISION).when(same_title, FAR))
        .when(f(p, "source") != f(c, "source"), None)
        .when(minute, F.when(pt.isNull() | ct.isNull(), UNTITLED).when(pt != ct, COLLISION).otherwise(TIME))
        .when(same_title, F.when(F.coalesce(apart, F.lit(0)) <= TITLE_HOURS * 60, TITLE).otherwise(FAR))
    )


def match_pairs(published: DataFrame, parsed: DataFrame) -> DataFrame:
    """p, c (structs) and kind of every pair of a page that meets; only rows that share an identity, minute or title are paired."""

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("title_key", title_key(F.col("title")))  # once a row, not once a pair
        keys = F.array(
            F.struct(F.lit("i").alias("by"), F.col("ident").alias("v")), F.struct(F.lit("m").alias("by"), F.date_trunc("minute", "start").cast("string").alias("v")),
            F.struct(F.lit("t").alias("by"), F.col("title_key").alias("v")))
        return rows.select(F.col("page").alias(f"{name}_page"), F.struct("*").alias(name), F.explode(F.filter(keys, lambda k: k["v"].isNotNull())).alias("key"))

    a, b = keyed(published, "p"), keyed(parsed, "c").withColumnRenamed("key", "key_c")
    pairs = a.join(b, (F.col("p_page") == F.col("c_page")) & (F.col("key") == F.col("key_c")))
    # a pair that shares several keys counts under the first of them
    minute = F.coalesce(same_minute(F.col("p.start"), F.col("c.start")), F.lit(False))
    first = F.when(F.coalesce(F.col("p.ident") == F.col("c.ident"), F.lit(False)), "i").when(minute, "m").otherwise("t")
    return pairs.where(F.col("key.by") == first).select("p", "c", match_kind("p", "c", "title_key").alias("kind")).where("kind is not null")


def field_diff(p: str, c: str, kind: Column) -> Column:
    """Names of the fields to write: stated, and different to the minute; a title only on an identity."""
    pt, ct = title_key(F.col(f"{p}.title")), title_key(F.col(f"{c}.title"))
    moved = lambda n: F.col(f"{c}.{n}").isNotNull() & ~F.coalesce(same_minute(F.col(f"{p}.{n}"), F.col(f"{c}.{n}")), F.lit(False))
    fields = [((kind == IDENTITY) & ct.isNotNull() & ~pt.eqNullSafe(ct), "title"), (moved("start"), "start_time"), (moved("end"), "end_time")]
    return F.filter(F.array(*(F.when(test, F.lit(name)) for test, name in fields)), lambda x: x.isNotNull())


def still_on_page(title: Column, text: Column) -> Column:
    """Whether the folded title is a run of whole words of the folded text; unknown (null) without either."""
    words, run = folded_words(text), F.nullif(folded_words(title), F.lit(""))
    return F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.concat(F.lit(" "), run, F.lit(" ")))


def contested_minutes(parsed: DataFrame) -> DataFrame:
    """page, minute with two or more listings that distinct identities don't tell apart."""
    minute = parsed.where("start is not null").groupBy("page", F.date_trunc("minute", "start").alias("minute"))
    return minute.agg(F.count("*").alias("n"), F.count_distinct("ident").alias("ids")).where("n >= 2 and ids < n").select("page", "minute", "n")


def bracket(parsed: DataFrame) -> DataFrame:
    """page, first and last start of its listings that pass the gate: a moment between them is covered on both sides."""
    return parsed.where("gate").groupBy("page").agg(F.min("start").alias("first_gated"), F.max("start").alias("last_gated"))


def adjudicate(published: DataFrame, parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """row, decision (cancel, update or keep), reason and fields of each published row; the first rule that applies decides."""
    every = match_pairs(published, parsed).select("p.row", "c.item", F.struct("c.start", "c.end", "c.title", "c.gate").alias("c"), "kind")
    w = Window.partitionBy("row")
    known = F.col("kind") == IDENTITY
    named = every.withColumn("by_id", F.max(known).over(w)).withColumn("hit", F.col("kind").isin(IDENTITY, TIME, TITLE) & (~F.col("by_id") | known))
    counted = named.withColumns({"hits": F.count(F.when(F.col("hit"), 1)).over(w), "claims": F.count(F.when(F.col("hit"), 1)).over(Window.partitionBy("item"))})
    found = counted.groupBy(F.col("row").alias("met_row")).agg(
        F.max(F.when(F.col("hit"), F.col("hits"))).alias("hits"), F.max(F.when(F.col("hit"), F.col("claims"))).alias("claims"), F.min(F.when(F.col("hit"), F.struct("item", "c", "kind"))).alias("hit"),
        F.max(~F.col("kind").isin(IDENTITY, TIME, TITLE)).alias("near"))
    read = parsed.groupBy("page").agg(F.count("*").alias("n_parsed")).join(bracket(parsed), "page", "left")
    facts = pages.join(read, "page", "left").withColumnRenamed("page", "fact_page")
    doubt = contested_minutes(parsed).select(F.col("page").alias("doubt_page"), "minute")
    rows = published.select("row", "page", F.struct("*").alias("p")).join(facts, F.col("page") == F.col("fact_page"), "left").join(found, F.col("row") == F.col("met_row"), "left")
    rows = rows.join(doubt, (F.col("page") == F.col("doubt_page")) & (F.date_trunc("minute", "hit.c.start") == F.col("minute")), "left")
    rows = rows.withColumn("kind", F.col("hit.kind")).withColumn("c", F.col("hit.c"))
    diff = field_diff("p", "c", F.col("kind"))
    end = F.when(F.array_contains(diff, "end_time"), F.col("c.end")).otherwise(F.col("p.end"))
    start = F.when(F.array_contains(diff, "start_time"), F.col("c.start")).otherwise(F.col("p.start"))
    covered = F.coalesce(F.col("p.start").between(F.col("first_gated"), F.col("last_gated")), F.lit(False))
    reason = (
        F.when(F.col("verdict") == "absent", "page_gone").when(~F.coalesce(F.col("verdict") == "present", F.lit(False)), "page_unverified").when(F.col("n_parsed").isNull(), "nothing_parsed")
        .when((F.col("hits") > 1) | (F.col("claims") > 1), "ambiguous")
        .when(F.col("hits").isNull(), F.when(F.col("near"), "neighbour").when(F.coalesce(still_on_page(F.col("p.title"), F.col("text")), F.lit(True)), "still_on_page")
              .when(~covered, "not_bracketed").otherwise("not_listed"))
        .when((F.col("kind") != IDENTITY) & F.col("minute").isNotNull(), "contested").when(F.size(diff) == 0, "no_difference").when(~F.coalesce(F.col("c.gate"), F.lit(False)), "gate")
        .when(F.col("kind") == TITLE, "title_only").when(F.coalesce(end <= start, F.lit(False)), "window").otherwise("stated")
    )
    out = rows.withColumn("reason", reason)
    decision = F.when(F.col("reason").isin("page_gone", "not_listed"), "cancel").when(F.col("reason") == "stated", "update").otherwise("keep")
    return out.select("row", decision.alias("decision"), "reason", F.when(F.col("reason") == "stated", F.array_join(diff, ",")).alias("fields"))


def recheck_verdict(status: Column, changed: Column, error: Column) -> Column:
    """present or absent on the two answers that prove it (200 with a body read, a clean 404 or 410), else unverified."""
    return F.when(error.isNotNull(), "unverified").when((status == 200) & changed.isNotNull(), "present").when(status.isin(404, 410), "absent").otherwise("unverified")
