"""Labels: categories and the signal that decides them, kinds of sections, classes of sources, and what titles print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_number
from ..functions.text import first_label, label_key

#: Status codes of a wall.
WALLS = (401, 402, 403, 407, 429)
PLACEHOLDERS = ("undefined", "other", "miscellaneous", "")


def _lookup(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, label in table.items():
        out = F.when(value == key, label).otherwise(out)
    return out


def category(schema_type: Column, provider_code: Column, curated: Column, venue_type: Column, title: Column, *, schema: dict, provider: dict, venues: dict, words: list[tuple[str, str]]) -> Column:
    """struct domain, signal: linked-data type, provider's code, curated venue, venue type, title, in this order; placeholders decide nothing."""
    code = F.when(~F.lower(provider_code).isin(*PLACEHOLDERS), provider_code)
    steps = [("schema", _lookup(schema_type, schema)), ("provider", _lookup(code, provider)), ("curated_venue", curated), ("venue_type", _lookup(venue_type, venues)), ("title", F.nullif(first_label(title, words, ""), F.lit("")))]
    found = [F.when(value.isNotNull(), F.struct(value.alias("domain"), F.lit(name).alias("signal"))) for name, value in steps]
    return F.coalesce(*found, F.struct(F.lit("unmapped").alias("domain"), F.lit("none").alias("signal")))


def resolve_kinds(rows: DataFrame, key: str, table: list[tuple[str, str, str]]) -> DataFrame:
    """key and kind of `rows` (key, sections, labels): the first section id that the table (by, name, kind) knows, else the first label; unmapped if none."""
    known = rows.sparkSession.createDataFrame(table, "by string, name string, kind string")
    named = F.concat(F.transform(F.coalesce("sections", F.array().cast("array<string>")), lambda s: F.struct(F.lit("id").alias("by"), s.alias("name"))),
                     F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.struct(F.lit("label").alias("by"), label_key(x).alias("name"))))
    each = rows.select(key, F.posexplode_outer(named).alias("pos", "x")).select(key, "pos", "x.by", "x.name")
    hits = each.join(F.broadcast(known), ["by", "name"], "left").groupBy(key)  # a fixed table
    first = F.min(F.when(F.col("kind").isNotNull(), F.struct("pos", "kind")))
    return hits.agg(F.coalesce(first["kind"], F.lit("unmapped")).alias("kind"))


def source_class(tokens: Column, status: Column, url: Column, rules: list[tuple[str, list[str], list[str]]], other: str) -> Column:
    """The letter of the first rule (letter, one of these, and one of those) that the tokens meet; a wall or a login address is D."""
    out = F.lit(other)
    for letter, some, more in reversed(rules):
        test = F.arrays_overlap(tokens, F.array(*map(F.lit, some)))
        out = F.when(test & F.arrays_overlap(tokens, F.array(*map(F.lit, more))) if more else test, letter).otherwise(out)
    walled = status.isin(*WALLS) | url.rlike(r"(?i)/(login|signin|sign-in)([/?#]|$)")
    return F.when(F.coalesce(walled, F.lit(False)), "D").otherwise(out)


def title_day(title: Column) -> Column:
    """The date that a title prints with its year, as Jun 5, 1998, June 5 1998 or 6/5/1998; null if none."""
    named, slash = r"(?i)\b([a-z]{3,9})\.? (\d{1,2}),? (\d{4})\b", r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    get = lambda p, i: F.regexp_extract(title, p, i)
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.coalesce(day(get(named, 3), month_number(get(named, 1)).cast("string"), get(named, 2)), day(get(slash, 3), get(slash, 1), get(slash, 2)))


def title_room(title: Column) -> Column:
    """The room in brackets at the end of a title, in lower case; null if none."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(title, r"(?i)\(([^()]*(?:room|stage|hall|upstairs|patio))\s*\)\s*$", 1))), F.lit(""))


def search_queries(rows: DataFrame, templates: list[str], place: Column) -> DataFrame:
    """market, query and place (order) of every template with every kind of `rows` (market, kind), the first of equal ones."""
    forms = F.posexplode(F.array(*map(F.lit, templates))).alias("pos", "t")
    made = rows.distinct().select("market", "kind", place.alias("where"), forms)
    text = F.replace(F.replace("t", F.lit("{kind}"), F.lower("kind")), F.lit("{place}"), F.col("where"))
    once = made.groupBy("market", text.alias("query")).agg(F.min(F.struct("pos", "kind")).alias("first"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("market").orderBy("first")).cast("bigint"))


def trust_label(state: Column) -> Column:
    return F.when(state == "confirmed", "Confirmed").when(state == "likely", "Likely").when(state == "disputed", "Disputed").otherwise("Unverified")
