"""Pages and texts as rows: anchors, signals, segments by printed dates, and shared identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import host

ANCHOR = r"""<a\s[^>]*href=["']?([^"'\s>]+)"""
DATE_LINE = r"(?m)^(?=\d{4}-\d\d-\d\d\b)"


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos and href of each anchor of a page, in page order, quoted or not."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(f"(?i){ANCHOR}"), 1)).alias("pos", "href"))


def link_signal(href: Column, own: Column) -> Column:
    """What a link tells of its page: mail, phone, feed, map, social, ticket, own or other."""
    low = F.lower(href)
    return (
        F.when(low.startswith("mailto:"), "mail").when(low.startswith("tel:"), "phone").when(low.rlike(r"(\.ics|/feed/?|\.rss|\.xml)([?#]|$)"), "feed").when(low.rlike(r"(maps\.|/maps/)"), "map")
        .when(low.rlike(r"(^|[/.])(facebook|instagram|twitter|youtube)\.com"), "social").when(low.rlike(r"ticket"), "ticket").when(~low.rlike("^[a-z][a-z0-9+.-]*:") | (host(low) == own), "own").otherwise("other")
    )


def dated_segments(texts: DataFrame, key: str, column: str, least: int = 2) -> DataFrame:
    """key, pos and segment of each text cut before lines that begin with a date; a text with fewer than `least` such lines is one segment."""
    parts = F.filter(F.split(F.col(column), DATE_LINE), lambda s: F.trim(s) != "")
    dated = F.size(F.filter(parts, lambda s: s.rlike(r"^\d{4}-\d\d-\d\d\b")))
    rows = texts.select(key, F.posexplode_outer(F.when(dated >= least, parts).otherwise(F.array(column))).alias("pos", "segment"))
    return rows.where("segment is not null")


def own_identities(blocks: DataFrame, page: str, *fields: str) -> DataFrame:
    """`blocks` with a field's value kept only where no other block of the page states it: a shared value identifies none."""
    out = blocks
    for f in fields:
        n = F.count(f).over(Window.partitionBy(page, f))
        out = out.withColumn(f, F.when(n == 1, F.col(f)))
    return out


def first_pattern(url: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern (name, expression over the whole URL) that fits, in table order; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(url.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def place_after_title(card: Column) -> Column:
    """The line of a card behind its title and its clock; null where it prints none."""
    lines = F.filter(F.transform(F.split(card, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(0))), lambda x: ~x.rlike(r"(?i)^(\d{1,2}(:\d\d)? ?[ap]\.?m\.?|\d{4}-\d\d-\d\d|\$.*|free)$"))
    return F.get(rest, F.lit(0))


def event_markup(name: Column, start: Column, place: Column, low: Column) -> Column:
    """The linked data of an event; fields that aren't known are left out."""
    return F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), name.alias("name"), start.alias("startDate"),
        F.when(place.isNotNull(), F.struct(F.lit("Place").alias("@type"), place.alias("name"))).alias("location"), F.when(low.isNotNull(), F.struct(low.alias("price"))).alias("offers")))
