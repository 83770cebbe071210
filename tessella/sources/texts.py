"""Sources whose rows lie in texts: calendars, linked data, JSON feeds, claim files and graph lines, read in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import utc_stamp
from ..functions.text import bound
from .markup import json_objects
from .staging import spread

#: A parameter part of a calendar line; quoted values may hold a colon.
_PARAMS = r'((?:;(?:[^:"\r\n]|"[^"\r\n]*")*)?)'


def source_kind(text: Column) -> Column:
    """calendar, linked_page (a page with linked data), page, json, or unknown."""
    head = F.regexp_replace(text, r"^[\uFEFF\s]+", "")
    return (
        F.when(head.startswith("BEGIN:VCALENDAR"), "calendar").when(head.rlike(r"(?i)^<") & text.rlike(r"(?i)<script[^>]*application/ld\+json"), "linked_page")
        .when(head.startswith("<"), "page").when(head.rlike(r"^[\[{]"), "json").otherwise("unknown")
    )


def calendar_events(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, uid, summary, start, stop, all_day, place, url and notes of each event of a calendar text.

    Folded lines are joined, quoted parameters and escapes are read; an event
    without a summary or a readable start is left out. start and stop are ISO text: a day, or an instant in UTC.
    """
    lines = F.regexp_replace(F.col(column), r"\r?\n[ \t]", "")
    blocks = F.slice(F.split(lines, r"BEGIN:VEVENT\r?\n"), 2, F.greatest(F.size(F.split(lines, r"BEGIN:VEVENT\r?\n")) - 1, F.lit(0)))
    rows = spread(texts.select(key, column)).select(key, F.posexplode(blocks).alias("pos", "rest")).withColumn("body", F.substring_index("rest", "END:VEVENT", 1))

    def field(name: str, part: int = 2) -> Column:
        return F.nullif(F.trim(F.regexp_extract("body", rf"(?m)^{name}{_PARAMS}:([^\r\n]*)", part)), F.lit(""))

    plain = lambda name: F.regexp_replace(F.regexp_replace(field(name), r"\\[nN]", " "), r"\\([,;\\])", "$1")
    zone = lambda name: F.nullif(F.regexp_extract(F.coalesce(field(name, 1), F.lit("")), r'TZID="?([^";:]+)', 1), F.lit(""))
    stamp = lambda name: utc_stamp(field(name), zone(name))
    out = rows.select(
        key, "pos", field("UID").alias("uid"), plain("SUMMARY").alias("summary"), stamp("DTSTART").alias("start"), stamp("DTEND").alias("stop"), field("DTSTART").rlike("^[0-9]{8}$").alias("all_day"),
        plain("LOCATION").alias("place"), field("URL").alias("url"), plain("DESCRIPTION").alias("notes"))
    return out.where("summary is not null and start is not null")


def linked_event(item: Column, *fields: str) -> Column:
    """struct is_event, type, name, start, stop, url, place, address, locality, low and high of a linked-data object in JSON, or the named ones alone.

    An event's type, or one of its types, ends in "event" in any case, or is Festival; a namespace in front
    is left out. A place may be a text, an object or a list (its first), an address a text or an object. What isn't stated is null.
    """
    get = lambda path: F.get_json_object(item, path)
    plain = lambda value: bound(F.trim(value), lambda v: F.nullif(v, F.lit("")))
    said = lambda path: plain(scalar(get(path)))
    kinds = lambda kind: F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
    bare = F.transform(F.filter(bound(get("$['@type']"), kinds), lambda k: k.isNotNull()), lambda k: F.lower(F.trim(F.regexp_replace(k, "^.*[/:]", ""))))
    at = lambda spot, path: plain(scalar(F.get_json_object(spot, path)))

    def place(spot: Column) -> Column:
        object_ = F.coalesce(spot.startswith("{"), F.lit(False))
        return bound(F.when(object_, F.get_json_object(spot, "$.address")), lambda address: F.struct(
            F.when(object_, at(spot, "$.name")).otherwise(plain(spot)).alias("place"),
            F.when(object_, F.when(address.startswith("{"), at(spot, "$.address.streetAddress")).otherwise(plain(address))).alias("address"),
            F.when(object_ & address.startswith("{"), at(spot, "$.address.addressLocality")).alias("locality")))

    spot = bound(get("$.location"), lambda value: F.when(value.startswith("["), get("$.location[0]")).otherwise(value))
    told = {
        "is_event": lambda x: F.exists(bare, lambda k: k.endswith("event") | (k == "festival")), "type": lambda x: get("$['@type']"), "name": lambda x: said("$.name"), "start": lambda x: said("$.startDate"), "stop": lambda x: said("$.endDate"),
        "url": lambda x: said("$.url"), **{c: lambda x, c=c: x["where"][c] for c in ("place", "address", "locality")}, **{c: lambda x, c=c: x["prices"][c] for c in ("low", "high")}}
    wanted = fields or tuple(told)
    parts = [bound(spot, place).alias("where"), *([offer_range(get("$.offers")).alias("prices")] if {"low", "high"} & {*wanted} else [])]
    return bound(F.struct(*parts), lambda x: F.struct(*(told[c](x).alias(c) for c in wanted)))


def linked_events(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key and the fields of linked_event of each event in the linked data of a page.

    A script holds an object or a list, and either may hold @graph lists; a malformed
    script is left out and the others stay. What an event doesn't state is null, its name too.
    """
    scripts = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<script[^>]*type=[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"), 1)
    rows = spread(pages.select(key, column)).select(key, F.explode(json_objects(scripts)).alias("item")).select(key, linked_event(F.col("item")).alias("e"))
    return rows.select(key, "e.*").where("is_event").drop("is_event")


def offer_range(offers: Column) -> Column:
    """struct low, high: least and greatest numeric price of an offer or a list of offers in JSON; null without one."""
    listed = F.from_json(bound(offers, lambda o: F.when(F.ltrim(o).startswith("["), o).otherwise(F.concat(F.lit("["), o, F.lit("]")))), "array<struct<price: string, lowPrice: string, highPrice: string>>")
    prices = F.flatten(F.transform(listed, lambda o: F.array(o["price"], o["lowPrice"], o["highPrice"])))
    numbers = F.filter(F.transform(prices, lambda p: p.try_cast("double")), lambda p: p.isNotNull())
    return bound(numbers, lambda n: F.struct(F.array_min(n).alias("low"), F.array_max(n).alias("high")))


def first_instances(feeds: DataFrame, key: str, column: str) -> DataFrame:
    """key, id, title and start (of the first instance) of each event of a paged JSON feed; an event without an instance is left out."""
    shape = "struct<events: array<struct<event: struct<id: bigint, title: string, event_instances: array<struct<event_instance: struct<start: string>>>>>>>"
    rows = feeds.select(key, F.explode(F.from_json(column, shape)["events"]).alias("e"))
    first = F.try_element_at(F.col("e.event.event_instances"), F.lit(1))["event_instance"]["start"]
    return rows.select(key, F.col("e.event.id").alias("id"), F.col("e.event.title").alias("title"), first.alias("start")).where("start is not null")


def scalar(value: Column) -> Column:
    """One text of a JSON value: a list of one, or an object's name or @value, is unwrapped; anything else that isn't a scalar is null."""
    inner = lambda v: F.when(v.startswith("["), F.when(F.json_array_length(v) == 1, F.get_json_object(v, "$[0]"))).otherwise(v)
    return bound(bound(value, inner), lambda inner: F.when(inner.startswith("{"), F.coalesce(F.get_json_object(inner, "$.name"), F.get_json_object(inner, "$['@value']"))).when(~inner.startswith("["), inner))


def csv_records(text: Column) -> Column:
    """The records of a text of comma-separated cells; a cell that begins with a quote may hold line ends, up to the closing quote.

    Line ends behind the last record are left out. A quote within a cell, or one that nothing closes, is a character.
    """
    record = r'((?:[^"\r\n]++|(?<![^,\r\n])"[^"]*+(?:""[^"]*+)*+"|")*+)(?:\r?\n|$)'
    found = F.regexp_extract_all(F.regexp_replace(text, r"(\r?\n)+$", ""), F.lit(record), 1)
    # where the last record ends the text, an empty match follows it
    return F.when((F.size(found) > 1) & (F.element_at(found, -1) == ""), F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def csv_cells(record: Column) -> Column:
    """The cells of a record, trimmed, without the quotes around them."""
    found = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(r'("[^"]*+(?:""[^"]*+)*+"|[^,]*),'), 1)
    return F.transform(found, lambda c: F.regexp_replace(F.when(c.rlike('(?s)^".*"$'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c), r"^\s+|\s+$", ""))


def claim_files(files: DataFrame, key: str, column: str, required: tuple[str, ...], most: int = 500) -> DataFrame:
    """key, verdict and rows (array of maps, null where refused) of claim files with a header.

    A file is taken whole or refused whole: a repeated or missing column, a ragged row or more than
    `most` rows refuse it, and the verdict names the row as a spreadsheet numbers it. Columns that are not
    required stay in the map. Cells may be quoted; a quoted cell keeps its commas and line ends.
    """
    lines, cells = csv_records(F.col(column)), csv_cells
    rows = files.select(key, F.transform(lines, cells).alias("t")).select(key, F.transform(F.element_at("t", 1), F.lower).alias("head"), F.expr("slice(t, 2, greatest(size(t) - 1, 0))").alias("body"))
    missing = F.array_except(F.array(*map(F.lit, required)), "head")
    ragged = F.array_position(F.transform("body", lambda r: F.size(r) != F.size("head")), True)
    verdict = (
        F.when(F.size(F.array_distinct("head")) < F.size("head"), "row 1: repeated column").when(F.size(missing) > 0, F.concat(F.lit("row 1: no column "), F.array_join(missing, ", ")))
        .when(F.size("body") > most, F.concat(F.lit("row "), F.lit(str(most + 2)), F.lit(": too many rows"))).when(ragged > 0, F.concat(F.lit("row "), (ragged + 1).cast("string"), F.lit(": ragged"))).otherwise("ok")
    )
    maps = F.transform("body", lambda r: F.map_from_arrays(F.col("head"), r))
    judged = rows.withColumn("verdict", verdict)
    return judged.select(key, "verdict", F.when(F.col("verdict") == "ok", maps).alias("rows"))


def graph_lines(lines: DataFrame, column: str) -> DataFrame:
    """line, kind, id and problem of graph lines (meta, node, edge, resolution): corrupt, unknown_kind, no_id, repeated_id or null.

    `lines` has a unique column `line`; of a repeated id all but the first are a problem.
    """
    x = F.from_json(column, "struct<kind: string, id: string>")
    rows = lines.select("line", x["kind"].alias("kind"), x["id"].alias("id"))
    known = F.col("kind").isin("meta", "node", "edge", "resolution")
    nth = F.row_number().over(Window.partitionBy("kind", "id").orderBy("line"))
    problem = F.when(F.col("kind").isNull(), "corrupt").when(~known, "unknown_kind").when(F.col("kind") == "meta", None).when(F.col("id").isNull(), "no_id").when(nth > 1, "repeated_id")
    return rows.select("line", "kind", "id", problem.alias("problem"))


def exactly_one(rows: DataFrame, key: Column, *columns: str) -> DataFrame:
    """The row with this key: none gives no row, two raise, as the table is then corrupt."""
    found = rows.where(key).select(*columns).limit(2)
    counted = found.agg(F.collect_list(F.struct(*columns)).alias("all"))
    one = F.when(F.size("all") > 1, F.raise_error(F.lit("more than one row of one key"))).otherwise(F.col("all"))
    return counted.select(F.explode(one).alias("r")).select("r.*")
