"""Queries over texts that hold rows. The texts are written from orders, so the SQL knows what must be read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..sources import texts
from ..sources.tables import Tables

def order_key() -> Column:
    return F.col("o_orderkey")


def order_date() -> Column:
    return F.col("o_orderdate")


def _text(*parts):  # noqa: ANN002, ANN202
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _joined(rows: DataFrame, piece, lead: str, between: str, end: str) -> DataFrame:  # noqa: ANN001
    """One text a customer: the pieces of its orders in order."""
    parts = F.array_sort(F.collect_list(F.struct(order_key(), piece.alias("s"))))["s"]
    return rows.groupBy(F.col("o_custkey").alias("page")).agg(_text(lead, F.array_join(parts, between), end).alias("body"))


def _calendars(t: Tables) -> DataFrame:
    stamp = F.date_format(order_date() + F.expr("interval 20 hours"), "yyyyMMdd'T'HHmmss")
    start = F.when(order_key() % 5 == 0, _text("DTSTART;VALUE=DATE:", F.date_format(order_date(), "yyyyMMdd"))).when(order_key() % 5 == 1, _text("DTSTART:", stamp, "Z")).when(order_key() % 5 == 2, _text('DTSTART;X-P="a:b";TZID=America/Chicago:', stamp)).when(
        order_key() % 5 == 3, _text(F.when(order_key() % 3 == 0, "DTSTART;TZID=Nowhere/Here:").when(order_key() % 3 == 1, "DTSTART;TZID=Asia/Tokyo:").otherwise("DTSTART;TZID=America/Phoenix:"), stamp)).otherwise("DTSTART:soon")
    more = _text("\r\nDTEND;TZID=Australia/Adelaide:", stamp, "\r\nLOCATION:Hall ", (order_key() % 9).cast("string"), "\\, east\r\nURL:https://h.example/", order_key().cast("string"), "\r\nDESCRIPTION:one\\n  \r\n two")
    summary = F.when(order_key() % 7 == 0, "LOCATION:here").otherwise(F.concat(F.lit("SUMMARY;LANGUAGE=en:Show\\, no\r\n . "), "o_orderpriority", F.lit("\\; part 2")))
    event = _text("BEGIN:VEVENT\r\nUID:u", order_key().cast("string"), "\r\n", start, "\r\n", summary, F.when(order_key() % 7 == 0, "").otherwise(more), "\r\nEND:VEVENT")
    return _joined(t.orders, event, "BEGIN:VCALENDAR\r\nX-NAME:cal\r\n", "\r\n", "\r\nEND:VCALENDAR\r\n")


@query("""select o_custkey as page, 'u' || o_orderkey as uid, 'Show, no. ' || o_orderpriority || '; part 2' as summary, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d')
  when 2 then strftime(timezone('UTC', timezone('America/Chicago', o_orderdate + interval 20 hour)), '%Y-%m-%dT%H:%M:%SZ')
  when 3 then strftime(timezone('UTC', timezone(case o_orderkey % 3 when 0 then 'UTC' when 1 then 'Asia/Tokyo' else 'America/Phoenix' end, o_orderdate + interval 20 hour)), '%Y-%m-%dT%H:%M:%SZ') else strftime(o_orderdate + interval 20 hour, '%Y-%m-%dT%H:%M:%SZ') end as start, o_orderkey % 5 = 0 as all_day,
  strftime(timezone('UTC', timezone('Australia/Adelaide', o_orderdate + interval 20 hour)), '%Y-%m-%dT%H:%M:%SZ') as stop, 'Hall ' || (o_orderkey % 9) || ', east' as place, 'https://h.example/' || o_orderkey as url, 'one   two' as notes
from orders where o_orderkey % 5 < 4 and o_orderkey % 7 <> 0""")
def calendar_events(t: Tables) -> DataFrame:
    """Events of calendar texts: folded lines, quoted parameters, zones, days."""
    return texts.calendar_events(_calendars(t), "page", "body").drop("pos")


def _linked(t: Tables) -> DataFrame:
    offers = F.when(order_key() % 4 == 0, _text('{"price": "', (order_key() % 90).cast("string"), '"}')).when(order_key() % 4 == 1, _text('[{"price": ', (order_key() % 90).cast("string"), '}, {"lowPrice": "5", "highPrice": "free"}]')).otherwise('"none"')
    kind = F.when(order_key() % 6 == 0, '"Person"').when(order_key() % 6 == 1, '["Thing", "MusicEvent"]').when(order_key() % 6 == 2, '"https://schema.org/Festival"').when(order_key() % 6 == 3, '"event"').otherwise('"Event"')
    place = F.when(order_key() % 5 == 0, '"Hall"').when(order_key() % 5 == 1, '[{"name": "Hall", "address": {"streetAddress": "1 Main", "addressLocality": "Town"}}, "x"]').when(order_key() % 5 == 2, '{"name": {"@value": "Hall"}, "address": "2 Main"}').otherwise("null")
    item = _text('{"@type": ', kind, ', "location": ', place, F.when(order_key() % 8 == 7, "").otherwise(_text(', "name": " Show ', order_key().cast("string"), '"')), ', "startDate": "', F.date_format(order_date(), "yyyy-MM-dd"), '", "offers": ', offers, "}")
    body = F.when(order_key() % 10 == 9, '{"broken": ').when(order_key() % 9 == 0, _text('[{"@graph": [', item, ']}, {"@type": "Place"}]')).when(order_key() % 3 == 0, _text("[", item, "]")).when(order_key() % 3 == 1, _text('{"@graph": [', item, "]}")).otherwise(item)
    return _joined(t.orders, _text('<script type="application/ld+json">', body, "</script>"), "<html><p>x</p>", "\n", "</html>")


@query("""select o_custkey as page, case when o_orderkey % 8 < 7 then 'Show ' || o_orderkey end as name, case when o_orderkey % 5 < 3 then 'Hall' end as place, case o_orderkey % 5 when 1 then '1 Main' when 2 then '2 Main' end as address, case when o_orderkey % 5 = 1 then 'Town' end as locality, strftime(o_orderdate, '%Y-%m-%d') as start, case o_orderkey % 4 when 0 then cast(o_orderkey % 90 as double) when 1 then least(5.0, o_orderkey % 90) end as low,
  case o_orderkey % 4 when 0 then cast(o_orderkey % 90 as double) when 1 then greatest(5.0, o_orderkey % 90) end as high from orders where o_orderkey % 10 <> 9 and o_orderkey % 6 <> 0""")
def linked_events(t: Tables) -> DataFrame:
    """Events in the linked data of pages, with the range of their offers."""
    return texts.linked_events(_linked(t), "page", "body").drop("type", "stop", "url")


@query("""select o_custkey as page, o_orderkey as id, 'T' || o_orderkey as title, strftime(o_orderdate, '%Y-%m-%d') as start from orders where o_orderkey % 8 <> 0""")
def feed_instances(t: Tables) -> DataFrame:
    """The first instance of each event of a JSON feed."""
    first = _text('{"event_instance": {"start": "', F.date_format(order_date(), "yyyy-MM-dd"), '"}}, {"event_instance": {"start": "2030-01-01"}}')
    event = _text('{"event": {"id": ', order_key().cast("string"), ', "title": "T', order_key().cast("string"), '", "event_instances": [', F.when(order_key() % 8 == 0, "").otherwise(first), "]}}")
    return texts.first_instances(_joined(t.orders, event, '{"events": [', ", ", "]}"), "page", "body")


@query("""select kind, count(*) as n from (select case o_orderkey % 5 when 0 then 'calendar' when 1 then 'linked_page' when 2 then 'page' when 3 then 'json' else 'unknown' end as kind from orders) group by kind""")
def source_kinds(t: Tables) -> DataFrame:
    body = F.when(order_key() % 5 == 0, "\n BEGIN:VCALENDAR\n").when(order_key() % 5 == 1, "<html><script type='application/ld+json'>{}</script>").when(order_key() % 5 == 2, " <p>x").when(order_key() % 5 == 3, '{"events": []}').otherwise("plain")
    return t.orders.groupBy(texts.source_kind(body).alias("kind")).agg(F.count("*").alias("n"))


@query("""with n as (select o_custkey as page, count(*) as n, list(o_orderkey order by o_orderkey) as ids from orders group by 1),
v as (select *, list_position(list_transform(ids, lambda k: k % 97 = 0), true) as ragged from n)
select page, case when page % 11 = 0 then 'row 1: repeated column' when page % 13 = 0 then 'row 1: no column start' when n > 16 then 'row 18: too many rows' when ragged > 0 then 'row ' || (ragged + 1) || ': ragged' else 'ok' end as verdict,
  case when page % 11 <> 0 and page % 13 <> 0 and n <= 16 and coalesce(ragged, 0) = 0 then n end as rows_taken, case when page % 11 <> 0 and page % 13 <> 0 and n <= 16 and coalesce(ragged, 0) = 0 then 'Show, "' || ids[1] || '"' || case when ids[1] % 4 = 0 then chr(10) || 'night' else '' end end as first_title,
  case when page % 11 <> 0 and page % 13 <> 0 and n <= 16 and coalesce(ragged, 0) = 0 then 'extra' || ids[n] end as last_note from v""")
def claim_files(t: Tables) -> DataFrame:
    """Claim files: taken whole or refused whole, naming the row; unknown columns are kept."""
    line = _text('"Show, ""', order_key().cast("string"), '""', F.when(order_key() % 4 == 0, "\nnight").otherwise(""), '",', F.date_format(order_date(), "yyyy-MM-dd"), ",extra", order_key().cast("string"), F.when(order_key() % 97 == 0, ",more").otherwise(""))
    head = F.when(F.col("page") % 11 == 0, "title,start,Title").when(F.col("page") % 13 == 0, "title,begin,note").otherwise("title,start,note")
    files = _joined(t.orders, line, "", "\r\n", "\r\n").select("page", F.concat(head, F.lit("\r\n"), "body").alias("body"))
    read = texts.claim_files(files, "page", "body", ("title", "start"), most=16)
    size = F.size("rows")
    return read.select("page", "verdict", F.when(size >= 0, size.cast("bigint")).alias("rows_taken"), F.col("rows")[0]["title"].alias("first_title"), F.element_at("rows", -1)["note"].alias("last_note"))


@query("""with l as (select s_suppkey as line, case when s_suppkey % 9 = 8 then null when s_suppkey % 9 = 7 then 'note' when s_suppkey % 9 = 6 then 'meta' when s_suppkey % 2 = 0 then 'node' else 'edge' end as kind,
  case when s_suppkey % 9 in (6, 8) then null when s_suppkey % 9 = 5 then null else 'i' || (s_suppkey // 4) end as id from supplier),
p as (select *, case when kind is null then 'corrupt' when kind = 'note' then 'unknown_kind' when kind = 'meta' then null when id is null then 'no_id'
  when row_number() over (partition by kind, id order by line) > 1 then 'repeated_id' end as problem from l)
select coalesce(kind, '') as kind, coalesce(problem, '') as problem, count(*) as n, min(line) as first_line from p group by 1, 2""")
def graph_lines(t: Tables) -> DataFrame:
    """Graph lines by kind and problem."""
    s = F.col("s_suppkey")
    ident = F.when(s % 9 == 5, "").otherwise(_text(', "id": "i', F.floor(s / 4).cast("string"), '"'))
    line = F.when(s % 9 == 8, '{"kind": "no').when(s % 9 == 6, '{"kind": "meta"}').otherwise(_text('{"kind": "', F.when(s % 9 == 7, "note").when(s % 2 == 0, "node").otherwise("edge"), '"', ident, "}"))
    read = texts.graph_lines(t.supplier.select(s.alias("line"), line.alias("body")), "body")
    return read.groupBy(F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 77")
def point_lookup(t: Tables) -> DataFrame:
    return texts.exactly_one(t.orders, order_key() == 77, "o_orderkey", "o_custkey", "o_orderstatus")


@query("select count(*) as n from orders")
def count_probe(t: Tables) -> DataFrame:
    """The number of rows, from the files' own counts."""
    return t.orders.agg(F.count("*").alias("n"))


@query("""select o_orderkey, case o_orderkey % 6 when 0 then 'a' when 1 then 'b' when 2 then 'c' when 3 then 'd' end as value from orders""")
def json_scalars(t: Tables) -> DataFrame:
    """One value of a list of one, an object, or a scalar; anything else is null."""
    raw = F.when(order_key() % 6 == 0, "a").when(order_key() % 6 == 1, '["b"]').when(order_key() % 6 == 2, '{"name": "c"}').when(order_key() % 6 == 3, '[{"@value": "d"}]').when(order_key() % 6 == 4, '["x", "y"]').otherwise('{"other": 1}')
    return t.orders.select(order_key(), texts.scalar(raw).alias("value"))


@query("""select o_orderkey, sha1(o_orderkey || '|' || strftime(o_orderdate, '%Y-%m-%d')) as id, case when o_orderkey % 4 > 0 then 'Show ' || o_orderkey end as title, strftime(o_orderdate, '%Y-%m-%d') as start,
  case when o_orderkey % 3 > 0 then 'Hall ' || o_custkey end as venue from orders""")
def field_mapped(t: Tables) -> DataFrame:
    """Rows of a data set under the names that its map gives; blanks are null, the id is made of the row."""
    raw = t.orders.select(order_key(), F.when(order_key() % 4 > 0, _text("Show ", order_key().cast("string"))).otherwise(" ").alias("evt_nm"), F.date_format(order_date(), "yyyy-MM-dd").alias("dt"), F.when(order_key() % 3 > 0, _text("Hall ", F.col("o_custkey").cast("string"))).otherwise("").alias("loc"))
    names = {"title": "evt_nm", "start": "dt", "venue": "loc"}
    fields = [F.nullif(F.trim(F.col(c)), F.lit("")).alias(n) for n, c in names.items()]
    return raw.select(order_key(), F.sha1(F.concat_ws("|", order_key(), "dt")).alias("id"), *fields)


@query("""select c_custkey, sha256('{"area":"' || c_mktsegment || '","id":' || c_custkey || ',"name":"' || c_name || '"}') as digest from customer""")
def canonical_digests(t: Tables) -> DataFrame:
    """Digest of the canonical JSON of a row: sorted names, no blanks."""
    body = F.to_json(F.struct(F.col("c_mktsegment").alias("area"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    return t.customer.select("c_custkey", F.sha2(body, 256).alias("digest"))


@query("""with e as (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events), m as (select event_id, 'reach' as metric, k as value from e union all select event_id, 'saves', k % 7 from e where k % 2 = 0)
select metric, count(*) as n, sum(value) as total from m group by metric""")
def flattened_insights(t: Tables) -> DataFrame:
    """Nested metrics as one row each; a metric without a value is left out."""
    k = F.get_json_object("props", "$.k")
    nested = _text('{"data": [{"name": "reach", "values": [{"value": ', k, '}]}, {"name": "saves", "values": [', F.when(k.cast("bigint") % 2 == 0, _text('{"value": ', (k.cast("bigint") % 7).cast("string"), "}")).otherwise(""), "]}]}")
    item = F.from_json(nested, "struct<data: array<struct<name: string, values: array<struct<value: bigint>>>>>")["data"]
    rows = t.events.select(F.explode(item).alias("m")).select(F.col("m.name").alias("metric"), F.try_element_at(F.col("m.values"), F.lit(1))["value"].alias("value")).where("value is not null")
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""with r as (select o_orderkey as k, case when o_orderkey % 2 = 0 then 'x' else 'y' end as provider from orders)
select k as o_orderkey, provider, provider || ':' || k as source_id, 'Show ' || k as title, case when provider = 'x' then 'Hall ' || (k % 20) else case when k % 3 > 0 then 'Room ' || (k % 20) end end as venue,
  case when provider = 'x' then cast(k % 50 as double) end as price_min, case when k % 5 > 0 then 'https://' || provider || '.example/' || k end as url from r""")
def provider_rows(t: Tables) -> DataFrame:
    """Records of two providers, each of its own shape, as rows of one shape."""
    k = order_key().cast("string")
    one = _text('{"id": "', k, '", "name": "Show ', k, '", "_embedded": {"venues": [{"name": "Hall ', (order_key() % 20).cast("string"), '"}]}, "priceRanges": [{"min": ', (order_key() % 50).cast("string"), ', "max": 99}]', F.when(order_key() % 5 > 0, _text(', "url": "https://x.example/', k, '"')).otherwise(""), "}")
    other = _text('{"id": ', k, ', "title": "Show ', k, '", "venue": ', F.when(order_key() % 3 > 0, _text('{"name": "Room ', (order_key() % 20).cast("string"), '"}')).otherwise("null"), F.when(order_key() % 5 > 0, _text(', "link": "https://y.example/', k, '"')).otherwise(""), "}")
    raw = t.orders.select(order_key(), F.when(order_key() % 2 == 0, "x").otherwise("y").alias("provider"), F.when(order_key() % 2 == 0, one).otherwise(other).alias("raw"))
    a = F.from_json("raw", "struct<id: string, name: string, url: string, _embedded: struct<venues: array<struct<name: string>>>, priceRanges: array<struct<min: double>>>")
    b = F.from_json("raw", "struct<id: string, title: string, link: string, venue: struct<name: string>>")
    x = F.col("provider") == "x"
    pick = lambda p, q: F.when(x, p).otherwise(q)
    return raw.select(
        order_key(), "provider", F.concat_ws(":", "provider", pick(a["id"], b["id"])).alias("source_id"), pick(a["name"], b["title"]).alias("title"), pick(a["_embedded"]["venues"][0]["name"], b["venue"]["name"]).alias("venue"),
        F.when(x, F.array_min(a["priceRanges"]["min"])).alias("price_min"), pick(a["url"], b["link"]).alias("url"))


@query("""select s_suppkey, case when s_suppkey % 5 = 0 then 'B' when s_suppkey % 2 = 0 then 'A' else 'C' end as class, s_suppkey % 5 = 0 as from_catalog from supplier
union all select s_suppkey + 100000, 'B', true from supplier where s_suppkey % 10 = 0""")
def catalog_upsert(t: Tables) -> DataFrame:
    """Stored sources with the catalog's entries merged in; an entry without a class is refused, never defaulted."""
    from ..operators import merge

    s = F.col("s_suppkey")
    stored = t.supplier.select(s, F.when(s % 2 == 0, "A").otherwise("C").alias("class"), F.lit(False).alias("from_catalog"))
    entry = lambda key, cls: _text('{"id": ', key.cast("string"), cls, "}")
    lines = t.supplier.where(s % 5 == 0).select(entry(s, F.lit(', "class": "B"')).alias("j")).unionByName(t.supplier.where(s % 10 == 0).select(entry(s + 100000, F.lit(', "class": "B"')).alias("j"))).unionByName(
        t.supplier.where(s % 7 == 3).select(entry(s + 200000, F.lit("")).alias("j")))
    e = F.from_json("j", "struct<id: bigint, class: string>")
    entries = lines.select(e["id"].alias("s_suppkey"), e["class"].alias("class"), F.lit(True).alias("from_catalog")).where("class is not null")
    return merge.upsert(stored, entries, ["s_suppkey"], "from_catalog")
