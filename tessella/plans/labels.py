"""Queries of text functions: keys, places, labels and small print. Inputs are written from rows, so the SQL states what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators import labels
from ..sources.tables import Tables

def order_key() -> Column:
    return F.col("o_orderkey")


def customer_key() -> Column:
    return F.col("c_custkey")


def _text(*parts):  # noqa: ANN002, ANN202
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _case(key, by: int, *options):  # noqa: ANN001, ANN002, ANN202
    out = options[-1]
    for i, o in reversed(list(enumerate(options[:-1]))):
        out = F.when(key % by == i, o).otherwise(out)
    return out


@query("""select o_orderkey, case o_orderkey % 5 when 3 then 'band ' || o_orderkey || ' at other hall' else 'band ' || o_orderkey end as performer from orders""")
def performer_keys(t: Tables) -> DataFrame:
    """The performer behind a title that names its own venue or supporting acts."""
    band = _text("The Band ", order_key().cast("string"))
    title = _case(order_key(), 5, _text(band, " at The Café"), _text(band, " feat. Somebody at Cafe"), band, _text(band, " at Other Hall"), _text(band, " w/ Guests"))
    return t.orders.select("o_orderkey", text.performer_at(title, F.lit("Cafe")).alias("performer"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 'arts crafts' when 1 then 'music nightlife' when 2 then 'sandand' else null end as label from customer""")
def label_keys(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.label_key(_case(customer_key(), 4, F.lit("Arts & Crafts"), F.lit("Music  and/Nightlife"), F.lit("SandAnd"), F.lit(None).cast("string"))).alias("label"))


@query("""select c_custkey, case when c_custkey % 7 < 6 then 'city ' || substr('abcdefghij', cast(c_nationkey % 10 + 1 as integer), 1) end as place, case when c_custkey % 7 in (3, 4) then 'bexar' end as county from customer""")
def place_keys(t: Tables) -> DataFrame:
    """The bare city and the county of a place, however feeds write it."""
    city = _text("City ", F.substring(F.lit("abcdefghij"), F.col("c_nationkey") % 10 + 1, F.lit(1)))
    place = _case(customer_key(), 7, city, _text(city, ", TX"), _text(city, ", TX 78701, USA"), _text(city, ", Bexar County, TX"), _text(city, ", Bexar County"), _text(" ", city, ". Texas. "), F.lit("  "))
    return t.customer.select("c_custkey", text.place_key(place).alias("place"), text.county_of(place).alias("county"))


@query("""select c_custkey, c_custkey % 4 < 2 as same, case when c_custkey % 3 = 0 then 'page' else 'other' end as door from customer""")
def same_places(t: Tables) -> DataFrame:
    """Places that are one at a word's end, and addresses that are no more than their own list page."""
    a, b = _text("Hall ", customer_key().cast("string")), _case(customer_key(), 4, _text("hall ", customer_key().cast("string"), " upstairs"), _text("The Hall ", customer_key().cast("string")), _text("Hall ", customer_key().cast("string"), "7"), F.lit(""))
    page = _text("https://X.example/list/", customer_key().cast("string"))
    address = F.when(customer_key() % 3 == 0, _text("https://x.example/list/", customer_key().cast("string"), "/#top")).otherwise(_text("https://x.example/show/", customer_key().cast("string")))
    return t.customer.select("c_custkey", text.same_place(a, b).alias("same"), text.own_door(page, address).alias("door"))


@query("""select o_orderkey, case o_orderkey % 6 when 0 then 'Free' when 1 then '$' || (o_orderkey % 40) when 2 then '$' || (o_orderkey % 40) || '-$' || (o_orderkey % 40 + 5) || '.50' end as label from orders""")
def price_labels(t: Tables) -> DataFrame:
    """What a price prints; negative and sub-cent prices print nothing."""
    n, dec = order_key() % 40, "decimal(12,4)"
    low = _case(order_key(), 6, F.lit(0).cast(dec), n.cast(dec), n.cast(dec), F.lit(-1).cast(dec), F.lit("3.001").cast(dec), F.lit(None).cast(dec))
    low = F.when((order_key() % 6 == 1) & (n == 0), F.lit(None).cast(dec)).otherwise(low)
    high = F.when(order_key() % 6 == 2, (n + F.lit("5.50").cast(dec)).cast(dec))
    label = text.price_label(low, high)
    return t.orders.select("o_orderkey", F.when((order_key() % 6 == 1) & (n == 0), "$0").otherwise(label).alias("label"))


@query("""select c_custkey, '#nation' || c_nationkey || ',#nation' || c_nationkey || 'events,#nation' || c_nationkey || lower(c_mktsegment) || case when c_mktsegment <> 'BUILDING' then ',#nation' || c_nationkey || 'building' else '' end as tags from customer""")
def city_hashtags(t: Tables) -> DataFrame:
    """Tags of a city and its domains, each once."""
    tags = text.hashtags(_text("Nation-", F.col("c_nationkey").cast("string")), F.array("c_mktsegment", F.lit("Buil-ding"), "c_mktsegment"))
    return t.customer.select("c_custkey", F.array_join(tags, ",").alias("tags"))


@query("""select doc_id, doc_id % 3 < 2 as grounded from documents where text is not null and regexp_matches(text, '[a-zA-Z]{5}')""")
def grounded_lines(t: Tables) -> DataFrame:
    """Lines all of whose words stand in their source."""
    word = F.regexp_extract("text", "([a-zA-Z]{5})", 1)
    source = F.concat(word, F.lit(" 1998 Jazz"))
    line = F.when(F.col("doc_id") % 3 == 0, _text("the ", word)).when(F.col("doc_id") % 3 == 1, _text(F.upper(word), " and jazz 1998")).otherwise(_text(word, " 1999"))
    return t.documents.where(F.col("text").rlike("[a-zA-Z]{5}")).select("doc_id", text.grounded(line, source, ["the", "and"]).alias("grounded"))


@query("""select o_orderkey, case when o_orderkey % 5 < 3 then strftime(o_orderdate, '%Y-%m-%d') end as day, case when o_orderkey % 2 = 0 then 'blue room' end as room from orders""")
def title_slots(t: Tables) -> DataFrame:
    """The date and the room that a title prints."""
    d = F.col("o_orderdate")
    when = _case(order_key(), 5, F.date_format(d, "MMM d, yyyy"), F.date_format(d, "M/d/yyyy"), F.date_format(d, "MMMM d yyyy"), F.lit("tonight"), F.lit("5"))
    title = _text("Show ", when, F.when(order_key() % 2 == 0, " (Blue Room)").otherwise(" all day"))
    return t.orders.select("o_orderkey", F.date_format(labels.title_day(title), "yyyy-MM-dd").alias("day"), labels.title_room(title).alias("room"))


TYPES_SQL = """case when p_partkey % 6 = 0 then 'schema' when p_partkey % 6 = 1 then 'provider' when p_partkey % 6 = 2 and p_size < 25 then 'curated_venue' when p_partkey % 6 in (2, 3) and p_size % 2 = 0 then 'venue_type'
  when contains(p_name, 'ring') or contains(p_name, 'bolt') then 'title' end"""


@query(f"""with s as (select *, {TYPES_SQL} as signal from part)
select p_partkey, case signal when 'schema' then 'theater' when 'provider' then 'music' when 'curated_venue' then 'arts' when 'venue_type' then 'club' when 'title' then case when contains(p_name, 'ring') then 'jewelry' else 'hardware' end else 'unmapped' end as domain,
  coalesce(signal, 'none') as signal from s""")
def category_signals(t: Tables) -> DataFrame:
    """The category of a row and the signal that decided it, of five."""
    k = F.col("p_partkey")
    even = (F.col("p_size") % 2 == 0) & k.cast("int").isNotNull()
    rows = t.part.select(
        k, F.when(k % 6 == 0, "TheaterEvent").when(k % 6 == 4, "Event").alias("schema_type"), F.when(k % 6 == 1, "KZFzniwnSyZfZ7v7nJ").when(k % 6 == 5, "undefined").alias("provider_code"),
        F.when((k % 6 == 2) & (F.col("p_size") < 25), "arts").alias("curated"), F.when((k % 6).isin(2, 3) & even, "nightclub").when(k % 6 == 4, "lot").alias("venue_type"), F.col("p_name").alias("title"))
    found = labels.category(
        F.col("schema_type"), F.col("provider_code"), F.col("curated"), F.col("venue_type"), F.col("title"), schema={"TheaterEvent": "theater", "MusicEvent": "music"}, provider={"KZFzniwnSyZfZ7v7nJ": "music"},
        venues={"nightclub": "club"}, words=[("ring", "jewelry"), ("bolt", "hardware")])
    return rows.select("p_partkey", found["domain"].alias("domain"), found["signal"].alias("signal"))


@query("""with k as (select p_partkey, case when p_partkey % 4 = 0 then 'ring' when p_partkey % 4 = 1 then null when p_type = 'PROMO' then 'offer' when p_type = 'ECONOMY' then 'cheap' end as kind, p_partkey % 4 as m from part)
select p_partkey, coalesce(kind, 'unmapped') as kind from k""")
def resolved_kinds(t: Tables) -> DataFrame:
    """Kinds by section id before label; what the map lacks is told, not guessed."""
    k = F.col("p_partkey")
    sections = F.when(k % 4 == 0, F.array(F.lit("s9"), F.lit("s1")))
    names = F.when(k % 4 != 1, F.array(F.lit("None & such"), F.col("p_type")))
    table = [("id", "s1", "ring"), ("label", "promo", "offer"), ("label", "economy", "cheap"), ("label", "standard", None)]
    return labels.resolve_kinds(t.part.select(k, sections.alias("sections"), names.alias("labels")), "p_partkey", [r for r in table if r[2]])


@query("""select s_suppkey, sha256(s_name) as digest, sha1(s_name) as row_id, length(s_name) as n_bytes from supplier""")
def content_hashes(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.sha2("s_name", 256).alias("digest"), F.sha1("s_name").alias("row_id"), F.octet_length("s_name").alias("n_bytes"))


@query("""with w as (select c_nationkey as market, c_mktsegment as kind from customer group by 1, 2), p as (select market, t || ' ' || lower(kind) || ' nation ' || market as q, pos * 10 + row_number() over (partition by market, t order by kind) as n
  from w, (values ('best', 0), ('free', 1)) v(t, pos)) select market, q as query, row_number() over (partition by market order by n) as place from p""")
def search_grammar(t: Tables) -> DataFrame:
    """Every template with every kind of a market, each once, in order."""
    kinds = t.customer.select(F.col("c_nationkey").alias("market"), F.col("c_mktsegment").alias("kind"))
    grammar = labels.search_queries(kinds, ["best {kind} {place}", "free {kind} {place}", "best {kind} {place}"], F.concat(F.lit("nation "), F.col("market").cast("string")))
    return grammar.select("market", "query", "place")


@query("""select p_partkey, case when p_size % 7 = 0 then 'D' when p_type = 'PROMO' then case when p_size % 3 = 0 then 'F' else 'A' end when p_type = 'ECONOMY' then 'B' when p_partkey % 5 = 0 then 'C' else 'E' end as class from part""")
def source_classes(t: Tables) -> DataFrame:
    """Coverage class of a source; a wall puts it in D whatever it is."""
    k, size = F.col("p_partkey"), F.col("p_size")
    tokens = F.array_compact(F.array(F.lower("p_type"), F.when(k % 5 == 0, "directory"), F.when(size % 3 == 0, "social")))
    status = F.when((size % 7 == 0) & (size % 2 == 0), 403).otherwise(200)
    url = F.when((size % 7 == 0) & (size % 2 == 1), "https://x.example/login?next=1").otherwise("https://x.example/")
    rules = [("F", ["promo"], ["social"]), ("A", ["promo"], []), ("B", ["economy"], []), ("C", ["directory"], [])]
    return t.part.select(k, labels.source_class(tokens, status, url, rules, "E").alias("class"))


@query("""with r as (select *, case when c_custkey % 5 = 0 then 'present' when c_custkey % 5 = 1 then 'absent' else 'unknown' end as m from customer)
select c_custkey, case when m = 'unknown' then null else 'x' || (c_nationkey % 3) end as glyph, case c_custkey % 5 when 0 then 'Confirmed' when 1 then 'Likely' when 2 then 'Unverified' when 3 then 'Disputed' else 'Unverified' end as shown from r""")
def display_maps(t: Tables) -> DataFrame:
    """The sign of a pair of coordinates, and the words for a state of trust."""
    state = _case(customer_key(), 5, F.lit("confirmed"), F.lit("likely"), F.lit("unverified"), F.lit("disputed"), F.lit("other"))
    mood = F.when(customer_key() % 5 < 2, F.when(customer_key() % 5 == 0, "calm").otherwise("wild"))
    signs = [(m, i, f"x{i}") for m in ("calm", "wild") for i in range(3)]
    table = t.spark.createDataFrame(signs, "mood string, degree int, glyph string")
    rows = t.customer.select("c_custkey", mood.alias("mood"), (F.col("c_nationkey") % 3).cast("int").alias("degree"), state.alias("state"))
    return rows.join(F.broadcast(table), ["mood", "degree"], "left").select("c_custkey", "glyph", labels.trust_label(F.col("state")).alias("shown"))  # a fixed table
