"""Pages as rows: anchors, signals, segments, identities and emitted markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators import segments
from ..sources.tables import Tables

HOST_SQL = "regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"
ANCHORS_SQL = """anchors as (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']?([^"''\\s>]+)', 1)) as href from pages)"""


def order_key() -> Column:
    return F.col("o_orderkey")


def _text(*parts) -> Column:  # noqa: ANN002
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query(f"with {ANCHORS_SQL} select page_id, href, count(*) as n from anchors where regexp_full_match(href, '/[A-Za-z]{{4,}}') group by 1, 2")
def directory_links(t: Tables) -> DataFrame:
    """Anchors of a directory page whose address on its own host fits the directory's pattern."""
    rows = segments.anchors(t.pages, "page_id", "html").where(F.col("href").rlike("^/[A-Za-z]{4,}$"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(f"""with {ANCHORS_SQL}, l as (select page_id, lower(href) as h, {HOST_SQL.format(u="url")} as own from anchors)
select case when starts_with(h, 'mailto:') then 'mail' when starts_with(h, 'tel:') then 'phone' when regexp_matches(h, '(\\.ics|/feed/?|\\.rss|\\.xml)([?#]|$)') then 'feed' when regexp_matches(h, '(maps\\.|/maps/)') then 'map'
  when regexp_matches(h, '(^|[/.])(facebook|instagram|twitter|youtube)\\.com') then 'social' when contains(h, 'ticket') then 'ticket' when not regexp_matches(h, '^[a-z][a-z0-9+.-]*:') or {HOST_SQL.format(u="h")} = own then 'own' else 'other' end as signal,
  count(*) as n, count(distinct page_id) as pages from l group by 1""")
def link_signals(t: Tables) -> DataFrame:
    """What the links of all pages tell: mail, feeds, maps, tickets, their own site."""
    own = t.pages.select("page_id", text.host(F.col("url")).alias("own"), "html")
    rows = own.select("page_id", "own", F.explode(F.regexp_extract_all("html", F.lit(f"(?i){segments.ANCHOR}"), 1)).alias("href"))
    return rows.groupBy(segments.link_signal(F.col("href"), F.col("own")).alias("signal")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def _listing_texts(t: Tables) -> DataFrame:
    """One text a customer: a heading, then a block for each order, with its date on a line of its own."""
    block = _text(F.date_format("o_orderdate", "yyyy-MM-dd"), " Show ", order_key().cast("string"), "\nat ", "o_orderpriority", "\n")
    rows = t.orders.groupBy(F.col("o_custkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct(order_key(), block.alias("s"))))["s"].alias("s"))
    return rows.select("page", _text("What is on\n", F.array_join("s", "")).alias("body"))


@query("""with n as (select o_custkey as page, count(*) as n from orders group by 1), o as (select o_custkey as page, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as pos, strftime(o_orderdate, '%Y-%m-%d') || ' Show ' || o_orderkey as head from orders)
select page, cast(pos as integer) as pos, head from o join n using (page) where n >= 2 union all select page, 0, 'What is on' from n""")
def text_segments(t: Tables) -> DataFrame:
    """Listing texts cut before lines that begin with a date; one dated line alone cuts nothing."""
    rows = segments.dated_segments(_listing_texts(t), "page", "body")
    return rows.select("page", "pos", F.substring_index("segment", "\n", 1).alias("head"))


@query("""with b as (select l_orderkey as page, l_partkey % 5 as ref, l_suppkey % 7 as id, l_linenumber, l_partkey, l_suppkey from lineitem)
select page, l_linenumber, l_partkey, l_suppkey, case when count(ref) over (partition by page, ref) = 1 then ref end as ref, case when count(id) over (partition by page, id) = 1 then id end as id from b""")
def own_identities(t: Tables) -> DataFrame:
    """Identity values of a page's blocks; a value that several blocks state identifies none."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 5).alias("ref"), (F.col("l_suppkey") % 7).alias("id"), "l_linenumber", "l_partkey", "l_suppkey")
    return segments.own_identities(rows, "page", "ref", "id")


@query("""select page_id, case when regexp_full_match(url, 'https?://[^/]+/en/[0-9]+') then 'english' when regexp_full_match(url, 'https?://[^/]+/[a-z]{2}/[0-9]+.*') then 'numbered' when regexp_full_match(url, 'https?://[^/]+/?') then 'door' end as pattern from pages""")
def identity_patterns(t: Tables) -> DataFrame:
    """The first committed pattern that a page's whole address fits."""
    table = [("english", r"https?://[^/]+/en/[0-9]+"), ("numbered", r"https?://[^/]+/[a-z]{2}/[0-9]+.*"), ("door", r"https?://[^/]+/?")]
    return t.pages.select("page_id", segments.first_pattern(F.col("url"), table).alias("pattern"))


@query("""select o_orderkey, case when o_orderkey % 4 < 3 then 'Hall ' || (o_orderkey % 9) end as place from orders""")
def card_places(t: Tables) -> DataFrame:
    """The place that a card prints behind its title and clock."""
    k = order_key()
    place = F.when(k % 4 < 3, _text("\nHall ", (k % 9).cast("string"))).otherwise("")
    card = _text("Show ", k.cast("string"), "\n 8:30 pm ", F.when(k % 2 == 0, "\n$12").otherwise("\nFree"), place, F.when(k % 4 == 0, "\nmore words").otherwise(""))
    return t.orders.select("o_orderkey", segments.place_after_title(card).alias("place"))


@query("""with s as (select o_custkey as page, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select c_custkey as page, coalesce(n, 0) as pos, o_orderkey as block, o_orderkey is null as empty from customer left join s on page = c_custkey and n <= 5""")
def candidate_fan_out(t: Tables) -> DataFrame:
    """One candidate a block, at most five a page, and one flagged as empty for a page without blocks."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = t.orders.select("o_custkey", "o_orderkey", nth.alias("n")).where("n <= 5")
    rows = t.customer.select("c_custkey").join(first, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("page"), F.coalesce("n", F.lit(0)).alias("pos"), F.col("o_orderkey").alias("block"), F.col("o_orderkey").isNull().alias("empty"))


@query("""select o_orderkey, '{"@context":"https://schema.org","@type":"Event","name":"Show ' || o_orderkey || '"' || case when o_orderkey % 7 <> 0 then ',"startDate":"' || strftime(o_orderdate, '%Y-%m-%d') || '"' else '' end
|| case when o_orderkey % 3 > 0 then ',"location":{"@type":"Place","name":"Hall ' || o_custkey || '"}' else '' end || case when o_orderkey % 5 = 0 then ',"offers":{"price":' || (o_orderkey % 40) || '}' else '' end || '}' as markup from orders""")
def event_markup(t: Tables) -> DataFrame:
    """Linked data that a page emits for an event."""
    k = order_key()
    start = F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    place = F.when(k % 3 > 0, _text("Hall ", F.col("o_custkey").cast("string")))
    return t.orders.select("o_orderkey", segments.event_markup(_text("Show ", k.cast("string")), start, place, F.when(k % 5 == 0, k % 40)).alias("markup"))


@query("""with w as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) as pos from lineitem)
select l_suppkey, l_orderkey, l_linenumber, l_partkey, 'walk:' || l_suppkey || ':' || pos as row_key from w""")
def walk_ordinals(t: Tables) -> DataFrame:
    """The place of a row within its walk, as the key of rows that have no other."""
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    return t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(":", F.lit("walk"), "l_suppkey", pos).alias("row_key"))


@query("""with k as (select p_partkey, case when p_type = 'PROMO' then 'api' when p_size % 4 = 0 then 'calendar' when p_brand like '%1' then 'page' else 'none' end as kind, case when p_partkey % 6 = 0 then 'blocked' else 'open' end as status from part)
select kind, status, count(*) as n, count(*) filter (where p_partkey % 2 = 0) as passed from k group by kind, status""")
def source_pathways(t: Tables) -> DataFrame:
    """Sources by the way they can be read and its state, and how many a probe passed."""
    k = F.col("p_partkey")
    kind = F.when(F.col("p_type") == "PROMO", "api").when(F.col("p_size") % 4 == 0, "calendar").when(F.col("p_brand").endswith("1"), "page").otherwise("none")
    return t.part.groupBy(kind.alias("kind"), F.when(k % 6 == 0, "blocked").otherwise("open").alias("status")).agg(F.count("*").alias("n"), F.count_if(k % 2 == 0).alias("passed"))
