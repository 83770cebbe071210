"""Feed queries by wish, scenario and plan, and the orders in which work is taken up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators import desires, feed, state
from ..sources.tables import FETCHES_SQL, LISTINGS_SQL, Tables

def order_key() -> Column:
    return F.col("o_orderkey")
GENRES = ("Jazz", "Rock", "Salsa · Live", "Folk", "Metal", "House")
CATEGORIES = ("music", "comedy", "family", "theater", "nightlife")


def _pick(by: int, values: tuple[str, ...], key=None):  # noqa: ANN001, ANN202
    out, key = F.lit(None).cast("string"), order_key() if key is None else key
    for i, v in enumerate(values):
        out = F.when(key % by == i, v).otherwise(out)
    return out


def _pick_sql(by: int, values: tuple[str, ...], key: str = "o_orderkey") -> str:
    return f"case {key} % {by} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


SHOWS_SQL = f"""shows as (select o_orderkey as id, c_nationkey as market, {_pick_sql(7, GENRES)} as genre, {_pick_sql(6, CATEGORIES)} as category, o_orderkey % 8 = 0 as is_free,
  case when o_orderkey % 5 > 0 then o_orderkey % 40 end as price_min, case when o_orderkey % 5 > 0 then o_orderkey % 40 + 5 end as price_max, c_mktsegment as area,
  case when o_orderkey % 9 > 0 then 16 + (o_orderkey * 7 % 44) / 4.0 end as hours from orders join customer on c_custkey = o_custkey)"""


def _shows(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        order_key().alias("id"), F.col("c_nationkey").alias("market"), _pick(7, GENRES).alias("genre"), _pick(6, CATEGORIES).alias("category"), (order_key() % 8 == 0).alias("is_free"), F.when(order_key() % 5 > 0, order_key() % 40).alias("price_min"),
        F.when(order_key() % 5 > 0, order_key() % 40 + 5).alias("price_max"), F.col("c_mktsegment").alias("area"), F.when(order_key() % 9 > 0, 16 + (order_key() * 7 % 44) / 4.0).alias("hours"))


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} in (" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"""with {SHOWS_SQL}, s as (select *, split_part(coalesce(genre, ''), ' · ', 1) as g, cast(floor(hours) as integer) as hour from shows)
select id, concat_ws(',', case when is_free or price_min = 0 then 'free' end, case when price_max <= 20 then 'cheap' end, case when hour >= 22 then 'late' end,
  case when {_in('g', desires.DANCE)} or {_in("coalesce(category, '')", ('dance', 'nightlife'))} then 'dance' end, case when {_in('g', desires.QUIET)} then 'quiet' end, case when {_in('g', desires.LOUD)} then 'loud' end,
  case when category = 'comedy' then 'laugh' end, case when category = 'family' then 'family' end, case when {_in('category', desires.ARTS)} then 'arts' end) as wishes from s""")
def desire_matches(t: Tables) -> DataFrame:
    """The wishes that each listing answers."""
    rows = _shows(t).withColumn("hour", F.floor("hours").cast("int"))
    return rows.select("id", F.concat_ws(",", *(F.when(test, name) for name, test in desires.desires().items())).alias("wishes"))


def _plan_sql() -> str:
    parts = [f"with {SHOWS_SQL}, b as (select *, case when hours >= 17 and hours < 20 then 0 when hours >= 20 and hours < 22.5 then 1 when hours >= 22.5 and hours < 27 then 2 end as block from shows)",
             "s0 as (select market, null::varchar as area, null::varchar as category from b where block is not null group by market)"]
    for i in range(3):
        parts.append(
            f"r{i} as (select s.market, b.id, b.area, b.category, row_number() over (partition by s.market order by case when b.area = s.area then -2 else 0 end + case when b.category = s.category then 1 else 0 end, b.hours, b.id) as n,"
            f" s.area as old_area, s.category as old_category from s{i} s left join b on b.market = s.market and b.block = {i})"
        )
        parts.append(f"s{i + 1} as (select market, id as id{i}, coalesce(area, old_area) as area, coalesce(category, old_category) as category from r{i} where n = 1)")
    return ", ".join(parts) + " select s1.market, id0 as early, id1 as main, id2 as late from s1 join s2 using (market) join s3 using (market)"


@query(_plan_sql())
def evening_plans(t: Tables) -> DataFrame:
    """One listing for each block of a market's night, chosen in turn."""
    return desires.evening_plans(_shows(t).withColumnRenamed("category", "domain"), "market")


@query(f"with {SHOWS_SQL} select id, category, price_min from shows where category in ('music', 'theater') and price_min <= 25 and floor(hours) >= 20")
def scenario_events(t: Tables) -> DataFrame:
    """Listings of a scenario: its domains, under its price (an unstated price is not), from its hour on."""
    return _shows(t).where(F.col("category").isin("music", "theater") & (F.col("price_min") <= 25) & (F.floor("hours") >= 20)).select("id", "category", "price_min")


@query(f"""with {LISTINGS_SQL} select event_id, price from listings where start_time >= timestamp '1998-01-01' and start_time <= timestamp '1998-12-31' and status <> 'cancelled'""")
def bounded_window(t: Tables) -> DataFrame:
    """A window whose bounds are texts; an unreadable bound raises and is never no bound."""
    start = F.col("start_time")
    return t.listings().where(start.between(feed.bound("1998-01-01"), feed.bound("1998-12-31")) & (F.col("status") != "cancelled")).select("event_id", "price")


@query(f"""with {LISTINGS_SQL} select event_id, coalesce(start_time > timestamp '1998-06-01 12:00:00', true) as ahead from listings
where start_time is null or start_time + interval 3 hour > timestamp '1998-06-01 12:00:00'""")
def live_listings(t: Tables) -> DataFrame:
    """Listings that have not ended."""
    timing = feed.timing(F.col("start_time"), F.lit(None).cast("timestamp_ntz"), "1998-06-01 12:00:00")
    return t.listings().withColumn("timing", timing).where("timing <> 'ended'").select("event_id", (F.col("timing") == "upcoming").alias("ahead"))


@query("select c_custkey as id, c_name as name, c_mktsegment as area from customer where c_custkey % 6 > 0")
def public_rows(t: Tables) -> DataFrame:
    """The view that is open to all: rows that are not private, and only the columns of the list."""
    t.customer.withColumn("private", F.col("c_custkey") % 6 == 0).where("not private").selectExpr("c_custkey as id", "c_name as name", "c_mktsegment as area").createOrReplaceTempView("public_customer")
    return t.spark.table("public_customer")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_returnflag = 'R' order by l_shipdate desc, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 200")
def review_inbox(t: Tables) -> DataFrame:
    """The newest 200 candidates that wait for review."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.where("l_returnflag = 'R'").orderBy(F.desc("l_shipdate"), *keys).limit(200).select(*keys)


@query("select s_suppkey from supplier where s_nationkey % 6 = 1 order by s_acctbal desc, s_suppkey limit 5")
def class_then_ceiling(t: Tables) -> DataFrame:
    """Sources of one coverage class, then the ceiling: the other way round would leave fewer."""
    letter = F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.col("s_nationkey") % 6 + 1).cast("int"))
    return t.supplier.where(letter == "B").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select("s_suppkey")


@query("""select held, count(*) as n from (select case when event_id % 5 = 0 then 'no_door' when event_id % 7 = 0 then 'no_title' else 'exists' end as held from events) group by held""")
def existence(t: Tables) -> DataFrame:
    """A readable door and a title prove a happening; a missing date or place never holds it."""
    k = F.col("event_id")
    verdict = feed.existence(k % 5 > 0, F.when(k % 7 > 0, F.col("event_type")).otherwise(" "))
    return t.events.groupBy(verdict.alias("held")).agg(F.count("*").alias("n"))


@query(r"select doc_id from documents where regexp_matches(text, '(?i)\b(the|and|avec)\b')")
def banned_phrases(t: Tables) -> DataFrame:
    """Documents with a phrase of the list as whole words, in any case."""
    return t.documents.where(text.has_phrase(F.col("text"), ["the", "and", "avec"])).select("doc_id")


@query(f"""with {LISTINGS_SQL} select event_id, strftime(start_time, '%H:%M') as clock from (select event_id, start_time + to_minutes(cast(event_id % 3 * 400 as integer)) as start_time from listings)
order by case when start_time is null or strftime(start_time, '%H:%M') = '00:00' then 1 else 0 end, start_time nulls last, event_id""")
def clock_sorted(t: Tables) -> DataFrame:
    """By start; rows without a printed hour come last, none is dropped."""
    rows = t.listings().withColumn("start_time", F.col("start_time") + F.make_dt_interval(mins=(F.col("event_id") % 3 * 400).cast("int")))
    clock = F.date_format("start_time", "HH:mm")
    untimed = F.when(F.col("start_time").isNull() | (clock == "00:00"), 1).otherwise(0)
    return rows.orderBy(untimed, F.asc_nulls_last("start_time"), "event_id").select("event_id", clock.alias("clock"))


@query(f"""with {FETCHES_SQL}, l as (select source_id, max(fetched_at) filter (where not failed and source_id % 4 > 0) as last, min(fetch_id) as rank from fetches group by 1)
select source_id, row_number() over (order by date_diff('minute', last, timestamp '2024-03-01') - 60 * (source_id % 24) desc nulls first, rank, source_id) as place from l""")
def overdue_order(t: Tables) -> DataFrame:
    """Most overdue first; what was never read comes before all."""
    last = t.fetches().groupBy("source_id").agg(F.max(F.when(~F.col("failed") & (F.col("source_id") % 4 > 0), F.col("fetched_at"))).alias("last"), F.min("fetch_id").alias("rank"))
    minute = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / 60)
    rows = last.withColumn("overdue", minute(feed.at("2024-03-01")) - minute(F.col("last")) - 60 * (F.col("source_id") % 24))
    order = Window.orderBy(F.desc_nulls_first("overdue"), "rank", "source_id")  # a row a source
    return rows.select("source_id", F.row_number().over(order).cast("bigint").alias("place"))


@query("""select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by case when l_returnflag = 'R' then 0 when l_discount > 0.02 then 1 else 2 end, l_orderkey, l_linenumber, l_partkey) as place from lineitem""")
def publish_order(t: Tables) -> DataFrame:
    """The order in which every source's rows are published: corrections, then what can be, then what is held; each in page order."""
    group = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_discount") > 0.02, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(group, "l_orderkey", "l_linenumber", "l_partkey"))
    return t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", place.cast("bigint").alias("place"))


@query("""with l as (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>[^<]*', 1)) as href, unnest(range(1, 1 + len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>[^<]*', 1)))) as pos from pages),
r as (select *, case when contains(lower(href), 'th') then 0 when starts_with(href, '/') then 1 else 2 end as tier from l)
select page_id, href, tier, n from (select *, row_number() over (partition by page_id order by tier, pos) as n from r) where n <= 3""")
def ranked_links(t: Tables) -> DataFrame:
    """The best three links of a page: those whose address names the topic, then those on the site, then others, each in page order."""
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"[^>]*>[^<]*'), 1)
    rows = t.pages.select("page_id", F.posexplode(found).alias("pos", "href"))
    tier = F.when(F.contains(F.lower("href"), F.lit("th")), 0).when(F.col("href").startswith("/"), 1).otherwise(2)
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("tier", "pos"))
    return rows.withColumn("tier", tier).withColumn("n", nth).where("n <= 3").select("page_id", "href", "tier", "n")


@query("""with i as (select event_id, unnest([{'w': 640 + event_id % 5 * 100, 'h': 360}, {'w': 1600, 'h': 900}, {'w': 1200 + event_id % 7 * 200, 'h': 1200}]) as x from events),
r as (select *, case when abs(x.w / x.h - 16.0 / 9) < 0.01 and event_id % 4 > 0 then 1 else 0 end as wide from i where event_id % 4 > 0 or x.w <> 1600)
select event_id, x.w as width, wide = 1 as wide from (select *, row_number() over (partition by event_id order by wide desc, x.w desc) as n from r) where n = 1""")
def best_images(t: Tables) -> DataFrame:
    """The widest image of 16 to 9, else the widest."""
    k = F.col("event_id")
    image = lambda w, h: F.struct(w.cast("bigint").alias("w"), F.lit(h).cast("bigint").alias("h"))
    images = F.array(image(640 + k % 5 * 100, 360), image(F.lit(1600), 900), image(1200 + k % 7 * 200, 1200))
    images = F.when(k % 4 > 0, images).otherwise(F.filter(images, lambda x: x["w"] != 1600))
    ranked = F.transform(images, lambda x: F.struct(F.abs(x["w"] / x["h"] - 16 / 9).__lt__(0.01).alias("wide"), x["w"].alias("w")))
    best = F.array_max(F.transform(ranked, lambda x: F.struct((x["wide"] & (k % 4 > 0)).alias("wide"), x["w"].alias("w"))))
    return t.events.select("event_id", best["w"].alias("width"), best["wide"].alias("wide"))


@query("""with s as (select p_partkey, p_brand, round(0.3 * (p_size / 50.0) + 0.7 * (p_partkey % 11) / 10.0, 9) as raw from part),
c as (select *, round(case when p_partkey % 6 = 0 then raw * 0.5 else raw end, 9) as score from s)
select p_brand, p_partkey as plan, score from (select *, row_number() over (partition by p_brand order by score desc, p_partkey) as n from c) where n = 1""")
def feed_plans(t: Tables) -> DataFrame:
    """The plan with the best score of prior and precedent; a known risk halves it, ties go to the first."""
    raw = F.round(0.3 * (F.col("p_size") / 50.0) + 0.7 * (F.col("p_partkey") % 11) / 10.0, 9)
    scored = t.part.select("p_brand", "p_partkey", F.round(F.when(F.col("p_partkey") % 6 == 0, raw * 0.5).otherwise(raw), 9).alias("score"))
    best = scored.groupBy("p_brand").agg(F.max(F.struct("score", (-F.col("p_partkey")).alias("k"))).alias("b"))
    return best.select("p_brand", (-F.col("b.k")).alias("plan"), F.col("b.score").alias("score"))


@query("""select p_partkey, p_type from part join (values ('PROMO', 0), ('ECONOMY', 1), ('STANDARD', 2)) d(kind, pos) on p_type = kind order by pos, p_partkey""")
def hunt_order(t: Tables) -> DataFrame:
    """Doors in the order of their kinds, then by id."""
    kinds = t.spark.createDataFrame([("PROMO", 0), ("ECONOMY", 1), ("STANDARD", 2)], "kind string, pos int")
    return t.part.join(F.broadcast(kinds), F.col("p_type") == F.col("kind")).orderBy("pos", "p_partkey").select("p_partkey", "p_type")  # a fixed list


LEXICON = [("jazz", "jazz"), ("rock", "rock"), ("hard rock", "metal"), ("salsa", "latin"), ("metal", "metal"), ("folk", "folk")]
GENRE_SQL = "case when contains(lower(genre), 'hard rock') then 'metal' when contains(lower(genre), 'salsa') then 'latin' when contains(lower(genre), 'metal') then 'metal' when contains(lower(genre), 'jazz') then 'jazz' when contains(lower(genre), 'rock') then 'rock' when contains(lower(genre), 'folk') then 'folk' end"


@query(f"with {SHOWS_SQL} select value, count(*) as n, min(id) as first_seen from (select id, {GENRE_SQL} as value from shows) where value is not null group by value")
def genre_facet(t: Tables) -> DataFrame:
    """Listings by canonical genre: the longest keyword that the printed genre holds."""
    return feed.facet(_shows(t).withColumn("canonical", text.longest_keyword(F.col("genre"), LEXICON)), "canonical", "id")


@query(f"""with {SHOWS_SQL} select market, count(*) filter (where hours >= 20 and area = 'BUILDING') as shown, count(*) filter (where hours >= 20) as in_window, count(*) filter (where hours >= 20 and area <> 'BUILDING') as held_back from shows group by market""")
def view_counts(t: Tables) -> DataFrame:
    """What a view shows, what its window holds, and what the region keeps back."""
    inside, here = F.col("hours") >= 20, F.col("area") == "BUILDING"
    return _shows(t).groupBy("market").agg(F.count_if(inside & here).alias("shown"), F.count_if(inside).alias("in_window"), F.count_if(inside & ~here).alias("held_back"))


@query("""select o.o_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey from orders o join lineitem l on l.l_orderkey = o.o_orderkey where l.l_returnflag = 'R'""")
def event_candidates(t: Tables) -> DataFrame:
    """Events with the candidates that they were promoted from."""
    rows = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return t.orders.select("o_orderkey").join(rows, F.col("l_orderkey") == order_key()).drop("l_orderkey")


@query("""with s as (select lower(s_name) as name, min(s_suppkey) as id from supplier group by 1), c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 3 = 0 then 'SUPPLIER#' else 'Supplier#' end || lpad(cast(l_suppkey as varchar), 9, '0') as source_name from lineitem)
select c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_suppkey, s.id as source_id from c join s on lower(c.source_name) = s.name""")
def source_by_name(t: Tables) -> DataFrame:
    """Rows that name their source in any case, with its id; of two sources of one name the least id."""
    s = t.supplier.groupBy(F.lower("s_name").alias("name")).agg(F.min("s_suppkey").alias("source_id"))
    written = F.concat(F.when(F.col("l_partkey") % 3 == 0, "SUPPLIER#").otherwise("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lower(written).alias("name"))
    return rows.join(s, "name").drop("name")


@query("""with s as (select min(s_suppkey) as ref, case when s_nationkey = 3 then '' else 'n' || s_nationkey end as artist_ref, 'line ' || max(s_suppkey) as line from supplier group by s_nationkey)
select o_orderkey, line from (select o_orderkey, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then '' else 'n' || (o_orderkey % 30) end as artist_ref from orders) o left join s on o.artist_ref = s.artist_ref and o.artist_ref <> ''""")
def attached_lines(t: Tables) -> DataFrame:
    """Each listing with the line of its artist; an empty reference attaches nothing and no row is lost or doubled."""
    ref = F.when(F.col("s_nationkey") == 3, "").otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    lines = t.supplier.groupBy(ref.alias("artist_ref")).agg(F.concat(F.lit("line "), F.max("s_suppkey").cast("string")).alias("line")).where("artist_ref <> ''")
    own = F.when(order_key() % 4 == 0, None).when(order_key() % 4 == 1, "").otherwise(F.concat(F.lit("n"), (order_key() % 30).cast("string")))
    return t.orders.select("o_orderkey", own.alias("artist_ref")).join(lines, "artist_ref", "left").select("o_orderkey", "line")


@query("select p_partkey, p_name from part where p_brand in ('Brand#1', 'Brand#7', 'Brand#11')")
def in_list(t: Tables) -> DataFrame:
    """Rows whose key is in a list: a semi-join with the list as a small table."""
    wanted = t.spark.createDataFrame([(b,) for b in ("Brand#1", "Brand#7", "Brand#11", "Brand#7")], "p_brand string")
    return t.part.join(F.broadcast(wanted), "p_brand", "left_semi").select("p_partkey", "p_name")  # a fixed list


@query("""with k as (select distinct lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '')) as host from pages where page_id % 3 = 0),
h as (select page_id, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '')) as host from pages where page_id % 3 > 0)
select page_id, h.host from h anti join k using (host) where h.host not in ('example.com', 'example.net')""")
def new_hosts(t: Tables) -> DataFrame:
    """Found pages whose host is neither in the catalog nor a platform."""
    rows = t.pages.select("page_id", text.host(F.col("url")).alias("host"))
    fresh = rows.where((F.col("page_id") % 3 > 0) & ~F.col("host").isin("example.com", "example.net"))
    return fresh.join(rows.where("page_id % 3 = 0").select("host").distinct(), "host", "left_anti").select("page_id", "host")
