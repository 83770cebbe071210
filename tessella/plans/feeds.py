"""Feed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import feed
from ..sources.tables import LISTINGS_SQL, VENUES_SQL, Tables

NOW, UNTIL = "1998-06-01 18:00:00", "1998-06-05 18:00:00"
RANK_SQL = "case confidence when 'confirmed' then 0 when 'likely' then 1 when 'unverified' then 2 when 'disputed' then 3 else 4 end"


@query(f"""with {LISTINGS_SQL}, {VENUES_SQL}
select event_id, venue_name, city, confidence, {RANK_SQL} as rank, strftime(start_time, '%Y-%m-%d') as start_day
from listings left join venues using (venue_id)
where status = 'scheduled' and start_time between timestamp '{NOW}' and timestamp '{UNTIL}'
order by rank, start_time nulls last, event_id limit 50""")
def tonight_feed(t: Tables) -> DataFrame:
    rows = feed.tonight(t.listings(), t.venues(), NOW, UNTIL)
    return rows.select("event_id", "venue_name", "city", "confidence", "rank", F.date_format("start_time", "yyyy-MM-dd").alias("start_day"))


@query(f"""with {LISTINGS_SQL} select event_id, strftime(start_time, '%Y-%m-%d') as start_day from listings
where status = 'scheduled' order by start_time asc nulls last, event_id limit 100""")
def event_list(t: Tables) -> DataFrame:
    rows = t.listings().where("status = 'scheduled'").orderBy(F.asc_nulls_last("start_time"), "event_id").limit(100)
    return rows.select("event_id", F.date_format("start_time", "yyyy-MM-dd").alias("start_day"))


@query(f"""with {LISTINGS_SQL} select event_id, status, strftime(start_time, '%Y-%m-%d') as start_day from listings
where status in ('scheduled', 'moved') and (start_time between timestamp '1998-01-01' and timestamp '1998-03-01' or start_time is null)""")
def feed_null_window(t: Tables) -> DataFrame:
    keep = feed.within(F.col("start_time"), "1998-01-01", "1998-03-01", keep_null=True)
    return t.listings().where(F.col("status").isin("scheduled", "moved") & keep).select("event_id", "status", F.date_format("start_time", "yyyy-MM-dd").alias("start_day"))


@query(f"""with {LISTINGS_SQL}, w as (select event_id, start_time, event_id % 5 = 0 as date_only,
  case when event_id % 3 = 0 then start_time + interval 20 hour end as end_time from listings),
c as (select *, case when date_only then date_trunc('day', start_time) + interval 1 day else coalesce(end_time, start_time + interval 3 hour) end as last from w)
select case when start_time is null then 'upcoming' when last <= timestamp '1998-06-01 12:00:00' then 'ended'
  when start_time <= timestamp '1998-06-01 12:00:00' then 'on_now' else 'upcoming' end as timing, count(*) as n from c group by 1""")
def event_timing(t: Tables) -> DataFrame:
    end = F.when(F.col("event_id") % 3 == 0, F.col("start_time") + F.expr("interval 20 hours"))
    timing = feed.timing(F.col("start_time"), end, "1998-06-01 12:00:00", F.col("event_id") % 5 == 0)
    return t.listings().groupBy(timing.alias("timing")).agg(F.count("*").alias("n"))


@query(f"""with {LISTINGS_SQL}, tabs as (select cast(i as integer) as tab, timestamp '1998-06-01' + to_days(cast(i as integer)) as lo,
  timestamp '1998-06-01' + to_days(cast(i as integer) + 1) as hi from range(8) r(i))
select tab, count(*) as n, count(*) filter (where start_time is null) as without_start, count(*) filter (where start_time < lo) as carried
from listings join tabs on (start_time >= lo and start_time < hi) or (tab = 0 and start_time < lo and start_time + interval 36 hour > lo) or (tab = 0 and start_time is null)
group by tab""")
def day_tab_counts(t: Tables) -> DataFrame:
    rows = feed.in_tabs(t.listings(), feed.day_tabs(t.spark, "1998-06-01"), F.col("start_time") + F.expr("interval 36 hours"))
    return rows.groupBy("tab").agg(
        F.count("*").alias("n"), F.count_if(F.col("start_time").isNull()).alias("without_start"), F.count_if(F.col("start_time") < F.col("lo")).alias("carried"))


@query(f"""with {LISTINGS_SQL}, {VENUES_SQL} select event_id, price from listings join venues using (venue_id)
where area in ('BUILDING', 'MACHINERY') and city in ('NATION_1', 'NATION_2', 'NATION_3') and price <= 100000""")
def filtered_feed(t: Tables) -> DataFrame:
    rows = t.listings().join(t.venues(), "venue_id")
    return feed.apply_filters(rows, ("BUILDING", "MACHINERY"), ("NATION_1", "NATION_2", "NATION_3"), 100000).select("event_id", "price")


@query(f"""with {LISTINGS_SQL}, {VENUES_SQL} select area as value, count(*) as n, min(event_id) as first_seen
from listings join venues using (venue_id) where area is not null and area <> '' group by area""")
def facet_area(t: Tables) -> DataFrame:
    return feed.facet(t.listings().join(t.venues(), "venue_id"), "area", "event_id")


@query(f"""with {LISTINGS_SQL}, {VENUES_SQL}, d(domain, pos) as (values ('AUTOMOBILE', 0), ('BUILDING', 1), ('FURNITURE', 2), ('HOUSEHOLD', 3), ('MACHINERY', 4))
select pos, domain, count(*) as n, round(min(price), 2) as cheapest from listings join venues using (venue_id) join d on area = domain group by pos, domain""")
def domain_groups(t: Tables) -> DataFrame:
    order = t.spark.createDataFrame([(n, i) for i, n in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))], "domain string, pos int")
    rows = t.listings().join(t.venues(), "venue_id").join(F.broadcast(order), F.col("area") == F.col("domain"))  # a fixed list
    return rows.groupBy("pos", "domain").agg(F.count("*").alias("n"), F.round(F.min("price"), 2).alias("cheapest"))


@query(f"""with {LISTINGS_SQL}, d as (select event_id, (epoch(start_time) - epoch(timestamp '1998-06-01')) / 86400.0 as days from listings)
select case when days <= 7 then 'rich' when days <= 30 then 'compact' else 'line' end as bucket, count(*) as n, sum(event_id) as ids from d group by 1""")
def date_buckets(t: Tables) -> DataFrame:
    bucket = feed.date_bucket(F.col("start_time"), "1998-06-01")
    return t.listings().groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""with h as (select event_id, case when event_id % 9 <> 0 then hour(ts) end as hour from events)
select case when hour is null or hour >= 17 then 'evening' else 'earlier' end as part, count(*) as n, count(hour) as known from h group by 1""")
def day_part_split(t: Tables) -> DataFrame:
    hour = F.when(F.col("event_id") % 9 != 0, F.hour("ts"))
    return t.events.select(hour.alias("hour")).groupBy(feed.day_part(F.col("hour")).alias("part")).agg(F.count("*").alias("n"), F.count("hour").alias("known"))


REGION_FIELDS_SQL = """
fields as (select venue_id, case when venue_id % 3 = 0 then null else county in ('AFRICA', 'AMERICA') end as by_county,
  case when venue_id % 4 = 0 then null else city in ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5', 'NATION_6') end as by_city from venues)"""


def _region(t: Tables) -> DataFrame:
    cities = [f"NATION_{i}" for i in range(7)]
    by_county = F.when(F.col("venue_id") % 3 != 0, F.col("county").isin("AFRICA", "AMERICA"))
    by_city = F.when(F.col("venue_id") % 4 != 0, F.col("city").isin(*cities))
    return t.venues().withColumn("inside", feed.tri_state(by_city, by_county))


@query(f"""with {VENUES_SQL}, {REGION_FIELDS_SQL}
select venue_id, case when by_city = false or by_county = false then false when by_city or by_county then true end as inside from fields""")
def region_verdict(t: Tables) -> DataFrame:
    """Known outside wins over inside; neither leaves the verdict unknown."""
    return _region(t).select("venue_id", "inside")


@query(f"""with {VENUES_SQL}, {REGION_FIELDS_SQL}, v as (select venue_id, case when by_city = false or by_county = false then false when by_city or by_county then true end as inside from fields)
select venue_id from v where inside is null or inside""")
def region_scope(t: Tables) -> DataFrame:
    """Only what is known to be outside is dropped."""
    return _region(t).where("inside is null or inside").select("venue_id")


@query(f"""with {VENUES_SQL}, {REGION_FIELDS_SQL}, v as (select county, case when by_city = false or by_county = false then false when by_city or by_county then true end as inside
  from fields join venues using (venue_id))
select county, count(*) filter (where inside) as inside, count(*) filter (where not inside) as outside, count(*) filter (where inside is null) as unknown from v group by county""")
def region_report(t: Tables) -> DataFrame:
    return _region(t).groupBy("county").agg(
        F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"), F.count_if(F.col("inside").isNull()).alias("unknown"))


@query(f"""with {LISTINGS_SQL}, {VENUES_SQL}, a as (select event_id, price, confidence, city, area, start_time,
  (case when price is not null then 1 else 0 end + case when start_time is not null then 1 else 0 end + case when city is not null then 1 else 0 end) as completeness
  from listings left join venues using (venue_id) where confidence in ('confirmed', 'likely') and status = 'scheduled')
select event_id, confidence, completeness from a
order by case confidence when 'confirmed' then 0 else 1 end, completeness desc, start_time nulls last, event_id limit 200""")
def featurable(t: Tables) -> DataFrame:
    rows = t.listings().where(F.col("confidence").isin("confirmed", "likely") & (F.col("status") == "scheduled")).join(t.venues(), "venue_id", "left")
    full = sum(F.col(c).isNotNull().cast("int") for c in ("price", "start_time", "city"))
    rows = rows.withColumn("completeness", full).orderBy(feed.confidence_rank(F.col("confidence")), F.desc("completeness"), F.asc_nulls_last("start_time"), "event_id")
    return rows.limit(200).select("event_id", "confidence", "completeness")


@query(f"""with {LISTINGS_SQL}, {VENUES_SQL}, s as (select * from listings where event_id % 2 = 0),
u as (select event_id, venue_id, price, 'a' as lane from s union all select event_id, venue_id, null, 'b' from listings where event_id % 2 = 1)
select lane, count(*) as n, count(price) as priced from u group by lane""")
def feed_union(t: Tables) -> DataFrame:
    """Two readers of one feed; the second lacks a column."""
    rows = t.listings()
    one = rows.where("event_id % 2 = 0").select("event_id", "venue_id", "price", F.lit("a").alias("lane"))
    two = rows.where("event_id % 2 = 1").select("event_id", "venue_id", F.lit("b").alias("lane"))
    return one.unionByName(two, allowMissingColumns=True).groupBy("lane").agg(F.count("*").alias("n"), F.count("price").alias("priced"))


@query(f"""with {LISTINGS_SQL}, n as (select event_id, venue_id, start_time, row_number() over (partition by venue_id order by event_id) as pos from listings),
a as (select venue_id, string_agg(cast(event_id as varchar), ', ' order by pos) filter (where pos <= 5) as names, count(*) as n from n group by venue_id)
select c_custkey as venue_id, coalesce(names, 'Live event') as title, coalesce(n, 0) as n from customer left join a on venue_id = c_custkey""")
def nested_names(t: Tables) -> DataFrame:
    """Each venue with a title of its first five events in order (a fixed one where there are none), and how many it has in all."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("venue_id").orderBy("event_id"))
    first = t.listings().withColumn("pos", nth).groupBy("venue_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos") <= 5, F.struct("pos", "event_id")))).alias("e"), F.count("*").alias("n"))
    names = F.array_join(F.transform("e", lambda x: x["event_id"].cast("string")), ", ")
    joined = t.customer.select(F.col("c_custkey").alias("venue_id")).join(first, "venue_id", "left")
    return joined.select("venue_id", F.coalesce(names, F.lit("Live event")).alias("title"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""with {LISTINGS_SQL}, f as (select event_id, price, start_time, confidence from listings where price <= 250000 and hour(start_time) >= 0)
select event_id, price from f where isodow(start_time) in (5, 6, 7) and start_time > timestamp '1998-06-01' and start_time < timestamp '1998-06-15'""")
def weekend_picks(t: Tables) -> DataFrame:
    """Strictly future, cheap, Friday to Sunday; a null price never passes the cap."""
    start = F.col("start_time")
    weekend = (F.weekday(start) + 1).isin(5, 6, 7)
    return t.listings().where((F.col("price") <= 250000) & weekend & (start > feed.at("1998-06-01")) & (start < feed.at("1998-06-15"))).select("event_id", "price")
