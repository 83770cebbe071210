"""What is written: candidates, promotion, fills and ledgers, as tables that a sink appends or merges; and the streaming crawl state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import merge, promote, trust
from ..sources.tables import FETCHES_SQL, Tables
from ..sources.staging import shared_dir
from ..sources.versions import Versions
from ..streaming import crawl, learning

def order_key() -> Column:
    return F.col("o_orderkey")


def line_order() -> Column:
    return F.col("l_orderkey")


@query("""select event_id, user_id as source_id, cast(json_extract(props, '$.k') as bigint) as k, 'needs_review' as status, sha1(user_id || '|' || event_type) as identity from events where event_type <> 'error'""")
def candidate_rows(t: Tables) -> DataFrame:
    """Candidates as they are appended: the extraction's fields as columns, waiting for review, with an identity."""
    return t.events.where("event_type <> 'error'").select(
        "event_id", F.col("user_id").alias("source_id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.lit("needs_review").alias("status"), F.sha1(F.concat_ws("|", "user_id", "event_type")).alias("identity"))


@query("""select l_suppkey as source_id, l_orderkey as candidate_id, count(*) as n, max(l_linenumber) as last_line from lineitem group by 1, 2""")
def evidence_rows(t: Tables) -> DataFrame:
    """Evidence appended to each candidate by source."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("source_id"), line_order().alias("candidate_id")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last_line"))


PROMOTE_SQL = """c as (select o_orderkey as id, o_custkey as venue, o_orderpriority as title, date_trunc('month', o_orderdate) as start, o_orderkey % 5 > 0 as ready from orders),
stored as (select id, venue, title, start from c where id % 4 = 0), fresh as (select * from c where id % 4 > 0),
d as (select f.*, (select min(s.id) from stored s where s.venue = f.venue and s.title = f.title and s.start = f.start) as twin, min(case when f.ready then f.id end) over (partition by f.venue, f.title, f.start) as first_id from fresh f),
r as (select *, case when not ready then 'held' when twin is not null then 'duplicate' when id <> first_id then 'duplicate' else 'promoted' end as outcome, coalesce(twin, first_id) as event_id from d)"""


@query(f"""with {PROMOTE_SQL} select 'event' as output, id as key, event_id as ref, outcome as note from r where outcome = 'promoted' union all select 'candidate', id, case when outcome = 'held' then null else event_id end, outcome from r
union all select 'audit', id, null, 'promote:' || outcome from r""")
def promotions(t: Tables) -> DataFrame:
    """Gate, duplicate probe and insert of a batch of candidates: the events, the marked candidates and the audit, which a sink writes together."""
    rows = t.orders.select(order_key().alias("id"), F.col("o_custkey").alias("venue"), F.col("o_orderpriority").alias("title"), F.date_trunc("month", "o_orderdate").alias("start"), (order_key() % 5 > 0).alias("ready"))
    out = promote.promote(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"))
    part = lambda name, df, ref, note: df.select(F.lit(name).alias("output"), F.col("id").alias("key"), ref.cast("bigint").alias("ref"), note.alias("note"))
    held = F.when(F.col("outcome") != "held", F.col("event_id"))
    return part("event", out.where("outcome = 'promoted'"), F.col("event_id"), F.col("outcome")).unionByName(part("candidate", out, held, F.col("outcome"))).unionByName(
        part("audit", out, F.lit(None), F.concat(F.lit("promote:"), "outcome")))


TWIN_SQL = """e as (select o_orderkey as id, lower(trim(o_orderpriority)) as title, o_custkey % 20 as market, cast(o_orderdate as date) as day, o_orderdate + to_hours(cast(o_orderkey % 8 as integer)) as start, case when o_orderkey % 3 > 0 then o_custkey end as venue from orders)"""


@query(f"""with {TWIN_SQL}, p as (select a.id, min(b.venue) as filled, bool_or((a.venue is null and a.id > b.id) or (a.id > b.id and abs(date_diff('second', a.start, b.start)) between 14400 and 21600)) as ghost
from e a join e b on a.title = b.title and a.day = b.day and a.market = b.market and a.id <> b.id group by a.id)
select e.id, coalesce(e.venue, p.filled) as venue, coalesce(p.ghost, false) as cancelled from e left join p on p.id = e.id""")
def filled_rows(t: Tables) -> DataFrame:
    """Twins of one title and local day: a missing venue is filled from the twin, a later twin without a venue or four to six hours off is cancelled."""
    rows = t.orders.select(
        order_key().alias("id"), F.lower(F.trim("o_orderpriority")).alias("title"), (F.col("o_custkey") % 20).alias("market"), F.to_date("o_orderdate").alias("day"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(order_key() % 8).cast("int"))).alias("start"), F.when(order_key() % 3 > 0, F.col("o_custkey")).alias("venue"))
    return promote.fill_twins(rows, ["title", "day", "market"])


@query("""with c as (select l_orderkey, min(l_suppkey) as supp from lineitem where l_returnflag = 'R' group by 1), s as (select s_suppkey, lower(s_name) as name from supplier)
select o_orderkey, case when o_orderkey % 3 = 0 then 'kept' else s.name end as source from orders left join c on l_orderkey = o_orderkey left join s on s_suppkey = supp""")
def provenance_backfill(t: Tables) -> DataFrame:
    """Events get the source of their candidate where they have none; of several candidates the least source."""
    c = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supp"))
    s = t.supplier.select("s_suppkey", F.lower("s_name").alias("name"))
    rows = t.orders.select("o_orderkey", F.when(order_key() % 3 == 0, "kept").alias("source")).join(c, order_key() == line_order(), "left").join(s, F.col("supp") == F.col("s_suppkey"), "left")
    return rows.select("o_orderkey", F.coalesce("source", "name").alias("source"))


@query("""select event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then 'https://v.example/' || event_id else 'https://x.example/' || event_id end as url, case when event_id % 2 = 0 then '512-555-' || lpad(cast(event_id % 10000 as varchar), 4, '0') end as phone from events""")
def rederived_contacts(t: Tables) -> DataFrame:
    """Contact columns worked out again from the stored raw record, by the importer's own paths."""
    k, text = F.col("event_id"), F.col("event_id").cast("string")
    link = F.when(k % 3 == 1, F.concat(F.lit(', "venue": {"url": "https://v.example/'), text, F.lit('"}'))).when(k % 3 == 2, F.concat(F.lit(', "url": "https://x.example/'), text, F.lit('"'))).otherwise("")
    phone = F.when(k % 2 == 0, F.concat(F.lit(', "venue_phone": "512-555-'), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit('"'))).otherwise("")
    raw = F.try_parse_json(F.concat(F.lit('{"id": '), text, link, phone, F.lit("}")))
    url = F.coalesce(F.try_variant_get(raw, "$.venue.url", "string"), F.try_variant_get(raw, "$.url", "string"))
    return t.events.select("event_id", url.alias("url"), F.try_variant_get(raw, "$.venue_phone", "string").alias("phone"))


@query("""select o_orderkey, case when c.c_custkey is not null then 'known' else 'dropped' end as venue from (select o_orderkey, case when o_orderkey % 9 = 0 then -1 else o_custkey end as v from orders) o left join customer c on c_custkey = v""")
def checked_venues(t: Tables) -> DataFrame:
    """A venue is written only where it exists."""
    rows = t.orders.select("o_orderkey", F.when(order_key() % 9 == 0, -1).otherwise(F.col("o_custkey")).alias("v"))
    found = rows.join(t.customer.select(F.col("c_custkey").alias("v"), F.lit(True).alias("there")), "v", "left")
    return found.select("o_orderkey", F.when(F.col("there"), "known").otherwise("dropped").alias("venue"))


@query("""with e as (select event_id as seq, user_id as key, event_type as type, event_id % 4 = 0 as fixes, ts, lag(ts) over w as before, lag(event_type) over w as before_type from events window w as (partition by user_id order by event_id))
select rule, count(*) as n from (select unnest(list_filter([case when fixes and before_type is distinct from type then 'type_changed' end, case when before is not null and ts < before then 'horizon_back' end,
  case when before is null and type = 'error' then 'lifecycle_before_claim' end], lambda x: x is not null)) as rule from e) group by rule""")
def ledger_violations(t: Tables) -> DataFrame:
    """Entries that a ledger refuses, by rule."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t.events.select("event_id", "event_type", "ts", F.lag("ts").over(w).alias("before"), F.lag("event_type").over(w).alias("before_type"))
    rules = [
        F.when((F.col("event_id") % 4 == 0) & ~F.col("before_type").eqNullSafe(F.col("event_type")), "type_changed"), F.when(F.col("ts") < F.col("before"), "horizon_back"),
        F.when(F.col("before").isNull() & (F.col("event_type") == "error"), "lifecycle_before_claim")]
    return rows.select(F.explode(F.array_compact(F.array(*rules))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("""with b as (select l_orderkey, min(l_shipdate) as since, count(distinct l_returnflag) as n, bool_or(l_linestatus = 'F') as stamped from lineitem group by 1)
select l_orderkey, case when n >= 2 then 'pass' else 'hold' end as decision from b where not stamped order by since, l_orderkey limit 100""")
def backlog_sweep(t: Tables) -> DataFrame:
    """The oldest hundred candidates that were never stamped, through the gate."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("since"), F.collect_set("l_returnflag").alias("c"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("stamped"))
    ready = trust.gate(F.col("c"), ["none"]) == "ready"
    return rows.where("stamped = 0").orderBy("since", "l_orderkey").limit(100).select("l_orderkey", F.when(ready, "pass").otherwise("hold").alias("decision"))


@query("""with r as (select page_id, page_id % 5 as m from pages), s as (select page_id, case when m = 0 then 403 when m = 1 then 404 else 200 end as status, case when page_id % 3 = 0 then 'd1' end as night, case when m = 2 then 'd1' when m = 3 then 'd2' end as stated, case when m = 4 then 'hall' end as place from r)
select page_id, case when status <> 200 then night when night is null then stated when stated is null or stated = night then night end as night, case when status = 200 then place end as place,
  case when status = 403 then 'wall' when status <> 200 then 'unread' when night is not null and stated is not null and stated <> night then 'contested' when night is null and stated is not null then 'filled' else 'as_is' end as verdict from s""")
def page_hole_fills(t: Tables) -> DataFrame:
    """A row's own page fills its missing night and place; a night that both state differently becomes a hole, a wall or an error leaves the row as it is."""
    k = F.col("page_id")
    m = k % 5
    rows = t.pages.select(
        "page_id", F.when(m == 0, 403).when(m == 1, 404).otherwise(200).alias("status"), F.when(k % 3 == 0, "d1").alias("night"), F.lit(None).cast("string").alias("place"),
        F.when(m == 2, "d1").when(m == 3, "d2").alias("stated_night"), F.when(m == 4, "hall").alias("stated_place"))
    return promote.fill_from_page(rows).select("page_id", "night", "place", "verdict")


INGEST_SQL = """p as (select o_orderkey as k, o_orderkey % 7 as m, o_orderkey % 10 = 0 as held from orders),
s as (select k, case when m < 4 then 'x' end as seen, m in (0, 1, 2) as published, case when m = 1 then 'contradicts' when m = 2 then 'fills' else 'same' end as drift, held from p)"""


@query(f"""with {INGEST_SQL} select action, count(*) as n, min(k) as first_key from (select k, case when seen is not null and published then case drift when 'same' then 'skip' when 'contradicts' then 'dispute' else 'fill' end
  when seen is not null and drift = 'same' then 'reuse' when held then 'hold' else 'publish' end as action from s) group by action""")
def desk_ingest(t: Tables) -> DataFrame:
    """What becomes of each planned row: skip, fill, dispute, reuse, hold or publish."""
    m = order_key() % 7
    rows = t.orders.select(order_key(), F.when(m < 4, "x").alias("seen"), m.isin(0, 1, 2).alias("published"), F.when(m == 1, "contradicts").when(m == 2, "fills").otherwise("same").alias("drift"), (order_key() % 10 == 0).alias("held"))
    action = promote.ingest_action(F.col("seen").isNotNull(), F.col("published"), F.col("drift"), F.col("held"))
    return rows.groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query(f"""with {FETCHES_SQL} select strftime(date_trunc('hour', fetched_at), '%Y-%m-%d %H') as hour, count(*) as n, count(*) filter (where failed) as failures from fetches group by 1""")
def streamed_hours(t: Tables) -> DataFrame:
    """Attempts and failures by the hour, from a stream."""
    out = crawl.drained(crawl.windowed_counts(crawl.attempts(t.spark, f"{t.sf_dir}/events.parquet")), "complete")
    last = F.max("batch").over(Window.partitionBy("hour"))
    return out.withColumn("last", last).where("batch = last").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", "failures")


@query(f"""with {FETCHES_SQL}, l as (select source_id, max(fetched_at) filter (where not failed) as ok, count(*) as n from fetches group by 1)
select l.source_id, any_value(l.n) as n, count(f.fetch_id) as fail_streak from l left join fetches f on f.source_id = l.source_id and f.failed and (l.ok is null or f.fetched_at > l.ok) group by l.source_id""")
def streamed_fail_streaks(t: Tables) -> DataFrame:
    """Failures of each source since its last success, kept as state over a stream."""
    out = crawl.drained(crawl.fail_streaks(crawl.attempts(t.spark, f"{t.sf_dir}/events.parquet")), "update")
    return out.groupBy("source_id").agg(F.max_by(F.struct("n", "fail_streak"), "batch").alias("s")).select("source_id", "s.n", "s.fail_streak")


def _promoted(tables: dict, rows: DataFrame) -> dict:
    """One batch of candidates: each becomes an event or moves the one of its key, its status is kept, and every decision is logged."""
    fresh = rows.select("key", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), "place")
    events = merge.upsert_seen(tables["events"], fresh, ["key"], "first_seen", "last_seen") if "events" in tables else merge.upsert_seen(fresh.limit(0), fresh, ["key"], "first_seen", "last_seen")
    status = rows.select("candidate", F.when(F.col("fit"), "promoted").otherwise("held").alias("status"))
    log = rows.select("candidate", "key", F.when(F.col("fit"), "promoted").otherwise("held").alias("action"), "seen")
    add = lambda name, new: new if name not in tables else tables[name].unionByName(new)
    return {"events": events, "candidates": add("candidates", status), "audit": add("audit", log)}


def _versions(t: Tables) -> Versions:
    """Three batches of candidates from the line items, the second of them twice, as versions of three tables."""
    line = line_order()
    rows = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("key"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("seen"),
        F.concat_ws(" ", F.lit("hall"), F.date_format("l_shipdate", "yyyyMMdd")).alias("place"), (F.col("l_suppkey") % 2 == 0).alias("fit"), (line % 3).alias("batch"))
    versions = Versions(t.spark, shared_dir(t.spark))
    write = versions.sink(_promoted, "candidates")
    for batch in (0, 1, 1, 2):
        write(rows.where(F.col("batch") == batch).drop("batch"), batch)
    return versions


@query("""select 'e' || l_partkey as key, strftime(min(l_shipdate), '%Y-%m-%d') as first_seen, strftime(max(l_shipdate), '%Y-%m-%d') as last_seen, 'hall ' || strftime(max(l_shipdate), '%Y%m%d') as place from lineitem group by l_partkey""")
def versioned_events(t: Tables) -> DataFrame:
    """Events upserted batch by batch: the first sighting stays, the last one and its place move."""
    return _versions(t).table("events")


@query("""select case when l_suppkey % 2 = 0 then 'promoted' else 'held' end as status, count(*) as candidates, count(*) as decisions, 3 as version from lineitem group by 1""")
def versioned_promotion(t: Tables) -> DataFrame:
    """Candidates and their log as of the last version: a batch that runs twice counts once in each table."""
    versions = _versions(t)
    log = versions.table("audit").groupBy(F.col("action").alias("status")).agg(F.count("*").alias("decisions"))
    kept = versions.table("candidates").groupBy("status").agg(F.count("*").alias("candidates"))
    return kept.join(log, "status").withColumn("version", F.lit(versions.number()))


@query("""with o as (select user_id as source_id, ts, event_id, event_id % 4 as found, event_type <> 'error' as ok, event_type from events),
l as (select source_id, list(struct_pack(good := ok and found > 0, found := found) order by ts, event_id) as x from o group by 1)
select source_id, len(x) as attempts, len(list_filter(x, lambda r: r.good)) as successes, x[-1].found as last_yield, list_median(list_transform(x[-20:], lambda r: r.found)) as median_yield,
  list_reduce(list_transform(x, lambda r: cast(r.good as int) * 1.0::double), lambda a, b: format('{:.6f}', 0.7 * a + 0.3 * b)::double, 0.5::double) as reliability,
  list_reduce(list_transform(x, lambda r: cast(r.good as int) * 1.0::double), lambda a, b: format('{:.6f}', case when b > 0 then least(1.0, a + 0.05) else greatest(0.0, a - 0.1) end::double)::double, 0.5::double) as confidence,
  len(x) - coalesce(list_max(list_transform(range(1, len(x) + 1), lambda i: case when x[i].good then i else 0 end)), 0) >= 2 as rediscover from l""")
def outcome_learning(t: Tables) -> DataFrame:
    """What every source's outcomes have taught so far, kept as state over a stream."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(store)
    t.spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = crawl.attempts(t.spark, f"{t.sf_dir}/events.parquet")
        outcomes = rows.select("source_id", F.col("fetched_at").alias("at"), F.col("fetch_id").alias("outcome_id"), (F.col("fetch_id") % 4).alias("found"), (~F.col("failed")).alias("success"), F.when(F.col("failed"), "plain").otherwise("feed").alias("technique"))
        out = crawl.drained(learning.outcome_learning(outcomes), "update")
    finally:
        t.spark.conf.set(store, before)
    last = out.groupBy("source_id").agg(F.max_by(F.struct("attempts", "successes", "last_yield", "median_yield", "reliability", "confidence", "rediscover"), F.struct("attempts", "batch")).alias("r"))
    return last.select("source_id", "r.*")
