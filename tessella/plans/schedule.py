"""Crawl state, scheduling and trend queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import state
from ..operators.feed import at
from ..sources.tables import FETCHES_SQL, LISTINGS_SQL, Tables

STREAK_SQL = """
ok as (select source_id, max(fetched_at) filter (where not failed) as last_ok from fetches group by source_id),
streaks as (select source_id, count(*) filter (where failed and (last_ok is null or fetched_at > last_ok)) as fail_streak from fetches join ok using (source_id) group by source_id)"""
STATES_SQL = f"""{FETCHES_SQL}, {STREAK_SQL},
states as (select source_id, max(fetched_at) as last_attempt, max(fetched_at) filter (where not failed) as last_success, count(*) as attempts,
  count(*) filter (where not failed) as successes, any_value(fail_streak) as fail_streak from fetches join streaks using (source_id) group by source_id)"""
WAIT_SQL = "case when fail_streak <= 0 then 150 else cast(least(60 * pow(2, least(fail_streak, 30) - 1), 10080) as bigint) end"
NOW = "2024-02-01 00:00:00"


@query(f"with {FETCHES_SQL}, {STREAK_SQL} select source_id, fail_streak from streaks")
def fail_streak(t: Tables) -> DataFrame:
    return state.fail_streak(t.fetches())


@query(f"with {STATES_SQL} select source_id, epoch_us(last_attempt) as last_attempt_us, epoch_us(last_success) as last_success_us, attempts, successes, fail_streak from states")
def crawl_state(t: Tables) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return state.crawl_state(t.fetches()).select(
        "source_id", micros("last_attempt").alias("last_attempt_us"), micros("last_success").alias("last_success_us"), "attempts", "successes", "fail_streak")


@query(f"""with {STATES_SQL} select source_id, fail_streak, {WAIT_SQL} as wait_minutes,
date_diff('second', last_attempt, timestamp '{NOW}') // 60 >= {WAIT_SQL} as due from states""")
def backoff_due(t: Tables) -> DataFrame:
    wait = state.interval_minutes(F.col("fail_streak"))
    waited = F.floor(F.timestamp_diff("SECOND", F.date_trunc("second", "last_attempt").cast("timestamp_ntz"), at(NOW)) / 60)
    return state.crawl_state(t.fetches()).select("source_id", "fail_streak", wait.alias("wait_minutes"), (waited >= wait).alias("due"))


@query(f"""with {FETCHES_SQL} select source_id, fetch_id, outcome from (select *, row_number() over (partition by source_id order by fetched_at desc, fetch_id) as n
from fetches where not failed) where n = 1""")
def latest_fingerprint(t: Tables) -> DataFrame:
    """The latest successful read of each source."""
    ok = t.fetches().where("not failed")
    return state.latest_per_key(ok, ["source_id"], F.desc("fetched_at"), F.col("fetch_id")).select("source_id", "fetch_id", "outcome")


@query(f"""with {FETCHES_SQL}, c as (select source_id, outcome, count(*) as n, max(fetched_at) as last from fetches
where not failed and fetched_at > timestamp '{NOW}' - interval 30 day group by source_id, outcome)
select source_id, outcome, n from (select *, row_number() over (partition by source_id order by n desc, last desc, outcome) as k from c) where k = 1""")
def best_outcome(t: Tables) -> DataFrame:
    """The most frequent outcome of each source in 30 days."""
    rows = t.fetches().where(~F.col("failed") & (F.col("fetched_at") > at(NOW) - F.expr("interval 30 days")))
    counted = rows.groupBy("source_id", "outcome").agg(F.count("*").alias("n"), F.max("fetched_at").alias("last"))
    return state.latest_per_key(counted, ["source_id"], F.desc("n"), F.desc("last"), F.col("outcome")).select("source_id", "outcome", "n")


@query("""with k as (select *, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber, l_partkey, l_suppkey) as n,
first_value(l_partkey) over (partition by l_orderkey order by l_returnflag <> 'R', l_shipdate desc, l_linenumber, l_partkey, l_suppkey) as promoted from lineitem)
select l_orderkey, l_suppkey, promoted from k where n = 1""")
def latest_with_promoted(t: Tables) -> DataFrame:
    """The latest candidate of each key, with the part of its latest promoted one."""
    order = [F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey"]
    w = Window.partitionBy("l_orderkey")
    promoted = F.first("l_partkey").over(w.orderBy((F.col("l_returnflag") != "R"), *order))
    nth = F.row_number().over(w.orderBy(*order))
    return t.lineitem.withColumn("promoted", promoted).withColumn("n", nth).where("n = 1").select("l_orderkey", "l_suppkey", "promoted")


@query("""select l_orderkey, l_suppkey, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey) as n
from lineitem where l_returnflag = 'R') where n = 1""")
def distinct_on_first(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_returnflag = 'R'")
    return state.latest_per_key(rows, ["l_orderkey"], *map(F.col, ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"))).select("l_orderkey", "l_suppkey", "l_partkey")


@query(f"""with {LISTINGS_SQL}, h as (select event_id, venue_id, (epoch(start_time) - epoch(timestamp '1998-06-01')) / 3600.0 as hours_left,
  case when event_id % 4 <> 0 then (epoch(start_time) - epoch(timestamp '1998-06-01')) / 3600.0 + event_id % 800 end as at_last from listings),
r as (select *, case when hours_left < 0 then null when hours_left <= 6 and (at_last is null or at_last > 6) then 6 when hours_left <= 24 and (at_last is null or at_last > 24) then 24
  when hours_left <= 72 and (at_last is null or at_last > 72) then 72 when hours_left <= 168 and (at_last is null or at_last > 168) then 168
  when hours_left <= 336 and (at_last is null or at_last > 336) then 336 when hours_left <= 720 and (at_last is null or at_last > 720) then 720 end as rung from h)
select venue_id, min(rung) as rung, count(*) as n, max(720 - hours_left) as overdue from r where rung is not null group by venue_id""")
def refresh_plan(t: Tables) -> DataFrame:
    """Per venue page: its nearest refresh rung, how many listings ask for it, and the longest overdue."""
    left = F.timestamp_diff("SECOND", at("1998-06-01"), F.col("start_time")) / 3600.0
    rows = t.listings().select("event_id", "venue_id", left.alias("hours_left"), F.when(F.col("event_id") % 4 != 0, left + F.col("event_id") % 800).alias("at_last"))
    rung = rows.withColumn("rung", state.crossed_rung(F.col("hours_left"), F.col("at_last"))).where("rung is not null")
    return rung.groupBy("venue_id").agg(F.min("rung").alias("rung"), F.count("*").alias("n"), F.max(720 - F.col("hours_left")).alias("overdue"))


@query("""with p as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) as depth from lineitem)
select l_suppkey, l_orderkey, depth from p order by depth, l_suppkey limit 120""")
def round_robin_budget(t: Tables) -> DataFrame:
    """One candidate of each source in turn until the budget of 120 is used."""
    return state.round_robin(t.lineitem, "l_suppkey", 120, "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").select("l_suppkey", "l_orderkey", "depth")


@query("""with p as (select *, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) as nth_of_host from lineitem)
select l_orderkey, l_suppkey, nth_of_host from p where nth_of_host <= 4 order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 120""")
def budget_prefix(t: Tables) -> DataFrame:
    """At most four fetches a host, then the first 120 of what is left."""
    return state.host_budget(t.lineitem, "l_suppkey", 4, 120, "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_suppkey", "nth_of_host")


@query(f"""with {STATES_SQL}, d as (select source_id, date_diff('minute', last_attempt, timestamp '{NOW}') as waited, fail_streak from states)
select source_id, row_number() over (order by last_attempt, source_id) as place from states""")
def rotation_order(t: Tables) -> DataFrame:
    """Least recently attempted first: one row a source, so the single ordering is over the sources only."""
    last = t.fetches().groupBy("source_id").agg(F.max("fetched_at").alias("last"))
    return last.select("source_id", F.row_number().over(Window.orderBy(F.asc_nulls_first("last"), "source_id")).cast("bigint").alias("place"))


@query("""with e as (select user_id, event_id, ts, value, avg(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding) as base,
  lag(value) over (partition by user_id order by ts, event_id) as prev, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as best from events)
select event_id, cast(floor(base) as bigint) as baseline_cents, case when prev is null then '-' when value > prev + 0.0001 then 'up' when value < prev - 0.0001 then 'down' else 'flat' end as trend,
coalesce(value + 1e-9 < best, false) as regressed from e""")
def metric_trends(t: Tables) -> DataFrame:
    """Each observation against the mean of the ten before it, the one before it, and the best so far."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = t.events.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return cents.select(
        "event_id", F.floor(state.rolling_baseline(w, "cents")).alias("baseline_cents"), state.trend(F.col("value"), F.lag("value").over(w)).alias("trend"),
        state.ratchet(w, "value").alias("regressed"),
    )


@query("""with e as (select user_id, cast(round(value * 100) as bigint) as value, row_number() over (partition by user_id order by event_id) as i, count(*) over (partition by user_id) as n from events),
m as (select user_id, max(n) as n, avg(value) filter (where i <= n // 2) as a, avg(value) filter (where i > n // 2) as b from e group by user_id)
select user_id, n, cast(floor(a) as bigint) as first_cents, cast(floor(b) as bigint) as second_cents, case when n < 4 then null when b > a then 'up' when b < a then 'down' else 'flat' end as direction from m""")
def half_split_trend(t: Tables) -> DataFrame:
    cents = t.events.withColumn("value", F.round(F.col("value") * 100).cast("bigint"))
    out = state.half_split(cents, "user_id", "event_id", "value")
    return out.select("user_id", "n", F.floor("first_mean").alias("first_cents"), F.floor("second_mean").alias("second_cents"), "direction")


@query("""with d as (select user_id, list(case when event_type = 'error' then -0.1 else 0.05 end order by ts, event_id) as deltas from events group by user_id)
select user_id, round(list_reduce(list_prepend(cast(0.5 as double), deltas), lambda a, d: greatest(0.0, least(1.0, a + d))), 4) as reliability from d""")
def source_reliability(t: Tables) -> DataFrame:
    """A score moved by each outcome in turn and kept within 0 and 1."""
    delta = F.when(F.col("event_type") == "error", -0.1).otherwise(0.05)
    scores = state.clamped_scores(t.events.withColumn("delta", delta), "user_id", ["ts", "event_id"], "delta")
    return scores.select("user_id", F.round("score", 4).alias("reliability"))


@query("""with r as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events),
l as (select user_id, median(value) as m, list(value order by n desc) as v from r where n <= 20 group by user_id)
select user_id, round(m, 4) as median_yield, round(list_reduce(v, lambda a, x: a * 0.7 + x * 0.3), 4) as smoothed from l""")
def yield_profile(t: Tables) -> DataFrame:
    """Median and smoothed mean of the last 20 observations of each source."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = t.events.withColumn("n", nth).where("n <= 20").groupBy("user_id").agg(
        F.median("value").alias("m"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value"))).alias("s"))
    return rows.select("user_id", F.round("m", 4).alias("median_yield"), F.round(state.smoothed(F.transform("s", lambda x: x["value"])), 4).alias("smoothed"))


@query("""with w as (select user_id, date_trunc('week', ts) as week, count(*) filter (where event_type = 'purchase') as n from events group by 1, 2),
a as (select user_id, avg(n) as mean from w group by user_id)
select user_id, round(mean, 4) as weekly, case when mean >= 4 then 'daily' when mean >= 3 then 'weekly' when mean >= 1 then 'monthly' else 'none' end as tier from a""")
def portfolio_tiers(t: Tables) -> DataFrame:
    """Publication tier of each source by its mean weekly count."""
    weekly = t.events.groupBy("user_id", F.date_trunc("week", "ts").alias("week")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    tier = F.when(F.col("mean") >= 4, "daily").when(F.col("mean") >= 3, "weekly").when(F.col("mean") >= 1, "monthly").otherwise("none")
    return weekly.groupBy("user_id").agg(F.avg("n").alias("mean")).select("user_id", F.round("mean", 4).alias("weekly"), tier.alias("tier"))
