"""Aggregation, trust and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import trust
from ..sources.tables import LISTINGS_SQL, Tables


@query("""select l_suppkey, count(*) as n, count(*) filter (where l_returnflag = 'R') as returned, count(distinct l_partkey) as parts, count(distinct case when l_linestatus = 'O' then l_partkey end) as open_parts,
strftime(min(l_shipdate), '%Y-%m-%d') as first_day, strftime(max(l_shipdate), '%Y-%m-%d') as last_day from lineitem group by l_suppkey""")
def provider_breadth(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("open_parts"), day(F.min("l_shipdate")).alias("first_day"), day(F.max("l_shipdate")).alias("last_day"),
    )


@query("select coalesce(nullif(p_type, 'PROMO'), '(none)') as label, count(*) as n from part group by 1")
def category_histogram(t: Tables) -> DataFrame:
    return t.part.groupBy(F.coalesce(F.nullif("p_type", F.lit("PROMO")), F.lit("(none)")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""with {LISTINGS_SQL}, w(name, lo, hi) as (values ('today', timestamp '1998-06-01', timestamp '1998-06-02'), ('weekend', timestamp '1998-06-05', timestamp '1998-06-08'), ('week', timestamp '1998-06-01', timestamp '1998-06-08')),
a as (select name, count(*) as n from w join listings on start_time >= lo and start_time < hi group by name), b as (select name, count(*) as n from w join lineitem on l_shipdate >= lo and l_shipdate < hi group by name)
select w.name, coalesce(a.n, 0) as listings, coalesce(b.n, 0) as candidates, round(b.n * 1.0 / nullif(a.n, 0), 2) as ratio from w left join a using (name) left join b using (name)""")
def window_ratio(t: Tables) -> DataFrame:
    """Candidates per listing in three calendar windows; no listing, no ratio."""
    bounds = [("today", "1998-06-01", "1998-06-02"), ("weekend", "1998-06-05", "1998-06-08"), ("week", "1998-06-01", "1998-06-08")]
    windows = t.spark.createDataFrame(bounds, "name string, lo string, hi string").select("name", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi"))

    def counted(rows: DataFrame, at: str, name: str) -> DataFrame:
        inside = (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))
        return rows.where((F.col(at) >= F.lit("1998-06-01").cast("timestamp_ntz")) & (F.col(at) < F.lit("1998-06-08").cast("timestamp_ntz"))).join(F.broadcast(windows), inside).groupBy("name").agg(F.count("*").alias(name))

    a = counted(t.listings(), "start_time", "listings")
    b = counted(t.lineitem.withColumn("at", F.col("l_shipdate").cast("timestamp_ntz")), "at", "candidates")
    joined = windows.select("name").join(a, "name", "left").join(b, "name", "left")
    ratio = F.round(F.col("candidates") / F.nullif(F.col("listings"), F.lit(0)), 2)
    return joined.select("name", F.coalesce("listings", F.lit(0)).alias("listings"), F.coalesce("candidates", F.lit(0)).alias("candidates"), ratio.alias("ratio"))


@query("""select event_type, sum(case when json_type(props, '$.k') in ('UBIGINT', 'BIGINT') then cast(json_extract(props, '$.k') as bigint) end) as k_sum, count(*) filter (where json_type(props, '$.k') is null) as missing
from events group by event_type""")
def json_guarded_sum(t: Tables) -> DataFrame:
    """A field of a JSON column summed only where it is a number."""
    v = F.try_parse_json("props")
    k = F.when(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")) == "BIGINT", F.try_variant_get(v, "$.k", "bigint"))
    return t.events.select("event_type", k.alias("k"), F.try_variant_get(v, "$.k", "variant").isNull().alias("none")).groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count_if("none").alias("missing"))


GATE_SQL = """g as (select l_orderkey, list_sort(list(distinct l_returnflag || l_linestatus)) as classes, count(distinct l_shipdate) as instants from lineitem group by l_orderkey)"""


@query(f"""with {GATE_SQL} select l_orderkey, case when list_contains(classes, 'RO') or len(classes) >= 2 then 'ready' else 'needs ' || (2 - len(classes)) end as gate,
case when list_contains(classes, 'RO') or len(classes) >= 2 then 'confirmed' else 'unverified' end as confidence, instants > 1 as contested from g""")
def multi_confirm_gate(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("classes"), F.count_distinct("l_shipdate").alias("instants"))
    return rows.select("l_orderkey", trust.gate(F.col("classes"), ["RO"]).alias("gate"), trust.derived_confidence(F.col("classes"), ["RO"]).alias("confidence"), (F.col("instants") > 1).alias("contested"))


@query("""with e as (select l_orderkey, count(*) filter (where l_returnflag <> 'R') as r, count(*) filter (where l_returnflag = 'R') as s from lineitem group by l_orderkey),
o as (select l_orderkey, r / (r + s + 2) as b, s / (r + s + 2) as d, 2 / (r + s + 2) as u from e)
select l_orderkey, round(b + 0.5 * u, 6) as expectation, round(u, 6) as uncertainty, case when d >= 0.35 and b >= 0.35 then 'disputed' when b + 0.5 * u >= 0.7 then case when u < 0.5 then 'confirmed' else 'unverified' end
  when u >= 0.5 then 'unverified' when b + 0.5 * u >= 0.5 then 'likely' else 'unverified' end as state from o""")
def opinion_fusion(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", (F.col("l_returnflag") != "R").cast("int").alias("pro"), (F.col("l_returnflag") == "R").cast("int").alias("con"))
    o = F.col("opinion")
    return trust.fused(rows, "l_orderkey", "pro", "con").select(
        "l_orderkey", F.round(trust.expectation(o), 6).alias("expectation"), F.round(o["u"], 6).alias("uncertainty"), trust.four_state(o, dispute=0.35, confirm=0.7, uncertain=0.5).alias("state"))


@query("""with e as (select l_suppkey, count(*) filter (where l_returnflag <> 'R') as r, count(*) filter (where l_returnflag = 'R') as s from lineitem group by l_suppkey),
o as (select l_suppkey, 0.8 * r / (r + s + 2) as b, 0.8 * s / (r + s + 2) as d from e) select l_suppkey, round(b, 6) as b, round(d, 6) as d, round(1 - b - d, 6) as u from o""")
def trust_discount(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", (F.col("l_returnflag") != "R").cast("int").alias("pro"), (F.col("l_returnflag") == "R").cast("int").alias("con"))
    seen = trust.fused(rows, "l_suppkey", "pro", "con").select("l_suppkey", trust.discounted(F.col("opinion"), F.lit(0.8)).alias("o"))
    return seen.select("l_suppkey", *(F.round(f"o.{c}", 6).alias(c) for c in "bdu"))


COSTS = [("publish", 0, "right", 0.0), ("publish", 0, "partial", 4.0), ("publish", 0, "wrong", 20.0), ("hold", 1, "right", 3.0), ("hold", 1, "partial", 2.0), ("hold", 1, "wrong", 1.0), ("fetch", 2, "right", 1.5), ("fetch", 2, "partial", 1.5), ("fetch", 2, "wrong", 2.5)]
COSTS_SQL = "costs(action, pos, mode, loss) as (values " + ", ".join(f"('{a}', {p}, '{m}', {x})" for a, p, m, x in COSTS) + ")"


@query(f"""with {COSTS_SQL}, c as (select l_suppkey, l_returnflag, count(*) as n, sum(count(*)) over (partition by l_suppkey) as total from lineitem group by 1, 2),
p as (select l_suppkey, case l_returnflag when 'N' then 'right' when 'A' then 'partial' else 'wrong' end as mode, n / total as p from c),
x as (select l_suppkey, action, pos, round(sum(p * loss), 9) as loss from p join costs using (mode) group by 1, 2, 3)
select l_suppkey, action, round(loss, 6) as loss from (select *, row_number() over (partition by l_suppkey order by loss, pos) as k from x) where k = 1""")
def expected_loss(t: Tables) -> DataFrame:
    """The action of least expected loss of each source."""
    from pyspark.sql import Window

    mode = F.when(F.col("l_returnflag") == "N", "right").when(F.col("l_returnflag") == "A", "partial").otherwise("wrong")
    counted = t.lineitem.groupBy("l_suppkey", mode.alias("mode")).agg(F.count("*").alias("n"))
    shares = counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey")))
    costs = t.spark.createDataFrame(COSTS, "action string, pos int, mode string, loss double")
    return trust.decide(shares, costs, "l_suppkey").select("l_suppkey", "action", F.round("loss", 6).alias("loss"))


@query("""select s_suppkey, case when s_suppkey % 29 = 0 then 'hold' when s_suppkey % 5 = 0 then 'not_ratified' when s_suppkey % 7 = 0 then 'human' when s_acctbal / 10000 < 0.35 then 'human' when s_suppkey % 2 = 0 then 'publish' else 'hold' end as decision from supplier""")
def publish_decisions(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    gate = F.when(k % 7 == 0, "escalate").when(k % 2 == 0, "pass").otherwise("hold")
    return t.supplier.select("s_suppkey", trust.publish_decision(k % 29 == 0, k % 5 != 0, gate, F.col("s_acctbal") / 10000).alias("decision"))


@query("""select s_suppkey, round(100 * (0.5 * s_acctbal / 10000 + 0.3 * (s_suppkey % 10) / 10 + 0.2 * (s_nationkey % 5) / 5), 6) as priority from supplier""")
def priority_score(t: Tables) -> DataFrame:
    """Weighted source priority."""
    score = 100 * (0.5 * F.col("s_acctbal") / 10000 + 0.3 * (F.col("s_suppkey") % 10) / 10 + 0.2 * (F.col("s_nationkey") % 5) / 5)
    return t.supplier.select("s_suppkey", F.round(score, 6).alias("priority"))


@query("""with d as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as age, event_type = 'purchase' as win from events)
select user_id, round(1 + sum(case when win then pow(0.9, age - 1) else 0 end), 6) as alpha, round(1 + sum(case when win then 0 else pow(0.9, age - 1) end), 6) as beta from d group by user_id""")
def beta_posteriors(t: Tables) -> DataFrame:
    """Success and failure weights of each arm, older outcomes decayed by 0.9 each."""
    from pyspark.sql import Window

    age = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = t.events.select("user_id", F.pow(F.lit(0.9), age - 1).alias("w"), (F.col("event_type") == "purchase").alias("win"))
    return rows.groupBy("user_id").agg(
        F.round(1 + F.sum(F.when(F.col("win"), F.col("w")).otherwise(0.0)), 6).alias("alpha"), F.round(1 + F.sum(F.when(F.col("win"), 0.0).otherwise(F.col("w"))), 6).alias("beta"))


@query("""with r as (select conv_id, role, min(turn) as first_turn, count(*) as n, count(distinct text) as texts from conversations group by 1, 2)
select role, count(*) as conversations, sum(n) as turns, sum(n - texts) as repeats, max(first_turn) as latest_start from r group by role""")
def role_scorecard(t: Tables) -> DataFrame:
    """Per role: in how many conversations, how many turns, how many said again."""
    rows = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"), F.count_distinct("text").alias("texts"))
    return rows.groupBy("role").agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), F.sum(F.col("n") - F.col("texts")).alias("repeats"), F.max("first_turn").alias("latest_start"))
