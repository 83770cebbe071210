"""Graph, as-of and merge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph, merge
from ..sources.tables import Tables

EDGES_SQL = """edges as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation
union all select 's' || s_suppkey, 'n' || s_nationkey from supplier)"""


def _edges(t: Tables) -> DataFrame:
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return t.nation.select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst")).unionByName(
        t.supplier.select(tag("s", "s_suppkey").alias("src"), tag("n", "s_nationkey").alias("dst")))


@query(f"""with recursive {EDGES_SQL}, both_ways as (select src, dst from edges union select dst, src from edges),
walk(id, depth) as (select 's1', 0 union select b.dst, w.depth + 1 from walk w join both_ways b on b.src = w.id where w.depth < 3)
select id, min(depth) as depth from walk group by id""")
def khop_3(t: Tables) -> DataFrame:
    start = t.spark.createDataFrame([("s1",)], "id string")
    return graph.k_hop(_edges(t), start, 3)


@query("""with recursive p as (select conv_id || '-' || turn as id, case when turn > 0 then conv_id || '-' || (turn - 1) end as parent from conversations),
c(id, ancestor, step) as (select id, id, 0 from p union all select c.id, p.parent, c.step + 1 from c join p on c.ancestor = p.id where p.parent is not null)
select id, ancestor, step from c""")
def lineage_trace(t: Tables) -> DataFrame:
    """Each turn with every turn it follows, back to the first."""
    name = lambda turn: F.concat_ws("-", "conv_id", turn)
    rows = t.conversations.select(name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"))
    return graph.lineage(rows, rows)


VALID_SQL = """claims as (select o_orderkey, o_custkey, o_orderstatus, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_to from orders)"""


def _claims(t: Tables) -> DataFrame:
    return graph.intervals(t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), "o_custkey", "o_orderdate", "o_orderkey")


@query(f"with {VALID_SQL} select o_orderkey, o_custkey, o_orderstatus from claims where valid_from <= timestamp '1998-06-01' and (valid_to is null or valid_to > timestamp '1998-06-01')")
def claims_as_of(t: Tables) -> DataFrame:
    return graph.valid_at(_claims(t), "1998-06-01").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""with s as (select user_id, event_type, list_sort(list(distinct floor(value / 100))) as found from events group by 1, 2)
select user_id, event_type, case when len(found) = 1 then 'fact' else 'dispute' end as state, case when len(found) = 1 then found[1] end as value, len(found) as n_values from s""")
def single_facts(t: Tables) -> DataFrame:
    rows = t.events.withColumn("v", F.floor(F.col("value") / 100).cast("double"))
    return graph.single_fact(rows, ["user_id", "event_type"], "v")


@query("""with log as (select event_id as seq, user_id as key, event_type as type, ts as retrieved_at, case when event_id % 5 = 0 and event_id >= 300 then event_id - 300 end as supersedes from events),
known as (select * from log where retrieved_at <= timestamp '2024-01-20'), live as (select * from known where seq not in (select supersedes from known where supersedes is not null))
select key, type, seq from (select *, row_number() over (partition by key, type order by seq desc) as n from live) where n = 1""")
def ledger_state(t: Tables) -> DataFrame:
    log = t.events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp_ntz").alias("retrieved_at"),
        F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") >= 300), F.col("event_id") - 300).alias("supersedes_seq"))
    return graph.ledger_as_of(log, "2024-01-20").select("key", "type", "seq")


@query("""select n.n_name as name, count(distinct o.o_orderpriority) as n from nation n join customer c on c_nationkey = n_nationkey join orders o on o_custkey = c_custkey group by 1""")
def runs_per_entity(t: Tables) -> DataFrame:
    """Two hops, then the distinct ends."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("name")).agg(F.count_distinct("o_orderpriority").alias("n"))


@query("""with a as (select s_suppkey, s_name, lower(replace(s_name, '#', ' ')) as alias from supplier)
select a.alias, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from a join lineitem on l_suppkey = s_suppkey group by a.alias""")
def via_alias(t: Tables) -> DataFrame:
    """Facts reached by another name of their entity."""
    names = t.supplier.select("s_suppkey", F.lower(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("alias"))
    return t.lineitem.join(names, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("alias").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'NEW' else c_mktsegment end as area, case when c_custkey % 3 = 0 then 2 else 1 end as version from customer
union all select c_custkey + 1000000, 'NEW', 2 from customer where c_custkey % 10 = 0""")
def upsert_rows(t: Tables) -> DataFrame:
    stored = t.customer.select("c_custkey", F.col("c_mktsegment").alias("area"), F.lit(1).alias("version"))
    fresh = t.customer.where("c_custkey % 3 = 0").select("c_custkey").unionByName(t.customer.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey")))
    return merge.upsert(stored, fresh.select("c_custkey", F.lit("NEW").alias("area"), F.lit(2).alias("version")), ["c_custkey"], "version")


@query("""with b as (select user_id, ts, event_id, event_type from events)
select user_id, min(event_id) as first_seen, max(event_id) as last_seen, max_by(event_type, event_id) as kind from b group by user_id""")
def upsert_seen(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.col("event_id").alias("first_seen"), F.col("event_id").alias("last_seen"), F.col("event_type").alias("kind"))
    return merge.upsert_seen(rows.where("first_seen % 2 = 0"), rows.where("first_seen % 2 = 1"), ["user_id"], "first_seen", "last_seen")


@query("""select c_custkey, c_nationkey, case when c_custkey % 4 = 0 and c_nationkey < 10 then coalesce(case when c_custkey % 8 > 0 then 'CLAIMED' end, c_mktsegment) else c_mktsegment end as area,
c_custkey % 4 = 0 and not c_nationkey < 10 as refused from customer""")
def fenced_update(t: Tables) -> DataFrame:
    """An update only of rows that may be claimed; the others are reported as refused, a null leaves the old value."""
    stored = t.customer.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("area"))
    fresh = stored.where("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 > 0, "CLAIMED").alias("area"))
    return merge.fenced_update(stored, fresh, "c_custkey", F.col("c_nationkey") < 10, ["area"])


@query("""select o_orderkey, case when o_orderkey % 6 = 0 and o_orderstatus = 'O' then 'X' else o_orderstatus end as status, coalesce(o_orderkey % 6 = 0 and o_orderstatus = 'O', false) as swapped from orders""")
def swap_status(t: Tables) -> DataFrame:
    stored = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    stamps = stored.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit("O").alias("expected"), F.lit("X").alias("new"))
    return merge.compare_and_swap(stored, stamps, "o_orderkey", "status")


@query("""select 'price_positive' as rule, count(*) filter (where not l_extendedprice > 0) as n from lineitem union all select 'discount_range', count(*) filter (where not l_discount between 0 and 0.05) from lineitem
union all select 'flag_known', count(*) filter (where not l_returnflag in ('A', 'N')) from lineitem""")
def constraint_report(t: Tables) -> DataFrame:
    return merge.violations(t.lineitem, {
        "price_positive": F.col("l_extendedprice") > 0, "discount_range": F.col("l_discount").between(0, 0.05), "flag_known": F.col("l_returnflag").isin("A", "N")})


@query("""with d as (select o_custkey, o_orderdate, o_orderkey, o_orderpriority from orders), t as (select o_custkey, min(o_orderkey) as keep, count(*) as twins from d group by o_custkey, o_orderdate having count(*) > 1)
select o_custkey, keep, twins from t""")
def same_day_twins(t: Tables) -> DataFrame:
    """Listings of one venue and day; the first stays."""
    return t.orders.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("keep"), F.count("*").alias("twins")).where("twins > 1").select("o_custkey", "keep", "twins")
