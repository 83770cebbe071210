"""Queries on published listings and a fresh read of their pages.

A customer is a page; its orders are published rows and, with some changed, what the page states now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators import adjudicate
from ..sources.tables import Tables

TITLE_SQL = "case when o_orderkey % 9 <> 0 then 'Show ' || o_orderpriority || ' ' || (o_orderkey % 50) end"
START_SQL = "date_trunc('year', o_orderdate) + to_minutes(cast(o_orderkey * 37 % 8 * 180 as integer))"
PARSED_START_SQL = f"case when o_orderkey % 17 <> 0 then {START_SQL} + to_minutes(cast(case when o_orderkey % 7 = 0 then 45 when o_orderkey % 8 = 0 then 3000 else 0 end as integer)) end"
SIDES_SQL = f"""
published as (select o_custkey as page, o_orderkey as row, case when o_orderkey % 4 = 0 then 'x' || o_orderkey end as ident, 's' || (o_orderkey % 2) as source, {TITLE_SQL} as title,
  {START_SQL} as start_at, case when o_orderkey % 3 = 0 then {START_SQL} + interval 2 hour end as end_at from orders where o_orderkey % 11 <> 0),
parsed as (select o_custkey as page, o_orderkey as item, case when o_orderkey % 4 = 0 then case when o_orderkey % 5 < 4 then 'x' else 'y' end || o_orderkey end as ident,
  's' || case when o_orderkey % 13 = 0 then 9 else o_orderkey % 2 end as source, case when o_orderkey % 6 = 0 then 'Changed ' || o_orderkey else {TITLE_SQL} end as title,
  {PARSED_START_SQL} as start_at, case when o_orderkey % 5 = 0 then {START_SQL} + interval 3 hour end as end_at, o_orderkey % 5 <> 1 as gate from orders where o_orderkey % 10 <> 0),
facts as (select c_custkey as page, case when c_custkey % 19 = 0 then 'absent' when c_custkey % 17 = 0 then 'unverified' else 'present' end as verdict,
  case when c_custkey % 3 > 0 then coalesce(t.text, 'Nothing here') end as text from customer left join
  (select o_custkey, string_agg('<b>' || ({TITLE_SQL}) || '</b>', '|' order by o_orderkey) as text from orders where o_orderkey % 20 = 0 group by 1) t on o_custkey = c_custkey)"""
KEY_SQL = "nullif(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')), '')"
PT, CT = KEY_SQL.format(c="p.title"), KEY_SQL.format(c="c.title")
MINUTE = "coalesce(date_trunc('minute', p.start_at) = date_trunc('minute', c.start_at), false)"
PAIRS_SQL = f"""
pairs as (select * from (select p.row, c.item, p.page, p.title as p_title, p.start_at as p_start, p.end_at as p_end, c.title as c_title, c.start_at as c_start, c.end_at as c_end, c.gate,
  case when p.ident = c.ident then 'identity'
    when p.ident <> c.ident then case when {MINUTE} then 'collision' when {PT} = {CT} then 'far' end
    when p.source <> c.source then null
    when {MINUTE} then case when {PT} is null or {CT} is null then 'untitled' when {PT} <> {CT} then 'collision' else 'time' end
    when {PT} = {CT} then case when coalesce(abs(date_diff('minute', p.start_at, c.start_at)), 0) <= 720 then 'title' else 'far' end end as kind
  from published p join parsed c on p.page = c.page) where kind is not null)"""
DIFF_SQL = f"""concat_ws(',', case when kind = 'identity' and {KEY_SQL.format(c="c_title")} is not null and {KEY_SQL.format(c="p_title")} is distinct from {KEY_SQL.format(c="c_title")} then 'title' end,
  case when c_start is not null and not coalesce(date_trunc('minute', p_start) = date_trunc('minute', c_start), false) then 'start_time' end,
  case when c_end is not null and not coalesce(date_trunc('minute', p_end) = date_trunc('minute', c_end), false) then 'end_time' end)"""
FOLD_SQL = "trim(regexp_replace(lower(regexp_replace({c}, '<[^>]*>', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def _title(key: str = "o_orderkey"):  # noqa: ANN202
    return F.when(F.col(key) % 9 != 0, F.concat(F.lit("Show "), "o_orderpriority", F.lit(" "), (F.col(key) % 50).cast("string")))


def _start():  # noqa: ANN202
    return F.date_trunc("year", "o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") * 37 % 8 * 180).cast("int"))


def _published(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.where(k % 11 != 0).select(
        F.col("o_custkey").alias("page"), k.alias("row"), F.when(k % 4 == 0, F.concat(F.lit("x"), k.cast("string"))).alias("ident"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("source"),
        _title().alias("title"), _start().alias("start"), F.when(k % 3 == 0, _start() + F.expr("interval 2 hours")).alias("end"))


def _parsed(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    shift = F.when(k % 7 == 0, 45).when(k % 8 == 0, 3000).otherwise(0)
    return t.orders.where(k % 10 != 0).select(
        F.col("o_custkey").alias("page"), k.alias("item"), F.when(k % 4 == 0, F.concat(F.when(k % 5 < 4, "x").otherwise("y"), k.cast("string"))).alias("ident"),
        F.concat(F.lit("s"), F.when(k % 13 == 0, 9).otherwise(k % 2).cast("string")).alias("source"), F.when(k % 6 == 0, F.concat(F.lit("Changed "), k.cast("string"))).otherwise(_title()).alias("title"),
        F.when(k % 17 != 0, _start() + F.make_dt_interval(mins=shift)).alias("start"), F.when(k % 5 == 0, _start() + F.expr("interval 3 hours")).alias("end"), (k % 5 != 1).alias("gate"))


def _facts(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    named = F.concat(F.lit("<b>"), _title(), F.lit("</b>"))
    listed = t.orders.where("o_orderkey % 20 = 0").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", named.alias("t")))).alias("l"))
    shown = F.array_join(F.filter(F.transform("l", lambda x: x["t"]), lambda x: x.isNotNull()), "|")
    verdict = F.when(k % 19 == 0, "absent").when(k % 17 == 0, "unverified").otherwise("present")
    shown = F.when(k % 3 > 0, F.coalesce(F.nullif(shown, F.lit("")), F.lit("Nothing here")))
    return t.customer.join(listed, F.col("o_custkey") == k, "left").select(k.alias("page"), verdict.alias("verdict"), shown.alias("text"))


@query(f"with {SIDES_SQL}, {PAIRS_SQL} select row, item, kind from pairs")
def match_ladder(t: Tables) -> DataFrame:
    """Each published row with each listing of its page that meets it, and how."""
    return adjudicate.match_pairs(_published(t), _parsed(t)).select("p.row", "c.item", "kind")


@query(f"with {SIDES_SQL}, {PAIRS_SQL} select row, item, fields from (select row, item, {DIFF_SQL} as fields from pairs where kind in ('identity', 'time', 'title')) where fields <> ''")
def field_diffs(t: Tables) -> DataFrame:
    """What a matched listing states differently."""
    pairs = adjudicate.match_pairs(_published(t), _parsed(t)).where("kind in ('identity', 'time', 'title')")
    return pairs.select("p.row", "c.item", F.array_join(adjudicate.field_diff("p", "c", F.col("kind")), ",").alias("fields")).where("fields <> ''")


@query(f"""with {SIDES_SQL} select p.row, contains(' ' || {FOLD_SQL.format(c="f.text")} || ' ', ' ' || nullif({FOLD_SQL.format(c="p.title")}, '') || ' ') as on_page from published p join facts f using (page)""")
def titles_on_page(t: Tables) -> DataFrame:
    rows = _published(t).join(_facts(t), "page")
    return rows.select("row", adjudicate.still_on_page(F.col("title"), F.col("text")).alias("on_page"))


@query(f"""with {SIDES_SQL} select page, cast(date_trunc('minute', start_at) as varchar) as minute, n from (select page, start_at, count(*) as n, count(distinct ident) as ids from parsed where start_at is not null
  group by page, start_at) where n >= 2 and ids < n""")
def contested_minutes(t: Tables) -> DataFrame:
    """Minutes of a page with several listings that identities don't tell apart."""
    return adjudicate.contested_minutes(_parsed(t)).select("page", F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "n")


@query(f"""with {SIDES_SQL} select p.row, coalesce(bool_or(c.start_at <= p.start_at) and bool_or(c.start_at >= p.start_at), false) as covered
from published p left join parsed c on p.page = c.page and c.gate group by p.row""")
def bracketed_rows(t: Tables) -> DataFrame:
    """Whether listings that pass the gate stand on both sides of a row's start."""
    rows = _published(t).join(adjudicate.bracket(_parsed(t)), "page", "left")
    return rows.select("row", F.coalesce(F.col("start").between(F.col("first_gated"), F.col("last_gated")), F.lit(False)).alias("covered"))


@query(f"""with {SIDES_SQL}, {PAIRS_SQL},
h0 as (select *, max(case when kind = 'identity' then 1 else 0 end) over (partition by row) as by_id from pairs),
h1 as (select *, count(*) over (partition by row) as hits, count(*) over (partition by item) as claims from h0 where kind in ('identity', 'time', 'title') and (by_id = 0 or kind = 'identity')),
h as (select row, any_value(hits) as hits, max(claims) as claims, min_by(kind, item) as kind, min_by(gate, item) as gate, arg_min_null(c_title, item) as c_title, arg_min_null(c_start, item) as c_start,
  arg_min_null(c_end, item) as c_end from h1 group by row),
near as (select distinct row from pairs where kind in ('collision', 'untitled', 'far')),
n as (select page, count(*) as n_parsed, min(start_at) filter (where gate) as lo, max(start_at) filter (where gate) as hi from parsed group by page),
m as (select page, start_at from parsed where start_at is not null group by page, start_at having count(*) >= 2 and count(distinct ident) < count(*)),
j as (select p.row, p.title as p_title, p.start_at as p_start, p.end_at as p_end, f.verdict, f.text, n.n_parsed, n.lo, n.hi, h.hits, h.claims, h.kind, h.gate, h.c_title, h.c_start, h.c_end, near.row as near_row, m.start_at as doubt
  from published p left join facts f using (page) left join n using (page) left join h using (row) left join near using (row) left join m on m.page = p.page and m.start_at = h.c_start),
d as (select *, {DIFF_SQL} as diff from j),
r as (select *, case when verdict = 'absent' then 'page_gone' when verdict is distinct from 'present' then 'page_unverified' when n_parsed is null then 'nothing_parsed'
  when hits > 1 or claims > 1 then 'ambiguous'
  when hits is null then case when near_row is not null then 'neighbour'
    when coalesce(contains(' ' || {FOLD_SQL.format(c="text")} || ' ', ' ' || nullif({FOLD_SQL.format(c="p_title")}, '') || ' '), true) then 'still_on_page'
    when not coalesce(p_start between lo and hi, false) then 'not_bracketed' else 'not_listed' end
  when kind <> 'identity' and doubt is not null then 'contested' when diff = '' then 'no_difference' when not gate then 'gate' when kind = 'title' then 'title_only'
  when coalesce(case when contains(diff, 'end_time') then c_end else p_end end <= case when contains(diff, 'start_time') then c_start else p_start end, false) then 'window' else 'stated' end as reason from d)
select row, case when reason in ('page_gone', 'not_listed') then 'cancel' when reason = 'stated' then 'update' else 'keep' end as decision, reason, case when reason = 'stated' then diff end as fields from r""")
def page_adjudication(t: Tables) -> DataFrame:
    """One decision a published row: cancel, update with the stated difference, or keep, and why."""
    return adjudicate.adjudicate(_published(t), _parsed(t), _facts(t))


@query("""with f as (select event_id, case when event_id % 23 = 0 then null when event_type = 'error' then case when event_id % 2 = 0 then 404 else 503 end else 200 end as status,
  case when event_id % 5 > 0 then event_id % 2 = 0 end as changed, case when event_id % 31 = 0 then 'timeout' end as error from events)
select verdict, count(*) as n, sum(event_id) as ids from (select event_id, case when error is not null then 'unverified' when status = 200 and changed is not null then 'present' when status in (404, 410) then 'absent'
  else 'unverified' end as verdict from f) group by verdict""")
def recheck_verdicts(t: Tables) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 23 == 0, None).when(F.col("event_type") == "error", F.when(k % 2 == 0, 404).otherwise(503)).otherwise(200)
    verdict = adjudicate.recheck_verdict(status, F.when(k % 5 > 0, k % 2 == 0), F.when(k % 31 == 0, F.lit("timeout")))
    return t.events.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
