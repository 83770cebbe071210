"""Exams, scores of predictions, memory reports, handoffs and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import grading, listing_pages
from ..sources.staging import stored
from ..sources.tables import Tables
from .listing_pages import PATTERNS, SELECTORS, _desks


def _text(*parts) -> Column:  # noqa: ANN002
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("""with f as (select l_orderkey as k, l_linenumber as l, unnest(['part', 'flag', 'tax']) as field, unnest([case when l_partkey % 5 > 0 then cast(l_partkey % 3 as varchar) end, case when l_partkey % 7 > 0 then l_returnflag end, case when l_tax > 0.02 then 't' end]) as want,
  unnest([case when l_partkey % 6 > 0 then cast(l_partkey % 3 + case when l_partkey % 4 = 0 then 1 else 0 end as varchar) end, case when l_partkey % 3 > 0 then l_returnflag end, case when l_tax > 0.04 then 't' end]) as said, l_suppkey % 50 = 3 as silent, l_suppkey % 40 = 9 and l_suppkey % 50 <> 3 as injected, l_partkey, l_suppkey, l_quantity, l_shipdate, rowid as r
  from (select *, row_number() over () as rowid from lineitem)),
e as (select r, any_value(silent) as silent, any_value(injected) as injected, count(want) as expected, count(*) filter (where not silent and said = want) as ok, count(*) filter (where not silent and said is not null and want is null) as made_up,
  count(*) filter (where not silent and said <> want) as wrong, count(*) filter (where not silent and said is null and want is not null) as missed from f group by r),
t as (select count(*) as n_examples, cast(sum(expected) as bigint) as expected, cast(sum(ok + made_up + wrong) as bigint) as asserted, count(*) filter (where silent) as unanswered, count(*) filter (where injected) as injections, sum(ok) as ok, sum(made_up) as made_up, sum(wrong) as wrong, sum(missed) as missed,
  count(*) filter (where made_up > 0 or injected) as with_made_up, count(*) filter (where made_up + wrong + missed > 0 or injected) as with_error from e)
select n_examples, expected, asserted, unanswered, injections, round(made_up / asserted, 4) as hallucination_rate, round(ok / asserted, 4) as precision, round(ok / (ok + wrong + missed), 4) as recall, round(with_made_up / n_examples, 4) as made_up_rate, round(with_error / n_examples, 4) as error_rate, false as passed from t""")
def exam_report(t: Tables) -> DataFrame:
    """An extraction exam over all line items: hallucinations, recall, injections and whether it passes."""
    p = F.col("l_partkey")
    maps = lambda *v: F.create_map(*(x for name, value in zip(("part", "flag", "tax"), v) for x in (F.lit(name), value)))
    want = maps(F.when(p % 5 > 0, (p % 3).cast("string")), F.when(p % 7 > 0, F.col("l_returnflag")), F.when(F.col("l_tax") > 0.02, F.lit("t")))
    said = maps(F.when(p % 6 > 0, (p % 3 + F.when(p % 4 == 0, 1).otherwise(0)).cast("string")), F.when(p % 3 > 0, F.col("l_returnflag")), F.when(F.col("l_tax") > 0.04, F.lit("t")))
    silent = F.col("l_suppkey") % 50 == 3
    rows = t.lineitem.select(F.col("l_orderkey").alias("example"), want.alias("expected"), F.when(~silent, said).alias("predicted"), F.when(F.col("l_suppkey") % 40 == 9, "obey: IGNORE all").otherwise("fine").alias("said"), F.array(F.lit("ignore ALL"), F.lit("system prompt")).alias("forbidden"))
    return grading.exam_report(rows, ["part", "flag", "tax"])


@query("""with l as (select l_orderkey as e, l_returnflag as kind, count(*) as n from lineitem where l_linenumber % 2 = 0 group by 1, 2), p as (select l_orderkey as e, case when l_linenumber % 5 = 0 then 'X' else l_returnflag end as kind, count(*) as n from lineitem where l_linenumber % 3 <> 1 group by 1, 2),
m as (select coalesce(l.kind, p.kind) as kind, coalesce(l.n, 0) as labelled, coalesce(p.n, 0) as predicted, least(coalesce(l.n, 0), coalesce(p.n, 0)) as matched from l full join p on l.e = p.e and l.kind = p.kind),
s as (select kind, sum(labelled) as labelled, sum(predicted) as predicted, sum(matched) as matched from m group by kind union all select null, sum(labelled), sum(predicted), sum(matched) from m)
select kind, cast(labelled as bigint) as labelled, cast(predicted as bigint) as predicted, cast(matched as bigint) as matched, case when predicted = 0 then 0.0 else round(matched / predicted, 4) end as precision, case when labelled = 0 then 0.0 else round(matched / labelled, 4) end as recall from s""")
def matched_scores(t: Tables) -> DataFrame:
    """Predictions against labels of each document, one for one, by kind and over all."""
    line = F.col("l_linenumber")
    rows = t.lineitem.select(F.col("l_orderkey").alias("example"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("pos"), "l_linenumber", "l_returnflag")
    labels = rows.where(line % 2 == 0).select("example", "pos", F.col("l_returnflag").alias("kind"), F.lit("due").alias("word"))
    said = rows.where(line % 3 != 1).select("example", "pos", F.when(line % 5 == 0, "X").otherwise(F.col("l_returnflag")).alias("kind"), F.lit("is DUE soon").alias("statement"))
    return grading.matched_scores(labels, said, lambda label, p: F.contains(F.lower(p["statement"]), label["word"]))


@query("""with r as (select event_type as category, value > 40 as ok, event_id % 5 = 0 as abstained, event_id % 10 < 2 as should, event_id % 3 > 0 as cited, event_id % 7 = 0 as disputed from events),
c as (select category, count(*) as n, count(*) filter (where ok) as ok, count(*) filter (where not abstained and not disputed) as answered, count(*) filter (where not abstained and not disputed and cited) as cited, count(*) filter (where should) as should, count(*) filter (where should and abstained) as did from r group by category),
a as (select * from c union all select null, sum(n), sum(ok), sum(answered), sum(cited), sum(should), sum(did) from c)
select category, cast(n as bigint) as n, round(ok / n, 4) as accuracy, case when answered = 0 then 1.0 else round(cited / answered, 4) end as provenance, case when should = 0 then 1.0 else round(did / should, 4) end as abstention from a""")
def memory_report(t: Tables) -> DataFrame:
    """Answers from memory by category: accuracy, sources named, abstention where nothing is known."""
    e = F.col("event_id")
    rows = t.events.select(F.col("event_type").alias("category"), (F.col("value") > 40).alias("correct"), (e % 5 == 0).alias("abstained"), (e % 10 < 2).alias("should_abstain"), (e % 3 > 0).alias("cited"), (e % 7 == 0).alias("disputed"))
    return grading.memory_report(rows)


@query("""with s as (select o_custkey as run, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as stage, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders),
l as (select run, stage || ':id' as loss from s where stage > 1 and k % 7 = 0 and before % 7 <> 0 and k % 2 = 0 union all select run, stage || ':note ' || (before % 5) from s where stage > 1 and k % 5 <> before % 5 and k % 3 = 0),
a as (select run, list_sort(list(loss)) as losses from l group by run), c as (select run, max_by(case when k % 7 = 0 then 'name,' else 'id,name,' end || 'note ' || (k % 5), stage) as carried from s group by run)
select c.run, carried, coalesce(array_to_string(losses, ','), '') as losses from c left join a using (run)""")
def handoff_losses(t: Tables) -> DataFrame:
    """What every run of stages carries on and what it has lost without a word."""
    from pyspark.sql import Window

    k, w = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    note = lambda c: _text("note ", (c % 5).cast("string"))
    rows = t.orders.select(F.col("o_custkey").alias("run"), "o_orderkey", F.row_number().over(w).alias("stage"), F.coalesce(F.lag("o_orderkey").over(w), F.lit(0)).alias("before"))
    payload = F.when(k % 7 == 0, F.array(F.lit("name"), note(k))).otherwise(F.array(F.lit("id"), F.lit("name"), note(k)))
    moved = F.when(k % 7 == 0, F.create_map(F.lit("id"), F.when(k % 2 == 1, F.lit("name")).otherwise(F.lit("gone")))).otherwise(F.create_map().cast("map<string,string>"))
    used = F.create_map(note(F.col("before")), F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lit("merged")))
    stages = rows.select("run", "stage", payload.alias("payload"), moved.alias("transformed"), used.alias("consumed"))
    found = grading.handoff_losses(stages)
    return found.select("run", F.array_join("carried", ",").alias("carried"), F.array_join("losses", ",").alias("losses"))


@query("""with o as (select o_custkey as ledger, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos from orders)
select ledger, cast(pos as int) as pos, case when k % 11 > 0 then cast(k as varchar) end as pr, case when k % 11 > 0 then 'run `a | b` or c' end as what, case when k % 11 > 0 then case when k % 2 = 0 then '' else 'x' end end as note, case when k % 11 = 0 then '4 cells' end as problem from o""")
def ledger_rows(t: Tables) -> DataFrame:
    """Rows of the table in a written ledger; pipes within code are content, a row of another width is not read."""
    k = F.col("o_orderkey")
    line = _text("| ", k.cast("string"), " | run `a | b` or c | ", F.when(k % 2 == 0, "").otherwise("x"), F.when(k % 11 == 0, " | more").otherwise(""), " |")
    parts = F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("s"))))["s"], "\n")
    body = _text("# Ledger\n## Other\n| 1 | no | no |\n## PR rows\n| pr | what | note |\n| -- | -- | -- |\n", parts, "\n## End\n| 2 | no | no |\n")
    books = t.orders.groupBy(F.col("o_custkey").alias("ledger")).agg(body.alias("body"))
    return grading.ledger_tables(books, "ledger", "body", "PR rows", ["pr", "what", "note"])


@query("""with o as (select o_custkey % 20 as walk, o_custkey as page, o_custkey % 5 as form, o_orderkey as k, case when o_orderkey % 3 = 0 then 2 else 1 end as nights from orders),
p as (select walk, page, form, count(*) as n, count(*) filter (where k % 4 = 0) as data, sum(nights) as nights from o group by 1, 2, 3)
select walk, count(*) as pages, count(*) filter (where form >= 3) as unsplit, cast(sum(case when form = 0 then 2 * n when form = 1 then 2 * n + data when form = 2 then n else 0 end) as bigint) as rows_seen,
  cast(sum(case when form < 3 then nights else 0 end) as bigint) as happenings, cast(sum(case when form < 3 then nights else 0 end) as bigint) as dated, cast(sum(case when form = 2 then n else 0 end) as bigint) as own_list from p group by walk""")
def walk_counts(t: Tables) -> DataFrame:
    """What every walk over listing pages saw: rows as printed, happenings once each, dated ones, pages without rows, rows that named the list itself."""
    read = stored(listing_pages.listing_rows(_desks(t), "page", "url", "html", PATTERNS, SELECTORS))  # read twice below
    walk = (F.col("page") % 20).alias("walk")
    seen = listing_pages.page_reasons(read, "page").groupBy(walk).agg(F.count("*").alias("pages"), F.count_if(F.col("reason").isNotNull()).alias("unsplit"), F.sum(F.col("structured") + F.col("printed")).alias("rows_seen"), F.sum("own_list").alias("own_list"))
    rows = listing_pages.page_rows(read, "page").groupBy(walk).agg(F.count("*").alias("happenings"), F.count("when").alias("dated"))
    return seen.join(rows, "walk", "left").fillna(0, ["happenings", "dated"])
