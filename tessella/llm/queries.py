"""The registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chunk_store import store_documents
from .common import table
from .decontaminate import find_leaks
from .filter_audit import audit_filters, standard_filters
from .html_text import extract_text
from .lm_score import cross_entropy_difference
from .minhash import near_duplicates
from .packing import pack_documents
from .periodic_runs import find_runs
from .pieces import encode_pieces
from .quality import quality_rules
from .secrets import scan_secrets
from .suffix_dedup import remove_repeats
from .warc import archive_pages


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, one row for each such pair, with its BM25 score and whether a passage retrieved it."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole=True)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), planted=True)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), standard_filters(), copies="E")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_quality_rules, op3_warc, op4_html_text, op5_token_store, op6_best_fit_packing, op7_minhash_near_dedup,
        op8_lm_score, op9_suffix_array_dedup, op10_benchmark_decontamination, op11_periodic_runs, op12_filter_audit, op13_sentencepiece,
    )
}
OP3_SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
k as (select d, max(page_id) as m from p group by d)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(d, cast(1 + 5 * g as bigint), 5) as integer) >> s) & 31) + 1 as bigint), 1)), '')), '') as payload_digest,
  case when page_id = m then 'response' else 'revisit' end as record_type,
  case when page_id <> m then m end as refers_to
from p join k using (d)
"""

OP12_SQL = """
with recursive marks as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
t as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
w as (select doc_id, text, part, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by text) as first from t),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [
  len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] as bad
  from w left join marks on marks.doc_id = w.doc_id),
g as (select part, bad, good, toxic, count(*) as n from f group by all),
orders as (select '' as o union all select o || c from orders, unnest(['A', 'B', 'C', 'D', 'E']) as u(c) where not contains(o, c)),
steps as (select o as filter_order, s as step from orders, range(1, 6) as r(s) where length(o) = 5),
x as (select parts.part, filter_order, cast(step as int) as step,
    list_transform(range(1, step), lambda k: instr('ABCDE', substr(filter_order, k, 1))) as before, instr('ABCDE', substr(filter_order, step, 1)) as own
  from steps, (select distinct part from g) as parts),
y as (select x.part, filter_order, step, own, n, good, toxic, bad[own] as fails,
    len(list_filter(before, lambda k: bad[k])) = 0 as there, len(list_filter(bad, lambda b: b)) = 1 as single
  from x join g on g.part = x.part),
z as (select part, filter_order, step, own,
    sum(case when there and not fails then n else 0 end) as kept, sum(case when there and fails then n else 0 end) as removed,
    sum(case when not there and fails then n else 0 end) as redundant, sum(case when single and fails then n else 0 end) as unique_fails,
    sum(case when there and fails and good then n else 0 end) as good_lost, sum(case when there and fails and toxic then n else 0 end) as toxic_lost
  from y group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley
from z
"""

ORACLE_SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op12_filter_audit": OP12_SQL}
