"""Matching and de-duplication queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import matching
from ..sources.tables import LISTINGS_SQL, Tables

STOP = ["the", "and", "of", "at", "in", "on", "for", "with", "to", "live", "show"]
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
TOKENS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) > 1 and not list_contains({s}, w)))"
TRIGRAMS_SQL = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
JACCARD_SQL = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


@query("""with o as (select o_orderkey as id, o_custkey, o_orderkey * 37 % 100000 as minute from orders)
select a.o_custkey as venue, a.id as a_id, b.id as b_id, b.minute - a.minute as apart from o a join o b on a.o_custkey = b.o_custkey and a.id < b.id and abs(a.minute - b.minute) <= 90""")
def dup_window(t: Tables) -> DataFrame:
    """Listings of one venue within 90 minutes of each other."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("venue"), (F.col("o_orderkey") * 37 % 100000).alias("minute"))
    return matching.band_pairs(rows, "venue", "minute", "id", 90)


@query("""with o as (select o_orderkey as id, o_custkey as venue, o_orderkey * 37 % 100000 // 60 * 60 as minute, case when o_orderkey % 5 > 0 then o_orderpriority end as title from orders)
select a.id as a_id, b.id as b_id, case when a.minute = b.minute and a.title = b.title then 'same_show' else 'neighbour' end as verdict
from o a join o b on a.venue = b.venue and a.id < b.id and abs(a.minute - b.minute) <= 90""")
def same_show(t: Tables) -> DataFrame:
    """Of the pairs above: the same minute and title, or neighbours; a missing title never matches."""
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("venue"), (F.floor(F.col("o_orderkey") * 37 % 100000 / 60) * 60).alias("minute"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("title"))
    pairs = matching.band_pairs(rows, "venue", "minute", "id", 90)
    titles = rows.select("id", "title")
    named = pairs.join(titles.select(F.col("id").alias("a_id"), F.col("title").alias("a_title")), "a_id").join(titles.select(F.col("id").alias("b_id"), F.col("title").alias("b_title")), "b_id")
    same = (F.col("apart") == 0) & (F.col("a_title") == F.col("b_title"))
    return named.select("a_id", "b_id", F.when(same, "same_show").otherwise("neighbour").alias("verdict"))


NAMES_SQL = "names as (select row_number() over (order by p_name, p_type) as id, p_name || ' ' || lower(p_type) as name from (select distinct p_name, p_type from part))"


def _names(t: Tables) -> DataFrame:
    """The distinct names of parts with their types: a few hundred, whatever the number of parts."""
    distinct = t.part.select("p_name", "p_type").distinct()
    return distinct.select(F.row_number().over(Window.orderBy("p_name", "p_type")).alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))


@query(f"""with {NAMES_SQL}, k as (select id, {TOKENS_SQL.format(c="name", s=STOP_SQL)} as items from names)
select a.id as l_id, b.id as r_id, round({JACCARD_SQL.format(a="a.items", b="b.items")}, 6) as similarity from k a, k b
where a.id < b.id and {JACCARD_SQL.format(a="a.items", b="b.items")} >= 0.5""")
def fuzzy_same_event(t: Tables) -> DataFrame:
    rows = _names(t).select("id", matching.tokens(F.col("name"), STOP).alias("items"))
    pairs = matching.similar_sets(rows, rows, 0.5).where("l_id < r_id")
    return pairs.select("l_id", "r_id", F.round("similarity", 6).alias("similarity"))


@query(f"""with {NAMES_SQL}, k as (select id, {TRIGRAMS_SQL.format(c="name")} as items from names),
q as (select id, {TRIGRAMS_SQL.format(c="substr(name, 1, length(name) - 2)")} as items from names),
p as (select q.id as l_id, k.id as r_id, {JACCARD_SQL.format(a="q.items", b="k.items")} as s from q, k where {JACCARD_SQL.format(a="q.items", b="k.items")} >= 0.45)
select l_id, r_id, round(s, 6) as similarity from (select *, row_number() over (partition by l_id order by s desc, r_id) as n from p) where n = 1""")
def trigram_resolve(t: Tables) -> DataFrame:
    """Each shortened name resolved to the most similar known one."""
    names = _names(t)
    asked = names.select("id", matching.trigrams(F.expr("substr(name, 1, length(name) - 2)")).alias("items"))
    pairs = matching.similar_sets(asked, names.select("id", matching.trigrams(F.col("name")).alias("items")), 0.45)
    return matching.best_match(pairs).select("l_id", "r_id", F.round("similarity", 6).alias("similarity"))


@query(f"""with {NAMES_SQL}, known as (select min(p_partkey) as key, p_name from part where p_partkey % 2 = 0 group by p_name),
asked as (select p_partkey, p_name from part where p_partkey % 2 = 1)
select a.p_partkey, coalesce(k.key, -1) as resolved, case when k.key is null then 'created' else 'exact' end as how from asked a left join known k using (p_name)""")
def resolve_cascade(t: Tables) -> DataFrame:
    """Exact match on the name, else a new entity."""
    known = t.part.where("p_partkey % 2 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("key"))
    asked = t.part.where("p_partkey % 2 = 1").join(known, "p_name", "left")
    return asked.select("p_partkey", F.coalesce("key", F.lit(-1)).alias("resolved"), F.when(F.col("key").isNull(), "created").otherwise("exact").alias("how"))


@query("""with s as (select l_orderkey, count(distinct l_suppkey) as sources, list_sort(list(distinct l_returnflag)) as classes from lineitem group by l_orderkey)
select l_orderkey, sources, array_to_string(classes, ',') as classes from s where sources >= 2""")
def corroboration(t: Tables) -> DataFrame:
    """Claims that at least two distinct sources make, with the classes of the sources."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("sources"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("classes"))
    return rows.where("sources >= 2")


@query("""with k as (select p_partkey, lower(p_name) || '~' || p_brand as key, p_type, p_size from part),
g as (select key, count(*) as members, min(p_partkey) as first_seen, min_by(p_type, p_partkey) as kind, list_sort(list(distinct p_size))[1] as smallest from k group by key)
select key, members, first_seen, kind, smallest from g""")
def desk_union_keys(t: Tables) -> DataFrame:
    """Rows with one key become one; the first seen gives the kind."""
    key = F.concat_ws("~", F.lower("p_name"), "p_brand")
    return t.part.groupBy(key.alias("key")).agg(
        F.count("*").alias("members"), F.min("p_partkey").alias("first_seen"), F.min_by("p_type", "p_partkey").alias("kind"), F.min("p_size").alias("smallest"))


@query("""with k as (select p_partkey, p_name, p_brand, p_type, p_size from part)
select a.p_partkey as a_id, b.p_partkey as b_id from k a join k b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey < b.p_partkey and a.p_name <> b.p_name""")
def near_misses(t: Tables) -> DataFrame:
    """Pairs of one night, place and kind that were not merged."""
    night = ["p_brand", "p_type", "p_size"]
    rows = t.part.select("p_partkey", "p_name", *night)
    return matching.differing_pairs(rows, night, "p_name", "p_partkey")


@query("""with o as (select c_custkey, c_name as name, c_mktsegment as area, c_nationkey as city from customer),
n as (select c_custkey, c_name as name, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then 'OTHER' else c_mktsegment end as area,
  case when c_custkey % 3 = 0 then c_nationkey + 1 else c_nationkey end as city from customer),
d as (select c_custkey, concat_ws(',', case when o.name is distinct from n.name then 'name' end, case when o.area is distinct from n.area then 'area' end, case when o.city is distinct from n.city then 'city' end) as fields
  from o join n using (c_custkey))
select c_custkey, fields from d where fields <> ''""")
def drift(t: Tables) -> DataFrame:
    """Fields that differ between the stored and the fresh version, null counting as a value."""
    old = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("area"), F.col("c_nationkey").alias("city"))
    area = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment"))
    new = F.struct(F.col("c_name").alias("name"), area.alias("area"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("city"))
    both = t.customer.select("c_custkey", old.alias("old"), new.alias("new"))
    return both.select("c_custkey", F.array_join(matching.drifted(["name", "area", "city"], "old", "new"), ",").alias("fields")).where("fields <> ''")


@query("""with k as (select p_partkey, case when p_partkey % 4 > 0 then p_brand end as brand, case when p_partkey % 3 > 0 then p_type end as type from part)
select a.p_partkey as a_id, b.p_partkey as b_id, case when a.brand <> b.brand or a.type <> b.type then 'different' when a.brand = b.brand or a.type = b.type then 'same' else 'unknown' end as verdict
from k a join k b on a.p_partkey + 1 = b.p_partkey or a.p_partkey + 7 = b.p_partkey""")
def identity_verdicts(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("brand"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("type"))
    left = rows.withColumn("other", F.explode(F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 7)))
    pair = left.alias("a").join(rows.alias("b"), F.expr("a.other = b.p_partkey"))
    verdict = matching.identity_verdict([(F.col("a.brand"), F.col("b.brand")), (F.col("a.type"), F.col("b.type"))])
    return pair.select(F.col("a.p_partkey").alias("a_id"), F.col("b.p_partkey").alias("b_id"), verdict.alias("verdict"))


@query(f"""with {LISTINGS_SQL}, m as (select venue_id, epoch(start_time) // 86400 as day, count(*) as n, count(distinct case when event_id % 6 > 0 then event_id end) as ids from listings where start_time is not null group by 1, 2)
select venue_id, day, n from m where n >= 2 and ids < n""")
def contested_days(t: Tables) -> DataFrame:
    """Venue days with several listings that are not all told apart by an id."""
    day = F.floor(F.unix_seconds(F.col("start_time").cast("timestamp")) / 86400)
    rows = t.listings().where("start_time is not null").groupBy("venue_id", day.alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("event_id") % 6 > 0, F.col("event_id"))).alias("ids"))
    return rows.where("n >= 2 and ids < n").select("venue_id", "day", "n")


@query("""with d as (select doc_id, text from documents), w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) as word from d),
b as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) as word from benchmark)
select item_id, doc_id, count(*) as shared from b join w using (word) group by item_id, doc_id having count(*) >= 12""")
def doc_benchmark_match(t: Tables) -> DataFrame:
    """Documents that share at least twelve distinct words of four letters or more with a benchmark item."""
    words = lambda rows, key: rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{4,})"), 1))).alias("word"))
    return words(t.benchmark, "item_id").join(words(t.documents, "doc_id"), "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).where("shared >= 12")
