"""Evidence, keys and unions: what several sources say of one listing, and which rows are one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators import state, trust, union
from ..sources.tables import LISTINGS_SQL, Tables

def line_order() -> Column:
    return F.col("l_orderkey")


def line_part() -> Column:
    return F.col("l_partkey")
SEQ_SQL = "l_shipdate, l_linenumber, l_partkey, l_suppkey"


@query("""with g as (select l_orderkey, count(distinct l_returnflag || l_linestatus) as n from lineitem group by 1)
select l_orderkey, case when n >= 3 then 'ready' else 'needs ' || (3 - n) end as gate from g""")
def surge_gate(t: Tables) -> DataFrame:
    """The gate while many fakes are about: three classes and no anchor."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("c"))
    return rows.select("l_orderkey", trust.gate(F.col("c"), ["none"], needed=3).alias("gate"))


@query("""with g as (select l_orderkey as k, count(distinct l_returnflag) as n, count(distinct l_shipdate) as i from lineitem group by 1), b as (select *, n >= 2 as ready from g)
select k as l_orderkey, case when not ready then 'hold' when k % 11 = 0 or k % 13 = 0 then 'escalate' else 'pass' end as decision,
  case when ready then nullif(concat_ws('; ', case when k % 11 = 0 then 'validation_error' end, case when k % 13 = 0 then 'private' end), '') end as reason,
  case when i > 1 then 'start_time' end as hole, case when k % 7 = 0 then 'identity_unsettled' end as note from b""")
def three_way_gate(t: Tables) -> DataFrame:
    """Hold, escalate or pass, with the holes and notes that decide nothing."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("c"), F.count_distinct("l_shipdate").alias("i"))
    verdict = trust.three_way_gate(trust.gate(F.col("c"), ["none"]) == "ready", F.col("i"), line_order() % 7 == 0, line_order() % 11 == 0, line_order() % 13 == 0)
    return rows.select("l_orderkey", verdict.alias("v")).select("l_orderkey", "v.*")


@query("""with c as (select l_orderkey as k, l_suppkey % 3 as s, case when l_partkey % 9 > 0 then date_trunc('year', l_shipdate) end as w from lineitem where l_returnflag <> 'A'),
s as (select k, s, min(w) as lo from c where w is not null group by 1, 2 having count(distinct w) = 1) select k as l_orderkey, count(*) as n_settled, count(distinct lo) > 1 as contested from s group by k""")
def contested_clocks(t: Tables) -> DataFrame:
    """Clocks that two settled sources contest; claims without evidence don't count."""
    claims = t.lineitem.where("l_returnflag <> 'A'").select("l_orderkey", (F.col("l_suppkey") % 3).alias("s"), F.when(line_part() % 9 > 0, F.date_trunc("year", "l_shipdate")).alias("w"))
    return trust.settled_conflicts(claims, "l_orderkey", "s", "w")


@query(f"""with t as (select l_orderkey as k, l_suppkey as own from (select *, row_number() over (partition by l_orderkey order by {SEQ_SQL}) as n from lineitem) where n = 1),
p as (select l_orderkey as k, l_suppkey as s, l_returnflag as class, row_number() over (partition by l_orderkey, l_suppkey order by {SEQ_SQL}) as n from lineitem),
c as (select t.k, count(p.s) as others, count(distinct p.class) as classes from t left join p on p.k = t.k and p.n = 1 and p.s <> t.own group by t.k)
select k as l_orderkey, others, classes, case when classes >= 2 then 'confirmed' else 'unverified' end as confidence from c""")
def triangulated(t: Tables) -> DataFrame:
    """Other sources that make the claim of a target, each once with its first row, and the confidence they give."""
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
    own = F.first("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy(*order))
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy(*order))
    rows = t.lineitem.withColumn("own", own).withColumn("n", nth)
    other = (F.col("n") == 1) & (F.col("l_suppkey") != F.col("own"))
    found = rows.groupBy("l_orderkey").agg(F.count_if(other).alias("others"), F.collect_set(F.when(other, F.col("l_returnflag"))).alias("c"))
    return found.select("l_orderkey", "others", F.size("c").cast("bigint").alias("classes"), trust.derived_confidence(F.col("c"), ["none"]).alias("confidence"))


@query("""with o as (select l_suppkey as k, l_discount as u, (1 - l_discount) * l_tax * 10 as b, (1 - l_discount) * (1 - l_tax * 10) as d from lineitem where l_tax <= 0.1),
s as (select k, count(*) filter (where u = 0) as n0, count(*) as n, sum(case when u > 0 then 1 / u end) as w, avg(case when u = 0 then b end) as b0, avg(case when u = 0 then d end) as d0,
  sum(case when u > 0 then b / u end) as b1, sum(case when u > 0 then d / u end) as d1 from o group by k)
select k as l_suppkey, round(case when n0 > 0 then b0 else b1 / w end, 6) as b, round(case when n0 > 0 then d0 else d1 / w end, 6) as d, round(case when n0 > 0 then 0 else n / w end, 6) as u from s""")
def averaging_fusion(t: Tables) -> DataFrame:
    """Dependent opinions of each source averaged; dogmatic ones outweigh all others."""
    u = F.col("l_discount")
    rows = t.lineitem.where("l_tax <= 0.1").select("l_suppkey", u.alias("u"), ((1 - u) * F.col("l_tax") * 10).alias("b"), ((1 - u) * (1 - F.col("l_tax") * 10)).alias("d"))
    return trust.averaged(rows, "l_suppkey", "b", "d", "u").select("l_suppkey", *(F.round(c, 6).alias(c) for c in "bdu"))


@query("""with c(action, mode, loss) as (values ('publish', 'N', 0.0), ('publish', 'A', 4.0), ('publish', 'R', 20.0), ('hold', 'N', 3.0), ('hold', 'A', 2.0), ('hold', 'R', 1.0)),
b as (select l_suppkey as k, l_linestatus as answer, l_returnflag as mode, count(*) * 1.0 / sum(count(*)) over (partition by l_suppkey) as p from lineitem group by 1, 2, 3),
m as (select k, mode, sum(p) as p from b group by 1, 2), prior as (select k, min(loss) as loss from (select k, action, sum(p * loss) as loss from m join c using (mode) group by 1, 2) group by k),
post as (select k, sum(loss) as loss from (select k, answer, min(loss) as loss from (select k, answer, action, sum(p * loss) as loss from b join c using (mode) group by 1, 2, 3) group by 1, 2) group by k)
select k as l_suppkey, round(prior.loss, 9) as prior, round(prior.loss - post.loss - 0.05, 9) as value from prior join post using (k)""")
def value_of_information(t: Tables) -> DataFrame:
    """What an answer is worth before it is asked for."""
    counted = t.lineitem.groupBy("l_suppkey", F.col("l_linestatus").alias("answer"), F.col("l_returnflag").alias("mode")).agg(F.count("*").alias("n"))
    branches = counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey")))
    modes = branches.groupBy("l_suppkey", "mode").agg(F.sum("p").alias("p"))
    costs = t.spark.createDataFrame([("publish", "N", 0.0), ("publish", "A", 4.0), ("publish", "R", 20.0), ("hold", "N", 3.0), ("hold", "A", 2.0), ("hold", "R", 1.0)], "action string, mode string, loss double")
    return trust.value_of_information(modes, branches, costs, "l_suppkey", 0.05).select("l_suppkey", F.round("prior", 9).alias("prior"), F.round("value", 9).alias("value"))


@query("""with s as (select p_partkey as k, p_size % 4 as n from part) select k as p_partkey, case when k % 17 = 0 then 'hold' when k % 5 = 0 or k % 7 = 0 then 'verified' when n >= 1 then 'validated' else 'hold' end as decision,
case when k % 17 = 0 then null when k % 5 = 0 or k % 7 = 0 or n >= 2 then 'confirmed' when n >= 1 then 'unverified' end as confidence,
case when k % 17 = 0 then 'spoof' when k % 5 = 0 or k % 7 = 0 or n >= 1 then null when k % 2 = 0 then 'no_second_signal' else 'no_authority' end as hold_reason from s""")
def verification_cascade(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k, trust.verification(k % 17 == 0, k % 5 == 0, k % 7 == 0, F.col("p_size") % 4, k % 2 == 0).alias("v")).select("p_partkey", "v.*")


@query("""with c as (select l_orderkey as k, case l_linenumber % 3 when 0 then strftime(l_shipdate, '%Y-%m-%d') when 1 then strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') else 'soon ' || l_returnflag end as said,
  case when l_linenumber % 3 < 2 then strftime(l_shipdate, '%Y-%m-%d') else 'soon ' || l_returnflag end as instant from lineitem)
select k as l_orderkey, count(distinct instant) as instants, count(distinct said) as texts from c group by k""")
def distinct_instants(t: Tables) -> DataFrame:
    """Moments that a listing's sources state, told apart by the moment and not by the text; what can't be read is itself."""
    said = F.when(F.col("l_linenumber") % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(F.col("l_linenumber") % 3 == 1, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.lit("soon "), "l_returnflag"))
    rows = t.lineitem.select("l_orderkey", said.alias("said"))
    return rows.groupBy("l_orderkey").agg(F.count_distinct(union.instant_key(F.col("said"))).alias("instants"), F.count_distinct("said").alias("texts"))


ROWS_SQL = f"""rows as (select l_suppkey % 4 as page, row_number() over (partition by l_suppkey % 4 order by {SEQ_SQL}, l_orderkey) as pos, case when l_partkey % 3 = 0 then 'https://h.example/' || (l_partkey % 200) end as url,
  'Show ' || (l_partkey % 60) as title, case when l_partkey % 4 > 0 then strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') end as day, case when l_linenumber % 2 = 0 then 'Hall ' || l_linenumber end as place,
  case when l_quantity < 10 then 'music' end as kind, l_quantity < 5 as stated from lineitem)"""


def _rows(t: Tables) -> DataFrame:
    seq = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey"]
    lines = state.numbered(t.lineitem.select((F.col("l_suppkey") % 4).alias("page"), *seq, "l_quantity"), "page", seq)
    return lines.select(
        "page", "pos", F.when(line_part() % 3 == 0, F.concat(F.lit("https://h.example/"), (line_part() % 200).cast("string"))).alias("url"), F.concat(F.lit("Show "), (line_part() % 60).cast("string")).alias("title"),
        F.when(line_part() % 4 > 0, F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd")).alias("day"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Hall "), F.col("l_linenumber").cast("string"))).alias("place"),
        F.when(F.col("l_quantity") < 10, "music").alias("kind"), (F.col("l_quantity") < 5).alias("stated"))


@query(f"""with {ROWS_SQL}, k as (select *, case when url is not null then 'u' || url else 't' || lower(title) end || '|' || coalesce(day, '') as key from rows)
select page, key, min(pos) as first_pos, count(*) as n, min_by(title, pos) as title, min_by(place, pos) filter (where place is not null) as place, coalesce(min_by(kind, pos) filter (where stated and kind is not null), min_by(kind, pos) filter (where kind is not null)) as kind
from k group by page, key""")
def same_page_rows(t: Tables) -> DataFrame:
    """Rows of one page that are one listing: by address and day where the row states its address, else by title and day; later readings fill what is missing."""
    return union.same_page(_rows(t))


@query(f"""with {ROWS_SQL}, d as (select *, row_number() over (partition by lower(title), day order by page, pos) as n from rows) select page, pos, title, day from d where n = 1""")
def cross_page_rows(t: Tables) -> DataFrame:
    """One row of each listing over all pages, the first one read."""
    first = F.min(F.struct("page", "pos", "title"))
    return _rows(t).groupBy(F.lower("title").alias("key"), "day").agg(first.alias("r")).select("r.*", "day")


@query(f"""with {ROWS_SQL} select page, pos, case when day is not null and place is not null then day || '~' || lower(place) || '~' || lower(title) when url is not null then url else 'row:' || page || ':' || pos end as ingest_key,
case when day is not null then 's' || page || '|' || lower(title) || '|' || day end as weak_key from rows""")
def ingest_keys(t: Tables) -> DataFrame:
    """The key a row is stored under, and its weak key, which is null where a part of it is."""
    rows = _rows(t)
    strong = F.coalesce(F.concat_ws("~", "day", text.hard_key(F.col("place")), text.hard_key(F.col("title"))).substr(F.lit(1), F.when(F.col("day").isNotNull() & F.col("place").isNotNull(), 1000)), F.col("url"), F.concat_ws(":", F.lit("row"), "page", "pos"))
    weak = F.concat(F.lit("s"), F.col("page").cast("string"), F.lit("|"), text.title_key(F.col("title")), F.lit("|"), F.col("day"))
    return rows.select("page", "pos", strong.alias("ingest_key"), weak.alias("weak_key"))


@query("""with i as (select upper(p_name) as name, p_brand as county, min(p_type) as kind from part where p_partkey % 3 = 0 group by 1, 2)
select p.p_partkey, i.kind from part p left join i on i.name = upper(p.p_name) and i.county = p.p_brand where p.p_partkey % 3 > 0""")
def permit_lookup(t: Tables) -> DataFrame:
    """The kind of the permit with a row's trade name and county."""
    index = t.part.where("p_partkey % 3 = 0").groupBy(F.upper("p_name").alias("name"), F.col("p_brand").alias("county")).agg(F.min("p_type").alias("kind"))
    rows = t.part.where("p_partkey % 3 > 0").select("p_partkey", F.upper("p_name").alias("name"), F.col("p_brand").alias("county"))
    return rows.join(index, ["name", "county"], "left").select("p_partkey", "kind")


@query("""with c as (select s_suppkey as id, lower(s_name) as name, 'https://n' || s_nationkey || '.example' as url from supplier where s_suppkey % 2 = 0), u as (select url, min(id) as id from c group by url having count(*) = 1),
r as (select s_suppkey as k, case when s_suppkey % 3 > 0 then lower(s_name) end as name, 'https://n' || s_nationkey || '.example' as url from supplier)
select r.k as s_suppkey, coalesce(c.id, u.id) as entry, case when c.id is not null then 'name' when u.id is not null then 'url' else 'none' end as how from r left join c on c.name = r.name left join u on u.url = r.url""")
def catalog_posture(t: Tables) -> DataFrame:
    """A source's entry in the catalog by name, else by address; an address of two entries matches none."""
    url = F.concat(F.lit("https://n"), F.col("s_nationkey").cast("string"), F.lit(".example"))
    entries = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("entry_name"), url.alias("entry_url"))
    by_url = entries.groupBy("entry_url").agg(F.min("id").alias("url_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.lower("s_name")).alias("name"), url.alias("url"))
    found = rows.join(entries.select("id", "entry_name"), F.col("name") == F.col("entry_name"), "left").join(by_url, F.col("url") == F.col("entry_url"), "left")
    return found.select("s_suppkey", F.coalesce("id", "url_id").alias("entry"), F.when(F.col("id").isNotNull(), "name").when(F.col("url_id").isNotNull(), "url").otherwise("none").alias("how"))


@query("""with h as (select page_id, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '')) as host from pages), c as (select distinct host from h where page_id % 4 = 0),
m as (select h.page_id, h.host, c.host as reg from h left join c on h.host = c.host or ends_with(h.host, '.' || c.host))
select page_id, case when count(reg) = 1 then min(reg) end as registration, case count(reg) when 0 then 'none' when 1 then 'one' else 'ambiguous' end as verdict from m group by page_id""")
def publisher_match(t: Tables) -> DataFrame:
    """The registration whose host is a door's host or a domain above it; two make it ambiguous."""
    rows = t.pages.select("page_id", text.host(F.col("url")).alias("host"))
    known = rows.where("page_id % 4 = 0").select(F.col("host").alias("registered")).distinct()
    labels = F.split("host", r"\.")
    above = rows.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("registered"))
    found = above.join(known, "registered").groupBy("page_id").agg(F.count("*").alias("n"), F.min("registered").alias("first"))
    joined = rows.select("page_id").join(found, "page_id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("page_id", F.when(n == 1, F.col("first")).alias("registration"), F.when(n == 0, "none").when(n == 1, "one").otherwise("ambiguous").alias("verdict"))


@query(f"""with {LISTINGS_SQL}, s as (select title, cast(start_time as date) as day from listings where event_id % 2 = 0 and start_time is not null), r as (select event_id, title, cast(start_time as date) as day from listings where event_id % 2 = 1)
select case when day is null then 'undated' else 'dated' end as lane, count(*) as n, count(*) filter (where case when day is null then exists(select 1 from s where s.title = r.title) else exists(select 1 from s where s.title = r.title and s.day = r.day) end) as held from r group by 1""")
def store_coverage(t: Tables) -> DataFrame:
    """Rows that the store holds: dated ones by title and day, undated ones by title alone, reported apart."""
    rows = t.listings().select("event_id", "title", F.to_date("start_time").alias("day"))
    store = rows.where("event_id % 2 = 0 and day is not null").select("title", "day").distinct().withColumn("by_day", F.lit(True))
    titles = store.select("title").distinct().withColumn("by_title", F.lit(True))
    found = rows.where("event_id % 2 = 1").join(store, ["title", "day"], "left").join(titles, "title", "left")
    held = F.when(F.col("day").isNull(), F.col("by_title")).otherwise(F.col("by_day"))
    return found.groupBy(F.when(F.col("day").isNull(), "undated").otherwise("dated").alias("lane")).agg(F.count("*").alias("n"), F.count_if(held).alias("held"))


UNION_SQL = """d as (select p_partkey as pos, p_size % 5 as desk, case when p_partkey % 6 > 0 then p_size end as night, p_brand as place, p_name as title, split_part(p_name, ' ', 2) as performer, p_type as kind, p_partkey % 3 = 0 as stated from part)"""


@query(f"""with {UNION_SQL}, n as (select pos, desk, night, lower(case when pos % 11 > 0 then place end) as place, title, case when pos % 7 > 0 then performer end as performer, kind, stated from d),
k as (select *, case when performer is not null then performer else max(performer) over (partition by night, place, title) end as by_title from n),
g as (select *, case when night is null or place is null then 'row:' || pos else night || '~' || place || '~' || coalesce('p:' || by_title, 't:' || title) end as grp from k)
select grp, count(*) as members, count(distinct desk) as desks, min(pos) as first_pos, min_by(title, pos) as title, count(distinct title) as titles, coalesce(min_by(kind, pos) filter (where stated), min_by(kind, pos)) as kind from g group by grp""")
def desk_union(t: Tables) -> DataFrame:
    """Rows of several desks as one happening: of one night, place and title or performer; the first desk owns the title, a stated kind beats a defaulted one."""
    rows = t.part.select(
        F.col("p_partkey").alias("pos"), (F.col("p_size") % 5).alias("desk"), F.when(F.col("p_partkey") % 6 > 0, F.col("p_size")).alias("night"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_brand")).alias("place"), F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 7 > 0, F.split_part("p_name", F.lit(" "), F.lit(2))).alias("performer"), F.col("p_type").alias("kind"), (F.col("p_partkey") % 3 == 0).alias("stated"))
    return union.desk_union(rows)
