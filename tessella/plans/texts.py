"""Text, URL, date and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates, text
from ..operators import sensors
from ..sources.tables import Tables

RULES = [("ring", "jewelry"), ("widget", "gadgets"), ("bolt", "hardware"), ("red", "color"), ("small", "size")]
RULES_SQL = "case " + " ".join(f"when contains(lower(p_name), '{k}') then '{v}'" for k, v in RULES) + " else 'unmapped' end"
HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"
HEAD_SQL = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
PATH_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _any(phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join("contains(low, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


RESIDUAL_SQL = "low"
for _p in sensors.BOILERPLATE:
    RESIDUAL_SQL = f"replace({RESIDUAL_SQL}, '{_p}', ' ')"
GARBLED_SQL = " + ".join(f"(size - length(replace(body, '{m}', ''))) / {len(m)}" for m in sensors.MOJIBAKE)


@query(f"""with b as (select doc_id, text, trim(text) as body from documents), n as (select *, lower(body) as low, length(body) as size from b)
select doc_id, case when text is null then 'null_text' when body = '' then 'empty'
  when size - length(regexp_replace(body, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) > size * 0.05 then 'control' when size < 40 then 'short'
  when {_any(sensors.ERROR_PAGE)} then 'error_page' when {_any(sensors.INJECTION)} then 'injection' when {GARBLED_SQL} > size * 0.005 then 'mojibake'
  when {_any(sensors.BOILERPLATE)} and length(trim(regexp_replace({RESIDUAL_SQL}, '\\s+', ' ', 'g'))) < 40 then 'boilerplate'
  when size >= 160 and not regexp_matches(right(body, 1), '[.!?)\\]}}>"''”’]') then 'truncated' else 'ok' end as verdict from n""")
def sensor_report(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sensors.input_verdict(F.col("text")).alias("verdict"))


@query("""with p as (select l.quality = 1 as good, length(text) >= 400 and text not like '%|%' and text not like '%!!%' and text not like '%\\%\\%\\%%' escape '\\' as ok from documents d join labels l using (doc_id)),
c as (select count(*) filter (where ok and good) as tp, count(*) filter (where ok and not good) as fp, count(*) filter (where not ok and good) as fn, count(*) filter (where not ok and not good) as tn from p),
m as (select *, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 1.0 else tp / (tp + fn) end as r from c)
select tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 4) as f1 from m""")
def scorer_micro(t: Tables) -> DataFrame:
    """A simple length and junk rule held against the quality labels."""
    rows = t.documents.join(t.labels, "doc_id")
    clean = ~(F.contains("text", F.lit("|")) | F.contains("text", F.lit("!!")) | F.contains("text", F.lit("%%%")))
    return sensors.scores(rows, (F.length("text") >= 400) & clean, F.col("quality") == 1)


@query(f"""select page_id, {HOST_SQL} as host, lower({HEAD_SQL}) || substr(url, length({HEAD_SQL}) + 1) as normal, {PATH_SQL} as path,
case when not regexp_matches(trim(url), '(?i)^https?://[^/?#]+') then 'refused' when regexp_matches(trim(url), '(?i)^https?://[^/?#]+/?$') then 'door' else 'page' end as kind from pages""")
def url_normalize(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", text.host(url).alias("host"), text.normal_url(url).alias("normal"), text.url_path(url).alias("path"), text.address_kind(url).alias("kind"))


@query(f"""with h as (select array_to_string(list_slice(string_split({HOST_SQL}, '.'), -2, -1), '.') as domain, nullif(regexp_extract({PATH_SQL}, '^/(?:en|de|fr|es)/([^/]+)', 1), '') as segment from pages)
select domain, count(*) as n, count(segment) as with_segment, count(*) filter (where regexp_matches(segment, '^[0-9]+$')) as numeric from h group by domain""")
def domain_report(t: Tables) -> DataFrame:
    rows = t.pages.select(text.registrable(F.col("url")).alias("domain"), F.nullif(F.regexp_extract(text.url_path(F.col("url")), "^/(?:en|de|fr|es)/([^/]+)", 1), F.lit("")).alias("segment"))
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.count("segment").alias("with_segment"), F.count_if(F.col("segment").rlike("^[0-9]+$")).alias("numeric"))


@query(f"""with a as (select page_id, {HOST_SQL} as own, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages),
k as (select page_id, case when trim(href) = '' or starts_with(lower(trim(href)), '#') then 'fragment' when regexp_matches(lower(trim(href)), '^(mailto|tel|javascript|data):') then 'not_a_page'
  when regexp_matches(lower(trim(href)), '\\.(jpg|jpeg|png|gif|svg|pdf|zip|css|js|ico)([?#]|$)') then 'not_a_page' when regexp_matches(lower(trim(href)), '/(login|signin|sign-in|account|register)([/?#]|$)') then 'login'
  when regexp_matches(lower(trim(href)), '^[a-z][a-z0-9+.-]*://') and {HOST_SQL.replace('(url', '(lower(trim(href))')} <> own then 'off_site' else 'follow' end as kind from a)
select page_id, kind, count(*) as n from k group by page_id, kind""")
def link_candidates(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", text.host(F.col("url")).alias("own"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("page_id", text.link_kind(F.col("href"), F.col("own")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"select p_partkey, {RULES_SQL} as label from part")
def title_category(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.first_label(F.col("p_name"), RULES).alias("label"))


@query("""select p_type, upper(p_type) as provider, case when p_type in ('PROMO', 'STANDARD') then lower(p_type) when contains(lower(min(p_name)), 'ring') then 'jewelry' else 'unmapped' end as resolved,
case when p_type in ('PROMO', 'STANDARD') then 'provider' when contains(lower(min(p_name)), 'ring') then 'title' else 'none' end as signal from part group by p_type""")
def category_ladder(t: Tables) -> DataFrame:
    """The first signal that knows a category decides, and is named."""
    by_provider = F.when(F.col("p_type").isin("PROMO", "STANDARD"), F.lower("p_type"))
    by_title = F.when(F.contains(F.lower("title"), F.lit("ring")), F.lit("jewelry"))
    rows = t.part.groupBy("p_type").agg(F.min("p_name").alias("title"))
    signal = F.when(by_provider.isNotNull(), "provider").when(by_title.isNotNull(), "title").otherwise("none")
    return rows.select("p_type", F.upper("p_type").alias("provider"), F.coalesce(by_provider, by_title, F.lit("unmapped")).alias("resolved"), signal.alias("signal"))


@query("""select p_partkey, trim(regexp_replace(lower('The ' || p_name || ' & ' || p_type), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g')) as title_key,
regexp_replace(trim(regexp_replace(replace(lower('The ' || p_name || '''s ' || p_type), '''', ''), '[^a-z0-9]+', ' ', 'g')), '^the ', '') as hard_key,
trim(regexp_replace(lower(p_name || ' feat. ' || p_brand), '\\s+(w/|with |feat\\.? |featuring |ft\\.? ).*$', '')) as performer from part""")
def comparison_keys(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", text.title_key(F.concat(F.lit("The "), "p_name", F.lit(" & "), "p_type")).alias("title_key"),
        text.hard_key(F.concat(F.lit("The "), "p_name", F.lit("'s "), "p_type")).alias("hard_key"), text.performer_key(F.concat("p_name", F.lit(" feat. "), "p_brand")).alias("performer"),
    )


@query("""with p as (select doc_id, regexp_extract(text, '(?:^|[^0-9])\\(?([2-9][0-9]{2})\\)?[ .-]?([2-9][0-9]{2})[ .-]?([0-9]{4})(?:[^0-9]|$)', ['a', 'b', 'c']) as m from documents)
select doc_id, m.a || '-' || m.b || '-' || m.c as phone from p where m.a <> ''""")
def phones(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.phone(F.col("text")).alias("phone")).where("phone is not null")


@query("""select page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', ' ', 'g'),
'(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|table|article|section|nav|footer|title)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ')) as n_chars from pages""")
def page_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(text.plain_text(F.col("html"))).alias("n_chars"))


@query("""with d as (select event_id, ts, cast((ts at time zone 'UTC') at time zone 'America/Chicago' as date) as night from events)
select strftime(night, '%Y-%m-%d') as night, count(*) as n, count(*) filter (where hour(ts) = 0 and minute(ts) = 0 and second(ts) = 0) as date_only from d group by 1""")
def local_nights(t: Tables) -> DataFrame:
    rows = t.events.select(dates.local_night(F.col("ts").cast("timestamp"), "America/Chicago").alias("d"), dates.precision(F.col("ts")).alias("p"))
    return rows.groupBy(F.date_format("d", "yyyy-MM-dd").alias("night")).agg(F.count("*").alias("n"), F.count_if(F.col("p") == "date").alias("date_only"))


@query("""with o as (select distinct cast(o_orderdate as date) as day from orders)
select strftime(day, '%Y-%m-%d') as day, strftime(day + cast(5 - isodow(day) as integer), '%Y-%m-%d') as friday, strftime(day + cast(7 - isodow(day) as integer), '%Y-%m-%d') as sunday from o""")
def weekend_bounds(t: Tables) -> DataFrame:
    day = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    bounds = dates.weekend(F.col("day"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    return day.select(show("day").alias("day"), show(bounds["friday"]).alias("friday"), show(bounds["sunday"]).alias("sunday"))


@query("""with k as (select distinct month(o_orderdate) as m, day(o_orderdate) as d, isodow(o_orderdate) as w from orders),
c as (select m, d, w, try_cast(y || '-' || lpad(cast(m as varchar), 2, '0') || '-' || lpad(cast(d as varchar), 2, '0') as date) as day from k, range(1997, 2000) r(y)),
f as (select m, d, w, day from c where day is not null and day between date '1998-06-01' - 7 and date '1998-06-01' + 365 and isodow(day) = w)
select k.m, k.d, k.w, case when count(day) = 1 then strftime(min(day), '%Y-%m-%d') end as pinned from k left join f on k.m = f.m and k.d = f.d and k.w = f.w group by k.m, k.d, k.w""")
def pinned_years(t: Tables) -> DataFrame:
    """The year of a printed month, day and weekday, where only one fits the coming year."""
    keys = t.orders.select(F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"), (F.weekday("o_orderdate") + 1).alias("w")).distinct()
    pinned = dates.pinned_year(F.col("m"), F.col("d"), F.col("w"), F.lit("1998-06-01").cast("date"))
    return keys.select("m", "d", "w", F.date_format(pinned, "yyyy-MM-dd").alias("pinned"))
