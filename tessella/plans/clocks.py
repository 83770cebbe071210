"""Date and clock queries: what a text prints, what a calendar states, and the days of a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates
from ..operators import feed
from ..sources.tables import Tables

def order_key() -> Column:
    return F.col("o_orderkey")


def order_date() -> Column:
    return F.col("o_orderdate")


def _case(by: int, *options):  # noqa: ANN002, ANN202
    out = options[-1]
    for i, o in reversed(list(enumerate(options[:-1]))):
        out = F.when(order_key() % by == i, o).otherwise(out)
    return out


def _text(*parts):  # noqa: ANN002, ANN202
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def order_day() -> Column:
    return F.date_format(order_date(), "yyyy-MM-dd")


@query("""with o as (select o_orderkey as k, cast(o_orderdate as date) as d, month(o_orderdate) as m, day(o_orderdate) as n from orders),
v as (select *, case k % 6 when 0 then d when 1 then case when n > 12 or m = n then d end when 2 then case when n > 12 or m = n then d end end as value from o)
select k as o_orderkey, strftime(value, '%Y-%m-%d') as value, case when value is not null then null when k % 6 = 3 then 'no_text' when k % 6 in (1, 2) then 'ambiguous' when k % 6 = 4 then 'no_full_date' else 'unparseable' end as reason from v""")
def stated_dates(t: Tables) -> DataFrame:
    """The date that a claim proves, or why it proves none."""
    text = _case(6, _text("Doors on ", order_day(), " now"), _text("on ", F.date_format(order_date(), "M/d/yyyy")), _text("on ", F.date_format(order_date(), "d/M/yyyy")), F.lit(None).cast("string"), F.lit("soon"), F.lit("13/13/1998 or so"))
    found = dates.stated_date(text)
    return t.orders.select(order_key(), F.date_format(found["value"], "yyyy-MM-dd").alias("value"), found["reason"].alias("reason"))


@query("""with o as (select o_orderkey as k, cast(o_orderdate as date) as d from orders)
select k as o_orderkey, strftime(case k % 6 when 0 then date_trunc('quarter', d) + interval 3 month - interval 1 day when 1 then make_date(year(d), case when month(d) <= 6 then 7 else 1 end, 1)
  + to_years(case when month(d) <= 6 then 0 else 1 end) - interval 1 day when 2 then make_date(year(d), 12, 31) when 3 then last_day(d) end, '%Y-%m-%d') as due from o""")
def due_dates(t: Tables) -> DataFrame:
    """The last day of the period that a promise names."""
    text = _case(
        6, _text("due in Q", F.quarter(order_date()).cast("string"), F.date_format(order_date(), " yyyy")), _text("H", F.ceil(F.month(order_date()) / 6).cast("string"), F.date_format(order_date(), " yyyy")), _text("by the end of ", F.date_format(order_date(), "yyyy")),
        _text("by ", F.date_format(order_date(), "MMMM yyyy")), _text("in FY", F.date_format(order_date(), "yyyy"), " Q2 ", F.date_format(order_date(), "yyyy")), F.lit("in time"))
    return t.orders.select(order_key(), F.date_format(dates.due_date(text), "yyyy-MM-dd").alias("due"))


@query("""with o as (select o_orderkey as k, o_orderdate + interval 20 hour as w, ['America/Chicago', 'Europe/Paris', 'Mars/Base', null][cast(o_orderkey % 4 + 1 as integer)] as zone from orders)
select k as o_orderkey, case when k % 5 = 0 then strftime(w, '%Y-%m-%d') when k % 5 = 4 then null when k % 5 = 1 or k % 4 >= 2 then strftime(w, '%Y-%m-%dT%H:%M:%SZ')
  else strftime(timezone('UTC', timezone(zone, w)), '%Y-%m-%dT%H:%M:%SZ') end as stamp from o""")
def utc_stamps(t: Tables) -> DataFrame:
    """Calendar stamps in UTC: days stay days, an unknown zone counts as UTC."""
    at = order_date() + F.expr("interval 20 hours")
    zone = _case(4, F.lit("America/Chicago"), F.lit("Europe/Paris"), F.lit("Mars/Base"), F.lit(None).cast("string"))
    local = F.date_format(at, "yyyyMMdd'T'HHmmss")
    raw = _case(5, F.date_format(at, "yyyyMMdd"), _text(local, "Z"), local, local, F.lit("tomorrow"))
    return t.orders.select(order_key(), dates.utc_stamp(raw, zone).alias("stamp"))


@query("""with o as (select o_orderkey as k, o_orderdate + to_hours(cast(o_orderkey % 24 as integer)) as w from orders), n as (select k, case k % 5 when 0 then cast(w as date) when 1 then cast(w as date)
  when 2 then cast(timezone('America/Chicago', timezone('UTC', w)) as date) when 3 then cast(timezone('America/Chicago', timezone('UTC', w - interval 2 hour)) as date) end as night from o)
select k as o_orderkey, strftime(night, '%Y-%m-%d') as night, case when night is null then 'unreadable' end as reason from n""")
def stated_nights(t: Tables) -> DataFrame:
    """The night of a printed moment as its market sees it."""
    at = order_date() + F.make_dt_interval(hours=(order_key() % 24).cast("int"))
    naive = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    night = dates.stated_night(_case(5, F.date_format(at, "yyyy-MM-dd"), naive, _text(naive, "Z"), _text(naive, "+02:00"), F.lit("at dusk")), "America/Chicago")
    return t.orders.select(order_key(), F.date_format(night["night"], "yyyy-MM-dd").alias("night"), night["reason"].alias("reason"))


@query("""select o_orderkey, case when o_orderkey % 6 < 4 then strftime(o_orderdate, '%Y-%m-%d') end as day, case when o_orderkey % 6 in (0, 4) then (o_orderkey % 12) * 60 + 720 when o_orderkey % 6 = 2 then (o_orderkey % 24) * 60 + 5 end as minutes from orders""")
def printed_moments(t: Tables) -> DataFrame:
    """Day and clock as cards print them."""
    pm = F.concat(F.when(order_key() % 12 == 0, 12).otherwise(order_key() % 12).cast("string"), F.lit(" pm"))
    text = _case(
        6, _text(F.date_format(order_date(), "E, MMM d yyyy"), " at ", pm), _text("Opens ", F.date_format(order_date(), "MMMM d, yyyy")), _text(F.date_format(order_date(), "d MMMM yyyy"), ", ", F.format_string("%02d:05", order_key() % 24)), _text("from ", order_day(), "T20:00 on"),
        _text("doors ", pm), F.lit("every May"))
    return t.orders.select(order_key(), F.date_format(dates.printed_day(text), "yyyy-MM-dd").alias("day"), dates.printed_clock(text).cast("bigint").alias("minutes"))


CARRIERS_SQL = "carriers as (select o_custkey as page, cast(o_orderdate as date) as day, o_orderkey % 5 as carrier, o_orderkey as k from orders where o_orderkey % 6 = 0)"
#: How a page states a date, strongest first.
CARRIERS = (r'"startDate": ?"(\d{4}-\d\d-\d\d)', r'<time[^>]* datetime="(\d{4}-\d\d-\d\d)', r"(?:^|[^0-9\"])(\d{4}-\d\d-\d\d)(?:[^0-9]|$)", rf"((?:{dates.MONTHS}) \d{{1,2}}, \d{{4}})", rf"(\d{{1,2}} (?:{dates.MONTHS}) \d{{4}})")


def _pages(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderkey % 6 = 0")
    shown = _case(
        5, _text('<script type="application/ld+json">{"startDate": "', order_day(), '"}</script>'), _text('<time class="t" datetime="', order_day(), '">then</time>'), _text("<p>on ", order_day(), " at 8:30 pm</p>"),
        _text("<p>", F.date_format(order_date(), "MMMM d, yyyy"), "</p>"), _text("<p>", F.date_format(order_date(), "d MMMM yyyy"), "</p>"))
    return rows.groupBy(F.col("o_custkey").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(F.struct(order_key(), shown.alias("s"))))["s"], "\n").alias("html"))


def _page_dates(pages: DataFrame) -> DataFrame:
    """page, day and the rank of the strongest carrier of each date that the page states."""
    stated = lambda rank: lambda x: F.struct(F.lit(rank).alias("carrier"), x.alias("text"))
    found = F.array(*(F.transform(F.regexp_extract_all("html", F.lit(p), 1), stated(i)) for i, p in enumerate(CARRIERS)))
    rows = pages.select("page", F.explode(F.flatten(found)).alias("f")).select("page", dates.printed_day(F.col("f.text")).alias("day"), "f.carrier")
    return rows.where("day is not null").groupBy("page", "day").agg(F.min("carrier").alias("carrier"))


@query(f"with {CARRIERS_SQL} select page, strftime(day, '%Y-%m-%d') as day, min(carrier) as carrier from carriers group by page, day")
def same_page_dates(t: Tables) -> DataFrame:
    """Every date a page states, with its strongest carrier."""
    return _page_dates(_pages(t)).select("page", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("carrier").cast("bigint").alias("carrier"))


@query(f"""with {CARRIERS_SQL}, one as (select page, min(day) as day from carriers group by page having count(distinct day) = 1)
select c_custkey as page, case when day is null then 'no_single_date' else 'resolved' end as verdict, strftime(day + to_minutes(cast((c_custkey % 11 + 13) * 60 + 30 as integer)), '%Y-%m-%d %H:%M') as moment from customer left join one on page = c_custkey""")
def clocks_on_page(t: Tables) -> DataFrame:
    """A bare clock takes the date of its page, but only where the page states exactly one."""
    one = _page_dates(_pages(t)).groupBy("page").agg(F.min("day").alias("day"), F.count("*").alias("n")).where("n = 1")
    clock = F.concat((F.col("c_custkey") % 11 + 1).cast("string"), F.lit(":30 p.m. sharp"))
    rows = t.customer.select(F.col("c_custkey").alias("page"), clock.alias("clock")).join(one, "page", "left")
    moment = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=dates.printed_clock(F.col("clock")))
    return rows.select("page", F.when(F.col("day").isNull(), "no_single_date").otherwise("resolved").alias("verdict"), F.date_format(moment, "yyyy-MM-dd HH:mm").alias("moment"))


@query("""with e as (select *, cast(timezone('America/Chicago', timezone('UTC', ts)) as date) as day from events)
select cast(day - date '2024-01-05' as integer) as tab, count(*) as n, min(event_id) as first_id from e where day between date '2024-01-05' and date '2024-01-12' group by 1""")
def market_days(t: Tables) -> DataFrame:
    """Events by the day of a market's zone."""
    tabs = F.broadcast(feed.day_tabs(t.spark, "2024-01-05", zone="America/Chicago"))  # one row a day
    ts = F.col("ts").cast("timestamp_ntz")
    near = t.events.where((F.col("ts") >= "2024-01-04") & (F.col("ts") < "2024-01-15"))
    return near.join(tabs, (ts >= F.col("lo")) & (ts < F.col("hi"))).groupBy("tab").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""with e as (select user_id, ((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) // 1000000) / 86400.0 as days, event_type = 'purchase' as good from events where ts <= timestamp '2024-02-01')
select user_id, round(sum(case when good then exp(-days / 14) else 0 end), 6) as r, round(sum(case when good then 0 else exp(-days / 14) end), 6) as s from e group by user_id""")
def aged_evidence(t: Tables) -> DataFrame:
    """Supporting and opposing evidence of each source, faded by age."""
    days = F.timestamp_diff("SECOND", F.col("ts").cast("timestamp_ntz"), feed.at("2024-02-01")) / 86400.0
    weight, good = dates.aged(F.lit(1.0), days, 14.0), F.col("event_type") == "purchase"
    rows = t.events.where(F.col("ts") <= "2024-02-01").groupBy("user_id")
    return rows.agg(F.round(F.sum(F.when(good, weight).otherwise(0.0)), 6).alias("r"), F.round(F.sum(F.when(good, 0.0).otherwise(weight)), 6).alias("s"))


@query("""with o as (select o_orderkey as k, o_orderdate + to_seconds(o_orderkey % 90) as a, o_orderdate + to_seconds(o_orderkey * 7 % 120) as b from orders)
select k as o_orderkey, case when k % 9 <> 0 then date_trunc('minute', a) = date_trunc('minute', b) end as same from o""")
def same_minutes(t: Tables) -> DataFrame:
    a, b = order_date() + F.make_dt_interval(secs=(order_key() % 90).cast("double")), F.when(order_key() % 9 != 0, order_date() + F.make_dt_interval(secs=(order_key() * 7 % 120).cast("double")))
    return t.orders.select(order_key(), dates.same_minute(a, b).alias("same"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%a %b ') || day(o_orderdate) when o_orderkey % 3 = 1 then strftime(o_orderdate, '%a %b ') || day(o_orderdate) || ', ' || ((o_orderkey % 11) + 1) || ':30 PM' else 'Date to come' end as line from orders""")
def printed_lines(t: Tables) -> DataFrame:
    """The line that a share text prints: a day alone where no hour is known."""
    hour = order_date() + F.make_dt_interval(hours=(order_key() % 11 + 13).cast("int"), mins=F.lit(30))
    start = F.when(order_key() % 3 == 0, order_date()).when(order_key() % 3 == 1, hour)
    line = F.when(dates.precision(start) == "none", "Date to come").when(dates.precision(start) == "date", F.date_format(start, "E MMM d")).otherwise(F.date_format(start, "E MMM d, h:mm a"))
    return t.orders.select(order_key(), line.alias("line"))


@query("""with o as (select o_orderkey as k, cast(o_orderdate as date) as d, strftime(o_orderdate, '%b %-d') as md from orders),
y as (select k, d, case k % 8 when 0 then d when 1 then make_date(2024, month(d), day(d)) when 2 then make_date(2021, month(d), day(d)) when 3 then d when 4 then make_date(2026, month(d), day(d)) when 7 then make_date(2025, month(d), day(d)) end as said
  from o where not (month(d) = 2 and day(d) = 29)),
w as (select k, d, make_date(1998, month(d), day(d)) as this from o where not (month(d) = 2 and day(d) = 29))
select y.k as event, strftime(case y.k % 8 when 5 then case when w.this >= date '1998-08-02' - interval 14 day then w.this else make_date(1999, month(w.this), day(w.this)) end else said end, '%Y-%m-%d') as day from y join w on w.k = y.k
  where y.k % 8 not in (0, 3)""")
def translated_days(t: Tables) -> DataFrame:
    """The day that a text prints in one of many forms, its year from the text, else from the page, else the one near a date; none is no day."""
    k, day = order_key(), order_date()
    md = lambda f: F.date_format(day, f)
    text = _case(8, F.lit(""), _text(md("EEE"), " ", md("MMMM"), " ", md("d"), "th at 8pm"), _text(md("MMM"), ". ", md("d"), ", 2021 or 2023"), F.lit(""), _text(md("M"), "/", md("d"), "/26"), _text(md("d"), " ", md("MMM")), F.lit("soon"), _text("2025-", md("MM"), "-", md("dd"), "T20:00"))
    rows = t.orders.where("not (month(o_orderdate) = 2 and day(o_orderdate) = 29) and o_orderkey % 8 not in (0, 3)")
    found = dates.translated_when(text, F.lit("1998-08-02").cast("date"), F.when(k % 8 == 1, "season 2024/2025"))
    return rows.select(k.alias("event"), F.date_format(found, "yyyy-MM-dd").alias("day"))


@query("""with o as (select o_orderkey as k, cast(o_orderdate as date) as d from orders where o_orderkey % 3 = 0 and not (month(o_orderdate) = 2 and day(o_orderdate) >= 28)),
n as (select k, cast(d as date) as night, 0 as nth from o union all select k, cast(d + interval 1 day as date), 1 from o),
y as (select k, nth, strftime(night, '%a') as said, make_date(2027, month(night), day(night)) as day from n)
select k as event, strftime(day, '%Y-%m-%d') as day, case when nth = 0 then 1200 when k % 2 = 0 then 1170 end as start, case when nth = 1 and k % 2 = 0 then 1320 end as stop from y where strftime(day, '%a') = said""")
def house_nights(t: Tables) -> DataFrame:
    """The nights that a card prints, each with the clock near it; the year is the card's own, or that of its page in which the weekday is right."""
    k, day, nxt = order_key(), order_date(), F.date_add(order_date(), 1)
    shown = lambda d: F.date_format(d, "EEEE, MMM d")
    card = _text(shown(day), " 8pm with guests and friends, ", shown(nxt), F.when(k % 2 == 0, " 7:30-10 p.m.").otherwise(" late"))
    rows = t.orders.where("not (month(o_orderdate) = 2 and day(o_orderdate) >= 28)")
    head = _text("<title>Season 2027</title><h2>x</h2>")
    nights = dates.house_nights(card, head, F.lit("1998-08-02").cast("date"))
    return rows.where("o_orderkey % 3 = 0").select(k.alias("event"), F.explode(nights).alias("n")).select("event", F.date_format("n.day", "yyyy-MM-dd").alias("day"), "n.start", "n.stop")
