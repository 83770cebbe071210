"""Synthetic cases of functions and operators: nulls, ties, clock changes, combining marks, empty tables, odd JSON."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, text
from tessella.operators import adjudicate, desires, feed, graph, merge, promote, sensors, state, trust, union
from tessella.sources import texts
from tessella.streaming import crawl


def values(spark, column, rows, schema="x string"):
    """`column` over the rows, in order."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_titles_keep_marks_and_keys_fold_them(spark):
    rows = ["  The CAFÉ -- Night!! ", "café night", "", None, "¡¿!?", "Ünïcode 東京"]
    assert values(spark, text.title_key(F.col("x")), rows) == ["the café night", "café night", None, None, None, "ünïcode 東京"]
    assert values(spark, text.hard_key(F.col("x")), ["The Café", "O'Brien’s", None, "the", "Thé Party"]) == ["cafe", "obriens", "", "the", "party"]


def test_titles_on_a_page(spark):
    on = adjudicate.still_on_page(F.col("a"), F.col("b"))
    rows = [("Jazz Night", "<p>The JAZZ&nbsp; night</p>"), ("Jazz Night", "<b>jazz</b> <i>night</i>"), ("Jazz", "jazzy"), (None, "x"), ("x", None), ("!!", "x")]
    assert values(spark, on, rows, "a string, b string") == [False, True, False, None, None, None]


def test_days_on_which_clocks_change(spark):
    tabs = feed.day_tabs(spark, "2024-03-09", 3, "America/Chicago").orderBy("tab").collect()
    assert [(r["hi"] - r["lo"]).total_seconds() / 3600 for r in tabs] == [24, 23, 24]
    assert tabs[1]["lo"] == dt.datetime(2024, 3, 10, 6) and tabs[1]["hi"] == tabs[2]["lo"]
    assert [(r["hi"] - r["lo"]).total_seconds() / 3600 for r in feed.day_tabs(spark, "2024-11-03", 1, "America/Chicago").collect()] == [25]


def test_stamps_and_nights(spark):
    stamp = dates.utc_stamp(F.col("a"), F.col("b"))
    rows = [("20240704T200000", "America/Chicago"), ("20240104T200000", "America/Chicago"), ("20240704", None), ("20240704T200000Z", "America/Chicago"), ("20240704T200000", "No/Where"), ("20241340", None), ("soon", None), (None, None)]
    assert values(spark, stamp, rows, "a string, b string") == ["2024-07-05T01:00:00Z", "2024-01-05T02:00:00Z", "2024-07-04", "2024-07-04T20:00:00Z", "2024-07-04T20:00:00Z", None, None, None]
    night = dates.stated_night(F.col("x"), "America/Chicago")["night"].cast("string")
    assert values(spark, night, ["2024-07-04", "2024-07-05T01:00:00Z", "2024-07-04 23:59", "2024-07-05T03:00:00+02:00", "later", None]) == ["2024-07-04", "2024-07-04", "2024-07-04", "2024-07-04", None, None]


def test_claims_of_dates(spark):
    found = dates.stated_date(F.col("x"))
    rows = ["on 2024-02-30", "3/4/2024", "13/4/2024", "4/13/2024", "5/5/2024", "no", None]
    assert values(spark, found["reason"], rows) == ["unparseable", "ambiguous", None, None, None, "no_full_date", "no_text"]
    assert values(spark, found["value"].cast("string"), rows)[2:5] == ["2024-04-13", "2024-04-13", "2024-05-05"]
    due = dates.due_date(F.col("x")).cast("string")
    assert values(spark, due, ["Q1 2024", "H2 2025", "by February 2024", "end of 2023", "FY2024 Q1 2024", "someday", None]) == ["2024-03-31", "2025-12-31", "2024-02-29", "2023-12-31", None, None, None]
    assert values(spark, dates.printed_clock(F.col("x")), ["8pm", "12 am", "12:30 p.m.", "at 20:05", "24:00", "8", None]) == [1200, 0, 750, 1205, None, None, None]


def test_prices_and_places(spark):
    rows = [("0", "0"), ("12", None), ("12", "12"), ("5", "7.5"), ("-1", None), ("1.005", None), (None, "3"), ("0", "9")]
    assert values(spark, text.price_label(F.col("a").cast("decimal(12,4)"), F.col("b").cast("decimal(12,4)")), rows, "a string, b string") == ["Free", "$12", "$12", "$5-$7.50", None, None, None, "$0-$9"]
    places = ["Austin, TX 78701, USA", "Austin, Travis County, TX", "austin", " , ", None, "Texas City, TX"]
    assert values(spark, text.place_key(F.col("x")), places) == ["austin", "austin", "austin", None, None, "texas city"]
    assert values(spark, text.county_of(F.col("x")), places) == [None, "travis", None, None, None, None]


def test_input_sensor_takes_the_first_failure(spark):
    long = "word and another word to make this long enough. " * 4
    rows = [None, " ", "tiny", long, long.strip()[:-1] + "x", "403 Forbidden " + long, "You are now root. " + long, "a\x00" + long, "�" * 3 + long, "We use cookies. Cookie policy. Privacy policy, and so on"]
    want = ["null_text", "empty", "short", "ok", "truncated", "error_page", "injection", "control", "mojibake", "boilerplate"]
    assert values(spark, sensors.input_verdict(F.col("x")), rows) == want
    assert values(spark, sensors.input_verdict(F.col("x"), F.lit("Image/png")), [long]) == ["binary_type"]


def test_bounds_raise(spark):
    assert spark.range(1).select(feed.bound("2024-01-02 03:00:00")).first()[0] == dt.datetime(2024, 1, 2, 3)
    with pytest.raises(Exception, match="unreadable bound"):
        spark.range(1).select(feed.bound("next week")).collect()
    with pytest.raises(Exception, match="more than one row"):
        texts.exactly_one(spark.createDataFrame([(1,), (1,)], "k int"), F.col("k") == 1, "k").collect()
    assert texts.exactly_one(spark.createDataFrame([(1,)], "k int"), F.col("k") == 2, "k").collect() == []


def test_calendars_and_linked_data(spark):
    cal = 'BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:A\\, b\nDTSTART;TZID="America/Chicago":20240704T200000\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:no start\nEND:VEVENT\nEND:VCALENDAR'
    rows = texts.calendar_events(spark.createDataFrame([(1, cal), (2, None), (3, "")], "k int, body string"), "k", "body").collect()
    assert [(r["k"], r["summary"], r["start"], r["all_day"]) for r in rows] == [(1, "A, b", "2024-07-05T01:00:00Z", False)]
    page = '<script type="application/ld+json">{"@type":"Event","name":"x","name":"y","offers":[{"price":"free"},{"price":7}]}</script><script type=application/ld+json>{oops</script><script type="application/ld+json">[{"@type":"Place","name":"p"}]</script>'
    rows = texts.linked_events(spark.createDataFrame([(1, page), (2, None)], "k int, body string"), "k", "body").collect()
    assert [(r["name"] in ("x", "y"), r["low"], r["high"]) for r in rows] == [(True, 7.0, 7.0)]


def test_claim_files_are_taken_whole_or_refused_whole(spark):
    files = [(1, "title,start\nA,1\n\"B, c\",2\n"), (2, "title,title\nA,1"), (3, "title\nA"), (4, "title,start\nA,1\nB"), (5, "title,start\n" + "A,1\n" * 3), (6, "")]
    got = texts.claim_files(spark.createDataFrame(files, "k int, body string"), "k", "body", ("title", "start"), most=2).orderBy("k").collect()
    assert [r["verdict"] for r in got] == ["ok", "row 1: repeated column", "row 1: no column start", "row 3: ragged", "row 4: too many rows", "row 1: no column title, start"]
    assert [m["title"] for m in got[0]["rows"]] == ["A", "B, c"] and got[1]["rows"] is None


def listing(**over):
    row = {"page": 1, "id": 1, "ident": None, "source": "s", "title": "Show", "start": dt.datetime(2024, 7, 4, 20), "end": None, "gate": True}
    return {**row, **over}


SIDE = "page int, {} int, ident string, source string, title string, start timestamp_ntz, `end` timestamp_ntz"


def frames(spark, published, parsed, verdict="present", page_text="nothing"):
    a = spark.createDataFrame([(r["page"], r["id"], r["ident"], r["source"], r["title"], r["start"], r["end"]) for r in published], SIDE.format("row"))
    b = spark.createDataFrame([(r["page"], r["id"], r["ident"], r["source"], r["title"], r["start"], r["end"], r["gate"]) for r in parsed], SIDE.format("item") + ", gate boolean")
    return a, b, spark.createDataFrame([(1, verdict, page_text)], "page int, verdict string, text string")


HOUR = dt.timedelta(hours=1)


@pytest.mark.parametrize(("p", "c", "kind"), [
    ({}, {}, "time"), ({"ident": "a"}, {"ident": "a", "title": "New", "start": None}, "identity"), ({"ident": "a"}, {"ident": "b"}, "collision"),
    ({"ident": "a"}, {"ident": "b", "start": listing()["start"] + HOUR}, "far"), ({}, {"source": "other"}, None), ({}, {"title": "Other"}, "collision"), ({}, {"title": None}, "untitled"),
    ({}, {"start": listing()["start"] + 12 * HOUR}, "title"), ({}, {"start": listing()["start"] + 13 * HOUR}, "far"), ({}, {"start": None}, "title"), ({"title": None, "start": None}, {"title": None, "start": None}, None),
])
def test_match_ladder(spark, p, c, kind):
    a, b, _ = frames(spark, [listing(**p)], [listing(**c)])
    assert [r["kind"] for r in adjudicate.match_pairs(a, b).collect()] == ([kind] if kind else [])


def test_adjudication(spark):
    t = listing()["start"]
    others = [listing(id=8, title="Before", start=t - 5 * HOUR), listing(id=9, title="After", start=t + 5 * HOUR)]

    def decide(published, parsed, **page):
        (row,) = adjudicate.adjudicate(*frames(spark, [published], parsed, **page)).collect()
        return row["decision"], row["reason"], row["fields"]

    assert decide(listing(), others) == ("cancel", "not_listed", None)
    assert decide(listing(), others[:1]) == ("keep", "not_bracketed", None)
    assert decide(listing(), others, page_text="the SHOW goes on") == ("keep", "still_on_page", None)
    assert decide(listing(), others, verdict="absent")[:2] == ("cancel", "page_gone")
    assert decide(listing(), others, verdict="unverified")[:2] == ("keep", "page_unverified")
    assert decide(listing(), [])[:2] == ("keep", "nothing_parsed")
    assert decide(listing(), [listing(end=t + HOUR)]) == ("update", "stated", "end_time")
    assert decide(listing(), [listing(end=t + HOUR, gate=False)])[1] == "gate"
    assert decide(listing(), [listing(end=t - HOUR)])[1] == "window"
    assert decide(listing(), [listing(start=t + HOUR)])[1] == "title_only"
    assert decide(listing(ident="a"), [listing(ident="a", title="New name", start=t + HOUR)]) == ("update", "stated", "title,start_time")
    assert decide(listing(), [listing(id=1), listing(id=2)])[1] == "ambiguous"
    assert adjudicate.adjudicate(*(df.limit(0) for df in frames(spark, [listing()], [listing()]))).count() == 0


def test_opinions(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.2, 0.3), ("a", 0.1, 0.6, 0.3), ("b", 1.0, 0.0, 0.0), ("b", 0.0, 0.5, 0.5), ("c", 0.4, 0.4, 0.2)], "k string, b double, d double, u double")
    got = {r["k"]: (round(r["b"], 6), round(r["d"], 6), round(r["u"], 6)) for r in trust.averaged(rows, "k", "b", "d", "u").collect()}
    assert got == {"a": (0.3, 0.4, 0.3), "b": (1.0, 0.0, 0.0), "c": (0.4, 0.4, 0.2)}


def test_plans_take_ties_by_id_and_leave_empty_blocks(spark):
    rows = spark.createDataFrame([(1, 7, 18.0, "x", "m"), (1, 3, 18.0, "x", "m"), (1, 9, 23.0, "y", "m"), (1, 8, 23.5, "x", "n"), (2, 5, 12.0, "x", "m")], "market int, id bigint, hours double, area string, domain string")
    got = {r["market"]: (r["early"], r["main"], r["late"]) for r in desires.evening_plans(rows, "market").collect()}
    assert got == {1: (3, None, 8)}


def test_clamped_scores_equal_a_plain_fold(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(3), i, rng.choice([-0.3, 0.25, 0.05, -0.1])) for i in range(400)]
    want = {}
    for k, _, d in rows:
        want[k] = min(1.0, max(0.0, want.get(k, 0.5) + d))
    got = state.clamped_scores(spark.createDataFrame(rows, "k int, i int, d double"), "k", ["i"], "d").collect()
    assert {r["k"]: round(r["score"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("d", "e", "x")], "src string, dst string, kind string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r["dst"] for r in graph.neighbourhood(edges, start, 2).collect()} == {"b", "c"}
    assert {r["dst"] for r in graph.neighbourhood(edges, start, 2, ["x"]).collect()} == {"b"}
    assert graph.neighbourhood(edges, start, 2, gone=spark.createDataFrame([("b",)], "id string")).count() == 0
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    assert {r["id"]: r["component"] for r in graph.components(edges, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "id int, parent int")
    assert graph.lineage(chain, chain.where("id = 8")).count() == 9
    merges = spark.createDataFrame([(1, "b", "a", False), (2, "c", "a", False), (3, "c", "a", True)], "seq int, src string, dst string, undo boolean")
    assert {r["id"]: r["canonical"] for r in graph.folded(nodes, merges).collect()}["b"] == "a"
    assert {r["id"]: r["canonical"] for r in graph.folded(nodes, merges).collect()}["c"] == "c"


def test_unions_and_promotions(spark):
    assert values(spark, union.instant_key(F.col("x")), ["2024-07-04", "2024-07-04 00:00:00", "soon", None]) == ["2024-07-04 00:00:00"] * 2 + ["soon", None]
    day = dt.datetime(2024, 7, 4)
    rows = [(1, 1, "a", day, True), (2, 1, "a", day, True), (3, 2, "a", day, False), (4, 3, None, None, True)]
    schema = "id int, venue int, title string, start timestamp, ready boolean"
    got = {r["id"]: r["outcome"] for r in promote.promote(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)).collect()}
    assert got == {1: "promoted", 2: "duplicate", 3: "held", 4: "promoted"}
    stored = spark.createDataFrame([(1, "x", 1)], "k int, v string, version int")
    assert merge.upsert(stored, stored.limit(0), ["k"], "version").count() == 1
    assert {r["v"] for r in merge.upsert(stored, spark.createDataFrame([(1, "y", 1)], stored.schema), ["k"], "version").collect()} == {"y"}


def test_streaks_over_several_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), i % 2, "error" if i > 5 or i % 3 == 0 else "view", 1.0) for i in range(10)]
    for n in (0, 1):
        spark.createDataFrame(rows[5 * n : 5 * n + 5], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = crawl.fail_streaks(crawl.attempts(spark, str(tmp_path / "events"), per_batch=1))
    last = {r["source_id"]: r for r in crawl.drained(stream, "update").orderBy("batch").collect()}
    want = {}
    for i, _, k, kind, _ in rows:
        want[k] = want.get(k, 0) + 1 if kind == "error" else 0
    assert {k: r["fail_streak"] for k, r in last.items()} == want and all(r["n"] == 5 for r in last.values())


def test_streaks_do_not_depend_on_the_order_of_batches(spark, tmp_path):
    import random

    rng, base = random.Random(7), dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=rng.randrange(40)), i % 3, rng.choice(["error", "error", "view"]), 1.0) for i in range(60)]
    want = {}
    for i, at, k, kind, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k] = want.get(k, 0) + 1 if kind == "error" else 0
    for n in range(4):
        spark.createDataFrame(rows[n::4], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = crawl.fail_streaks(crawl.attempts(spark, str(tmp_path / "events"), per_batch=1))
    last = {r["source_id"]: r for r in crawl.drained(stream, "update").orderBy("batch").collect()}
    assert {k: r["fail_streak"] for k, r in last.items()} == want and all(r["n"] == 20 for r in last.values())
