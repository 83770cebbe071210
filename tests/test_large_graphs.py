"""Components, chains, walks, folds, versions and what outcomes teach, against plain code."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, text
from tessella.operators import chains, folds, merge, union
from tessella.sources import texts
from tessella.sources.versions import Conflict, Versions
from tessella.streaming import crawl, learning


def brute_components(edges, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in low and b in low and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    nodes = list(range(300))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(180)] + [(5, 5), (7, 8), (8, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "src int, dst int")
    got = {r["id"]: r["component"] for r in chains.components(df, spark.createDataFrame([(n,) for n in nodes], "id int")).collect()}
    assert got == brute_components(edges, nodes)
    assert chains.components(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([("a",)], "id string")).collect()[0]["component"] == "a"


def test_a_long_chain_takes_few_rounds(spark):
    rng = random.Random(2)
    order = list(range(10_000))
    rng.shuffle(order)
    df = spark.createDataFrame(list(itertools.pairwise(order)), "src int, dst int")
    found = chains.components(df, spark.range(10_000)).agg(F.min("component"), F.max("component"), F.count("*")).first()
    assert tuple(found) == (0, 0, 10_000) and chains.components.rounds < 20


def test_a_crowd_around_one_node(spark):
    df = spark.range(1, 30_000).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    assert chains.components(df, spark.range(30_000)).where("component <> 0").count() == 0
    assert chains.components.rounds <= 3


def brute_trace(parents, start, most=10**9):
    out = []
    for s in start:
        at, seen = s, []
        while at is not None and at not in seen and len(seen) < most:
            seen.append(at)
            at = parents.get(at)
        out += [(s, a, k) for k, a in enumerate(seen)]
    return sorted(out)


def test_chains_and_circles(spark):
    rng = random.Random(3)
    parents = {n: (rng.choice([None, *range(120)]) if rng.random() < 0.3 else n + 1) for n in range(120)}
    parents |= {200: 201, 201: 202, 202: 200, 210: 200, 220: 220}
    df = spark.createDataFrame(list(parents.items()), "id int, parent int")
    start = list(range(0, 120, 3)) + [200, 210, 220, 999]
    one = spark.createDataFrame([(s,) for s in start], "id int")
    assert sorted(tuple(r) for r in chains.trace(df, one).collect()) == brute_trace(parents, start)
    assert sorted(tuple(r) for r in chains.trace(df, one, 5).collect()) == brute_trace(parents, start, 5)


WALKS = [
    # door, pages (url, next, status, last, control), reason, number of pages
    ("ends", [("a1", "a2", 200, False, False), ("a2", None, None, False, False)], "no_next_link", 2),
    ("button", [("b1", None, 200, None, True)], "next_control_not_a_link", 1),
    ("told", [("c1", "c2", 200, True, False), ("c2", None, 200, False, False)], "desk_last_page", 1),
    ("wall", [("d1", "d2", 200, False, False), ("d2", "d3", 403, False, False), ("d3", None, 200, False, False)], "wall", 2),
    ("broken", [("e1", "e2", 200, False, False), ("e2", "e3", 500, False, False)], "fetch_error", 2),
    ("unknown", [("f1", "f2", 200, False, False)], "fetch_error", 2),
    ("circle", [("g1", "g2", 200, False, False), ("g2", "g3", 200, False, False), ("g3", "g2", 200, False, False)], "cycle", 3),
    ("long", [(f"h{i}", f"h{i + 1}", 200, False, False) for i in range(1, 30)], "max_pages", 9),
]


def test_every_reason_to_stop(spark):
    pages = spark.createDataFrame([p for _, ps, *_ in WALKS for p in ps], "url string, next string, status int, last boolean, control boolean")
    doors = spark.createDataFrame([(d, ps[0][0]) for d, ps, *_ in WALKS], "door string, start string")
    rows, stops = chains.walks(pages, doors, most=9)
    assert {r["door"]: (r["reason"], r["pages"]) for r in stops.collect()} == {d: (why, n) for d, _, why, n in WALKS}
    assert [r["url"] for r in rows.where("door = 'circle'").orderBy("step").collect()] == ["g1", "g2", "g3"]


# folds ------------------------------------------------------------------------------

ENTITIES = [(x, f"name {x}", [f"alias {x}"], ["doc 1", f"doc {x}"]) for x in "abcdef"]


def folded(spark, log):
    e = spark.createDataFrame(ENTITIES, "id string, name string, aliases array<string>, sources array<string>")
    rows = spark.createDataFrame([(k, op, c, o, why, 0.9) for k, (op, c, o, why) in enumerate(log)], "seq bigint, op string, canonical string, others array<string>, rationale string, confidence double")
    state, told = folds.fold_log(e, rows)
    return {r["id"]: r for r in state.collect()}, [r["outcome"] for r in told.orderBy("seq").collect()]


def test_a_fold_keeps_everything_and_an_undo_restores_it(spark):
    state, told = folded(spark, [("fold", "a", ["b", "c"], "same"), ("fold", "d", ["a"], "same")])
    assert told == ["folded", "folded"]
    assert state["a"]["aliases"] == ["alias a", "name b", "alias b", "name c", "alias c"] and state["a"]["sources"] == ["doc 1", "doc a", "doc b", "doc c"]
    assert state["d"]["aliases"] == ["alias d", "name a", *state["a"]["aliases"]] and (state["a"]["superseded_by"], state["b"]["superseded_by"]) == ("d", "a")
    state, told = folded(spark, [("fold", "a", ["b"], "same"), ("undo", "a", None, None), ("undo", "a", None, None)])
    assert told == ["folded", "undone", "refused: nothing to undo"]
    assert all((r["aliases"], r["sources"], r["superseded_by"], r["rationale"]) == ([f"alias {i}"], ["doc 1", f"doc {i}"], None, None) for i, r in state.items())


def test_folds_that_are_refused_change_nothing(spark):
    log = [("fold", "a", ["b"], "same"), ("fold", "c", ["b"], "same"), ("fold", "a", ["a"], "x"), ("fold", "a", ["zz"], "x"), ("fold", "zz", ["a"], "x"), ("fold", "a", [], "x"), ("fold", "a", ["d"], ""), (None, None, None, None)]
    state, told = folded(spark, log)
    assert told == ["folded"] + [f"refused: {w}" for w in ("superseded form", "into itself", "unknown form", "unknown canonical", "nobody to fold", "no rationale", "unknown canonical")]
    assert state["c"]["aliases"] == ["alias c"] and state["d"]["superseded_by"] is None


def test_logs_equal_a_plain_replay(spark):
    rng = random.Random(5)
    log = []
    for _ in range(80):
        a, *others = rng.sample("abcdef", rng.randint(2, 3))
        log.append(("undo", a, None, None) if rng.random() < 0.4 else ("fold", a, others, "why"))
    state, told = folded(spark, log)
    plain = {i: {"id": i, "name": n, "aliases": a, "sources": s, "superseded_by": None, "rationale": None, "confidence": None} for i, n, a, s in ENTITIES}
    want = folds.replay(plain, [{"seq": k, "op": op, "canonical": c, "others": o, "rationale": why, "confidence": 0.9} for k, (op, c, o, why) in enumerate(log)])
    assert told == [o for _, o in want]
    assert {i: (r["aliases"], r["sources"], r["superseded_by"]) for i, r in state.items()} == {i: (r["aliases"], r["sources"], r["superseded_by"]) for i, r in plain.items()}


# versions ---------------------------------------------------------------------------


def change(tables, rows):
    events = merge.upsert(tables.get("events", rows.limit(0)), rows, ["k"], "v")
    log = rows.select("k", F.lit("seen").alias("action"))
    return {"events": events, "log": log if "log" not in tables else tables["log"].unionByName(log)}


def test_a_batch_changes_all_tables_at_once_and_once(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/t")
    write = versions.sink(change, "w")
    batch = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    assert versions.number() == 0 and versions.table("events") is None
    write(batch((1, 1), (2, 1)), 0)
    write(batch((2, 2), (3, 2)), 1)
    write(batch((2, 9), (3, 9)), 1)  # the batch runs again
    assert versions.number() == 2
    assert sorted(tuple(r) for r in versions.table("events").collect()) == [(1, 1), (2, 2), (3, 2)] and versions.table("log").count() == 4
    assert versions.table("events", 1).count() == 2  # older versions stay readable


def test_a_crash_between_files_leaves_the_version_before(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, 1)], "k int, v int")
    versions.sink(change, "w")(rows, 0)

    def broken(tables):
        made = change(tables, spark.createDataFrame([(1, 5)], "k int, v int"))
        return {"events": made["events"], "log": made["log"].select(F.raise_error(F.lit("lost")).alias("k"))}

    with pytest.raises(Exception, match="lost"):
        versions.commit(broken, "w", 1)
    assert versions.number() == 1 and [tuple(r) for r in versions.table("events").collect()] == [(1, 1)] and versions.table("log").count() == 1
    assert versions.commit(lambda t: change(t, spark.createDataFrame([(1, 5)], "k int, v int")), "w", 1)
    assert [tuple(r) for r in versions.table("events").collect()] == [(1, 5)]


def test_two_writers_of_one_version_meet(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, 1)], "k int, v int")

    def other(tables):
        Versions(spark, versions.folder).commit(lambda t: {"x": rows}, "other", 0)
        return {"y": rows}

    with pytest.raises(Conflict):
        versions.commit(other, "w", 0)
    assert versions.table("y") is None and versions.table("x").count() == 1


# learning ---------------------------------------------------------------------------

OUTCOME = "source_id bigint, at timestamp, outcome_id bigint, found bigint, success boolean, technique string"


def test_recipes_do_not_depend_on_the_order_of_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(4), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(50)), i, rng.choice([0, 0, 4, 9]), rng.random() < 0.8, rng.choice(["feed", "page", None])) for i in range(60)]
    want = {}
    for s in range(4):
        recipe = {**learning.START, "yields": []}
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1:3]):
            recipe = learning.learned(recipe, r[3], r[4])
        want[s] = tuple(recipe[c] for c in ("attempts", "successes", "median_yield", "reliability", "confidence", "empty"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for turn in range(2):
            rng.shuffle(rows)
            for k in range(3):
                spark.createDataFrame(rows[20 * k : 20 * k + 20], OUTCOME).coalesce(1).write.parquet(f"{tmp_path}/{turn}/f{k}")
            stream = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{turn}/*")
            out = crawl.drained(learning.outcome_learning(stream), "update").collect()
            last = {s: max((r for r in out if r["source_id"] == s), key=lambda r: r["batch"]) for s in want}
            assert {s: tuple(r[c] for c in ("attempts", "successes", "median_yield", "reliability", "confidence", "empty")) for s, r in last.items()} == want
    finally:
        spark.conf.set(store, before)


def test_two_empty_outcomes_call_for_a_new_look():
    recipe = {**learning.START, "yields": []}
    one = learning.learned(recipe, 10, True)
    two = learning.learned(one, 20, True)
    assert one["reliability"] > 0.5 and one["median_yield"] == 10 and two["median_yield"] == 15 and two["reliability"] > one["reliability"]
    three = learning.learned(learning.learned(two, 0, True), 5, False)
    assert three["empty"] == learning.EMPTIES and three["confidence"] < two["confidence"] and three["successes"] == 2


# what round two got wrong -------------------------------------------------------------


def column(spark, kind, values, make):
    return [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_every_zone_is_known(spark):
    zones = ["Asia/Tokyo", "America/Phoenix", "Europe/Paris", "Nowhere/Here", None]
    got = column(spark, "string", zones, lambda z: dates.utc_stamp(F.lit("20240105T200000"), z))
    assert got == ["2024-01-05T11:00:00Z", "2024-01-06T03:00:00Z", "2024-01-05T19:00:00Z", "2024-01-05T20:00:00Z", "2024-01-05T20:00:00Z"]
    assert column(spark, "string", ["Asia/Tokyo"], lambda z: dates.utc_stamp(F.lit("20240105T200000Z"), z)) == ["2024-01-05T20:00:00Z"]


def test_rooms_in_any_case(spark):
    from tessella.operators.labels import title_room

    assert column(spark, "string", ["Show (back room)", "X (upstairs)", "(Back Room)", "Show (Blue Hall ) ", "Show (sold out)", "room", None], title_room) == ["back room", "upstairs", "back room", "blue hall", None, None, None]


def test_cells_hold_line_ends(spark):
    body = 'title,note\r\n"a\r\nb, c","say ""x"""\r\n5" pipe,"6"" wide"\r\nlast,"\n"\r\n\r\n'
    row = texts.claim_files(spark.createDataFrame([(1, body)], "k int, t string"), "k", "t", ("title",)).collect()[0]
    assert row["verdict"] == "ok" and [(r["title"], r["note"]) for r in row["rows"]] == [("a\r\nb, c", 'say "x"'), ('5" pipe', '6" wide'), ("last", "")]
    ragged = "a,b\n\"x\ny\",1\n2\n"
    assert texts.claim_files(spark.createDataFrame([(1, ragged)], "k int, t string"), "k", "t", ("a",)).collect()[0]["verdict"] == "row 3: ragged"
    assert column(spark, "string", ["a,b\nc", '"x', ""], texts.csv_records) == [["a,b", "c"], ['"x'], [""]]


def test_linked_data_in_lists_and_graphs(spark):
    page = '<script type="application/ld+json">[{"@graph": [{"@type": "MusicEvent", "name": "A"}, {"@graph": [{"@type": "x:festival"}]}]}, {"@type": "Place", "name": "no"}]</script><script type="application/ld+json">{bad</script>'
    got = texts.linked_events(spark.createDataFrame([(1, page)], "k int, t string"), "k", "t").collect()
    assert sorted((r["type"], r["name"]) for r in got) == [("MusicEvent", "A"), ("x:festival", None)]


def test_a_missing_part_joins_no_rows(spark):
    schema = "pos int, desk int, night string, place string, title string, performer string, kind string, stated boolean"
    rows = [
        (1, 1, "n1", "p", "Show A", None, "k", False), (2, 2, "n1", "p", "Other B", None, "k", True),  # no performer: two events
        (3, 1, "n2", "x", "T", None, "k", False), (4, 1, "n2", None, "U", "x", "k", False),  # a place is no performer
        (5, 1, "n3", "p", "Band", "band", "k", False), (6, 2, "n3", "P ", "Band and guests", "Band", "m", True), (7, 3, "n3", "p", "band", None, "k", False),
        (8, 1, None, "p", "Band", "band", "k", False), (9, 1, "n4", "p", None, None, "k", False), (10, 1, "n4", "p", "", "", "k", False),
    ]
    got = union.desk_union(spark.createDataFrame(rows, schema)).orderBy("first_pos").collect()
    assert [(r["first_pos"], r["members"], r["titles"]) for r in got] == [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 3, 2), (8, 1, 1), (9, 1, 0), (10, 1, 0)]
    assert [r["kind"] for r in got if r["first_pos"] == 5] == ["m"]


def test_one_key_for_all_spellings(spark):
    same = [["Café Niﬁ", "CAFÉ NIFI"], ["Straße", "STRASSE"], ["ΣΊΣΥΦΟΣ", "σίσυφος"], ["Ｆｕｌｌ", "full"]]
    for pair in same:
        a, b = column(spark, "string", pair, text.title_key)
        assert a == b and a
    assert len(set(column(spark, "string", ["cafe", "café"], text.title_key))) == 2  # letters with and without marks differ
    assert column(spark, "string", ["Thé Çafé", "Ærø’s", "Łódź ガ", "İzmir", "ΣΊΣ"], text.hard_key) == ["cafe", "aeros", "lodz ガ", "izmir", "σίς"]
    assert column(spark, "string", ["Ünïcode", "ガ"], text.folded_words) == ["unicode", "カ"]


FORMS = [
    ("2026-08-01", "2026-08-01"), ("2026-08-01T20:00", "2026-08-01"), ("Aug 1", "2026-08-01"), ("Fri Aug 1st, 8pm", "2026-08-01"), ("Sept. 3", "2026-09-03"), ("1 August", "2026-08-01"), ("3rd of May", "2027-05-03"),
    ("8/1", "2026-08-01"), ("13/8", "2026-08-13"), ("8/1/2025", "2025-08-01"), ("8/1/26", "2026-08-01"), ("May 4 - May 6", "2027-05-04"), ("July 4", "2026-07-04"), ("June 20", "2027-06-20"), ("Aug 1, 2024", "2024-08-01"),
    ("Feb 30", None), ("8/32", None), ("Marching 5", None), ("", None), (None, None),
]


def test_printed_days(spark):
    as_of = F.lit(dt.date(2026, 7, 10))
    got = column(spark, "string", [t for t, _ in FORMS], lambda c: F.date_format(dates.translated_when(c, as_of, F.lit(None).cast("string")), "yyyy-MM-dd"))
    assert got == [d for _, d in FORMS]
    assert column(spark, "string", ["Aug 1"], lambda c: dates.translated_when(c, as_of, F.lit("seasons 2024 and 2023"))) == [dt.date(2023, 8, 1)]


CARDS = [
    ("Fri Aug 7, 8pm show and Sat Aug 8 7-9:30 pm", [("2026-08-07", 1200, None), ("2026-08-08", 1140, 1290)]), ("Friday August 7", [("2026-08-07", None, None)]), ("Fri Aug 8", []),
    ("Thursdays and Fridays 6pm. Continues through Jul 20", [("2026-07-10", 1080, None), ("2026-07-16", 1080, None), ("2026-07-17", 1080, None)]), ("Wed Sept 3 2025 doors 7:30 p.m.", [("2025-09-03", 1170, None)]),
    ("Fri Aug 7 and Fri Aug 7", [("2026-08-07", None, None)]), ("Fri Aug 7 " + "x" * 60 + " 8pm", [("2026-08-07", None, None)]), ("", []), (None, None),
]


def test_printed_nights(spark):
    got = column(spark, "string", [t for t, _ in CARDS], lambda c: dates.house_nights(c, F.lit("<h1>What is on</h1>"), F.lit(dt.date(2026, 7, 10))))
    assert [g if g is None else [(str(n["day"]), n["start"], n["stop"]) for n in g] for g in got] == [n for _, n in CARDS]
    assert column(spark, "string", ["Fri Aug 1"], lambda c: dates.house_nights(c, F.lit("<title>Season 2025</title>"), F.lit(dt.date(2026, 7, 10)))["day"]) == [[dt.date(2025, 8, 1)]]
