"""Small cases of the faults that were found in round 3."""

from __future__ import annotations

import random
import tracemalloc
from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import functions as F

from tessella.llm.suffix_dedup import remove_repeats
from tessella.operators import folds, matching, state
from tessella.plans import graphs, listing_pages, selection
from tessella.sources import markup, texts


def _entities(n: int) -> dict:
    return {f"s{i}": {"id": f"s{i}", "name": f"n{i}", "aliases": [f"alias {i}"], "sources": [f"doc {i % 7}"], "superseded_by": None, "rationale": None, "confidence": None} for i in range(n)}


def test_memory_of_a_crowd_of_folds_does_not_grow_with_its_square():
    peaks = []
    for n in (1500, 6000):
        state = _entities(n)
        log = [{"seq": i, "op": "fold", "canonical": "s0", "others": [f"s{i}"], "rationale": "w", "confidence": 0.9} for i in range(1, n)]
        tracemalloc.start()
        told = folds.replay(state, log)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert {o for _, o in told} == {"folded"} and len(state["s0"]["aliases"]) == 2 * n - 1 and len(state["s0"]["sources"]) == 7
    assert peaks[1] < 8 * peaks[0]  # 16 times with the square


def test_folds_that_are_made_again_give_each_value_once():
    rng = random.Random(7)
    for _ in range(20):
        state, log = _entities(5), []
        for k in range(600):
            a, b = rng.sample(sorted(state), 2)
            log.append({"seq": k, "op": "undo" if rng.random() < 0.45 else "fold", "canonical": a, "others": [b], "rationale": "w", "confidence": 0.9})
        folds.replay(state, log)
        assert all(len(e[c]) == len(set(e[c])) <= 10 for e in state.values() for c in ("aliases", "sources"))


class _OfTables:
    """Tables that are given as DataFrames."""

    def __init__(self, spark, **tables):
        self.spark = spark
        self.__dict__ |= tables


def test_words_are_ascii_as_in_the_sql(spark):
    docs = spark.createDataFrame([(1, "éthe cat"), (2, "the"), (3, "bathe andy xavec"), (4, "andé"), (5, "_and and_"), (6, None), (7, "x-AVEC.")], "doc_id bigint, text string")
    assert sorted(r[0] for r in selection.banned_phrases(_OfTables(spark, documents=docs)).collect()) == [1, 2, 4, 7]


def test_class_tokens_begin_and_end_at_ascii_edges(spark):
    docs = spark.createDataFrame([(1, "éclas 12é, İabc 7"), (2, "xclas 1 clas ×30 clas_ 4 4clas 5")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in graphs.class_token_counts(_OfTables(spark, documents=docs)).collect()) == [("clas", 42, 2), ("iabc", 7, 1)]


def test_headings_keep_references_that_are_not_markup(spark):
    html = '<ul><li>x</li></ul><a href="/a">y</a><h1> R&amp;B &lt;3 &amp &quot;q&quot; &amp;lt; &copy</h1>'
    pages = spark.createDataFrame([(1, "http://h.example/p", html)], "page_id bigint, url string, html string")
    assert [tuple(r) for r in listing_pages.page_elements(_OfTables(spark, pages=pages)).collect()] == [(1, 1, 1, "http://h.example/a", "R&B <3 &amp &quot;q&quot; &lt; &copy")]


def test_numbers_do_not_need_a_key_in_one_task(spark):
    rng = random.Random(2)
    values = [(rng.choice([None, 0, 1, 1, 1]), rng.randint(0, 50), i) for i in range(700)]
    df = spark.createDataFrame(values, "page int, a int, b int").repartition(5)
    got = state.numbered(df, "page", ["a", "b"], width=60)
    want = []
    for page in (None, 0, 1):
        want += [(page, a, b, n) for n, (a, b) in enumerate(sorted((a, b) for p, a, b in values if p == page), 1)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert not [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(page" in line]


def test_other_names_of_one_key_make_pairs(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["x", "y", "z", None]), rng.randint(0, 3)) for i in range(120)]
    got = matching.differing_pairs(spark.createDataFrame(rows, "id int, name string, k int"), ["k"], "name", "id").collect()
    want = [(a, b) for a, n, k in rows for b, m, o in rows if a < b and k == o and n and m and n != m]
    assert sorted(map(tuple, got)) == sorted(want)


def test_small_pages_are_read_in_many_tasks(spark):
    pages = spark.range(400).selectExpr("id", "'<ul><li> a  b</li></ul>' as html").coalesce(1)
    read = markup.with_tree(pages, "html").select("id", F.spark_partition_id().alias("p"))
    assert len({r["p"] for r in read.collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_pages_text_is_gathered_once(spark):
    rows = markup.with_tree(spark.createDataFrame([(1, "<p>a</p><p>b</p>")], "id int, html string"), "html")
    assert _plan(rows.select(markup.page_text(F.col("nodes")).alias("t"))).count("filter(nodes") == 1  # once more for each of its texts
    pages = spark.createDataFrame([(1, "<p>2030-01-01 a show</p><p>2030-01-02 b show</p>")], "id int, html string")
    assert _plan(listing_pages.listing_pages.segments(pages, "id", "html")).count("split(") < 4


def test_a_linked_object_is_parsed_about_once_a_field(spark):
    rows = spark.createDataFrame([('{"@type": "Event", "name": "a", "location": ["Hall"]}',)], "t string")
    assert _plan(rows.select(texts.linked_event(F.col("t")).alias("e"))).count("get_json_object") < 50  # 671 when each was named where it was used


def test_pages_of_plain_tokens_are_read_as_the_library_reads_them():
    rng, plain = random.Random(3), 0
    bits = (
        "<p>|</p>|<br>|<br/>|<br />|<|>|&amp;|&lt|&|a| |\n|text one|<script>|</script>|<script/>|<style>|</style>|<title>|</title>|<nav>|</nav>|<header>|</header>|</footer>|<footer class=\"a  b\">|<a href=\"/x/y/\">|<a href=\"/x\" href=\"/y\">"
        "|<a href=\"../q#t\">|</a>|<meta itemprop=\"url\" content=\"/m\">|<div itemscope itemtype=\"t\">|</div>|<article>|</article>|<h1>|</h1>|<body>|</body>|<li>|</li>|<x class=\"&amp;\">|<X>|<!-- c -->|<!doctype html>|<p class=q>"
        "|<p class='q'>|<p  a=\"b\">|<p a=\"b\"c=\"d\">|<p a=\"b\" >|<p a=\"\">|<p a>|<p a=\"1\" a=\"2\">|<a href=\"//h.example/z\">|<a href=\"HTTP://H.example/Z/\">|<a href=\"/\">|<a href=\"/a/./b\">|<p data-x=\"\xa0 a\tb \">").split("|")
    for _ in range(4000):
        page, base = "".join(rng.choice(bits) for _ in range(rng.randrange(9))), rng.choice((None, "https://h.example/a/b", "http://H.example/", "https://h.example?x", "x"))
        whole = markup._Nodes(base)
        parser = markup._Any(whole)
        parser.feed(page)
        parser.close()
        whole.close(0)
        found = markup._read(page, base)
        assert (found.rows, found.last, found.paged) == (whole.rows, whole.last, whole.paged), (page, base)
        plain += markup._plain(page, markup._Nodes(base))
    assert 800 < plain < 3200


def test_plain_addresses_are_joined_as_any_other():
    for base in ("https://h.example/a/b", "http://h.example", "https://h.example./a?q", "https://h.example:80/"):
        for href in ("/", "/a", "/a/", "/a/b_c-d/", "//x.example/a", "/a//b", "/a/../b", "a", "/a?b"):
            parts = urlsplit(urljoin(base, href))
            assert markup.address(href, base) == urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path.rstrip("/") or parts.path[:1], parts.query, ""))


def test_pages_of_the_same_tags_are_walked_once(monkeypatch):
    seen, element = [], markup._Nodes.element
    monkeypatch.setattr(markup._Nodes, "element", lambda self, *a: seen.append(a) or element(self, *a))
    pages = [f'<main><p class="c{i}">a &amp; {i}</p><i data-once="x"></i><a href="/p{i}">b</a></main>' for i in range(50)]
    read = [markup.tree(p, "https://h.example/") for p in pages]
    assert len(seen) == 4  # each page's before
    assert [(r[1]["attrs"], r[2]["text"], r[4]["link"], r[0]["last"]) for r in read] == [({"class": f"c{i}"}, f"a & {i}", f"https://h.example/p{i}", 5) for i in range(50)]


def test_elements_with_attributes_come_in_an_array_of_their_own(spark):
    html = ['<p>a<b class="x">c</b></p><a href="/q" href="/r">d</a>', "", None, "plain", "</p>", '<P id=1><!-- c --><i id="2">', "<p a='1'>x</p>" * 300]
    pages = spark.createDataFrame(list(enumerate(html)), "id int, html string")
    whole = {r["id"]: r["nodes"] for r in markup.with_tree(pages, "html").collect()}
    some = {r["id"]: r for r in markup.with_tree(pages, "html", fields=("node", "text"), marked=("node", "attrs", "clash")).collect()}
    assert len(whole[6]) == 600 and all(x["clash"] == (x["tag"] == "a") for x in whole[0])
    for i, nodes in whole.items():
        assert [tuple(x) for x in some[i]["nodes"]] == [(x["node"], x["text"]) for x in nodes]
        assert [tuple(x) for x in some[i]["marked"]] == [(x["node"], x["attrs"], x["clash"]) for x in nodes if x["attrs"]]


def test_slices_of_pages_are_bounded_by_their_bytes():
    sizes = [markup.SLICE_BYTES // 2] * 3 + [3 * markup.SLICE_BYTES] + [0] * (markup.SLICE + 1)
    assert list(markup._slices(sizes)) == [(0, 2), (2, 3), (3, 4), (4, 4 + markup.SLICE), (4 + markup.SLICE, 5 + markup.SLICE)]
    assert list(markup._slices([])) == []


def test_planted_passages_of_400_bytes_are_removed_and_shorter_ones_stay(spark):
    rng = random.Random(11)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    long, short = words(60, 7), words(55, 6)  # 479 and 384 bytes
    texts = [f"{words(40, 6)} {p} {words(40, 6)}" for p in (long, long, short, short)] + [words(150, 6)]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert all(got[i]["n_bytes"] == len(t) for i, t in enumerate(texts))
    assert all(len(long) <= got[i]["n_removed"] <= len(long) + 20 for i in (0, 1)) and [got[i]["n_removed"] for i in (2, 3, 4)] == [0, 0, 0]
