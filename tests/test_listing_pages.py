"""Element trees, and what listing pages and event pages state."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import listing_pages as lp
from tessella.sources import markup

BASE = "https://desk.example/list?page=2"


def pages(spark, *htmls):
    return spark.createDataFrame([(i, BASE, h) for i, h in enumerate(htmls)], "id int, url string, html string")


class Batch:
    """Pages that are named when tests are collected and read in one job when the first result is asked for."""

    def __init__(self, job):
        self.job, self.pages, self.found = job, [], None

    def __call__(self, *page):
        self.pages.append(page)
        at = len(self.pages) - 1

        def result(spark):
            if self.found is None:
                self.found = self.job(spark, self.pages)
            return self.found[at]

        return result


def _cut(spark, named):
    rows = lp.segments(pages(spark, *(p[0] for p in named)), "id", "html").orderBy("id", "pos").collect()
    return [tuple([r[c] for r in rows if r["id"] == i] for c in ("way", "text", "address")) for i in range(len(named))]


cut = Batch(_cut)


def test_tree_knows_containment_scopes_and_plumbing():
    nodes = markup.tree('<body><nav><a href="/x">n</a></nav><div itemscope><p>one<br>two<span itemprop="name">x</span></div></p><script>if (a<b) {}</script></body>')
    by_tag = {n["tag"]: n for n in nodes}
    assert by_tag["div"]["last"] == by_tag["span"]["last"] and by_tag["span"]["scope"] == by_tag["div"]["node"]
    assert by_tag["a"]["aside"] and not by_tag["p"]["aside"] and by_tag["body"]["paged"] and not by_tag["div"]["paged"]
    assert [n["text"] for n in nodes if n["tag"] == "#raw"] == ["if (a<b) {}"]
    assert markup.tree(None) == [] == markup.tree("")
    assert [n["last"] for n in markup.tree("<ul><li>a<li>b")] == [4, 4, 2, 4, 4]  # what is open at the end ends there


def test_headers_are_plumbing_at_page_scope_only():
    nodes = markup.tree("<header>x</header><article><header><h2>t</h2></header></article>")
    assert [n["aside"] for n in nodes if n["tag"] in ("header", "h2")] == [True, False, False]


def test_repeated_articles(spark, a=cut("<div class=calendar><article>Fri Aug 1, 8pm <b>Night Owls</b> at Mill</article>\n<article>Sat Aug 2 Rivers at Barn</article><article>Sun Aug 3, Tin at Hall</article></div>")):
    ways, texts, _ = a(spark)
    assert set(ways) == {"article"} and texts == ["Fri Aug 1, 8pm Night Owls at Mill", "Sat Aug 2 Rivers at Barn", "Sun Aug 3, Tin at Hall"]


def test_nested_items_are_one_block(spark, a=cut("<ul><li>Mon 7/1 8pm Skye <ul><li>with guests 9pm</li></ul></li><li>Tue 7/2 8pm Harbor</li></ul>")):
    ways, texts, _ = a(spark)
    assert ways == ["list", "list"] and texts[0] == "Mon 7/1 8pm Skye with guests 9pm"


def test_cards_by_class(spark, a=cut('<div class="event-card">8pm one show</div><section class="bigShow">9pm two shows</section><div class="other">10pm three</div>')):
    ways, texts, _ = a(spark)
    assert ways == ["card", "card"] and texts == ["8pm one show", "9pm two shows"]


A_MENUIS_HTML = "<ul><li>Home page</li><li>About us all</li><li>Shows here</li></ul>"


def test_a_menu_is_one_block(spark, a=cut(A_MENUIS_HTML)):
    assert a(spark) == (["whole"], [A_MENUIS_HTML], [None])


ONE_DATEDITEM_HTML = "<div class='event'>Only show, Fri 8/1 8pm at Mill</div>"


def test_one_dated_item_is_the_whole_page(spark, a=cut(ONE_DATEDITEM_HTML)):
    assert a(spark)[:2] == (["whole"], [ONE_DATEDITEM_HTML])


ITEM = '<div itemscope itemtype="https://schema.org/MusicEvent">Fri 9/5 {} {}</div>'


ADDRESSES = [
    ('<a itemprop="url" href="/e/{n}">x</a>', "/e/{n}"),
    ('<meta itemprop="url" content="/e/{n}"/>', "/e/{n}"),
    ('<a href="/e/{n}">title link alone</a>', None),
    ('<a itemprop="url" href="/e/{n}" href="/other/{n}">x</a>', None),  # an element that contradicts itself
    ('<a itemprop="url" href="/e/{n}" content="/f/{n}">x</a>', None),
    ('<a itemprop="url" href="/e/{n}">x</a><a itemprop="url" href="/g/{n}">y</a>', None),  # two of them
    ('<a itemprop="url" href="/e/{n}">x</a><a itemprop="url" href="/e/{n}">y</a>', "/e/{n}"),
    ('<span itemprop="performer" itemscope><a itemprop="url" href="/artist/{n}">x</a></span>', None),  # of an item within
    ('<a itemprop="url" itemscope href="/artist/{n}">x</a>', None),  # an item itself
    ('<a itemprop="url" href="javascript:void(0)">x</a>', None),
    ('<a itemprop="url" href="/same">x</a>', None),  # stated by both blocks
]


@pytest.mark.parametrize("two, address", [(cut("".join(ITEM.format(f"show number {n}", inner.format(n=n)) for n in (1, 2))), address) for inner, address in ADDRESSES])
def test_address_that_a_card_declares(spark, two, address):
    ways, _, found = two(spark)
    assert ways == ["item", "item"] and found == [address and address.format(n=n) for n in (1, 2)]


def test_a_property_without_an_item_declares_nothing(spark, a=cut("".join(f'<article>Fri 9/{n} show <a itemprop="url" href="/e/{n}">x</a></article>' for n in (1, 2)))):
    assert a(spark)[2] == [None, None]


LINKED_DATACOMES_HTML = """<script type="application/ld+json">[{"@type": "Event", "name": "One", "startDate": "2030-01-02", "url": "https://x.example/1", "location": {"name": "Mill", "address": {"streetAddress": "1 Main", "addressLocality": "Town"}}},
      {"@graph": [{"@type": "Festival", "name": "Two nights"}]}]</script><article>Fri 8pm a show</article><article>Sat 8pm a show</article>"""


def test_linked_data_comes_first(spark, a=cut(LINKED_DATACOMES_HTML)):
    assert a(spark) == (["linked", "linked"], ["One | 2030-01-02 | Mill | 1 Main | Town | https://x.example/1", "Two nights"], ["https://x.example/1", None])


def test_lines_that_begin_with_a_date(spark, a=cut("Mill, August shows\nFri 8/1 8pm Night Owls\nmore of it\n * Sat 8/2 Rivers\nSun 8/3 Tin Sparrow\n"), b=cut("<p>Thursday: the Larks</p><p>Friday: Ember</p>"), c=cut("Night show on Fri 8/1, 8pm."), d=cut("  "), e=cut(None)):
    ways, texts, _ = a(spark)
    assert set(ways) == {"lines"} and texts == ["Mill, August shows\nFri 8/1 8pm Night Owls\nmore of it", "* Sat 8/2 Rivers", "Sun 8/3 Tin Sparrow"]
    assert b(spark)[1] == ["Thursday: the Larks", "Friday: Ember"]
    assert c(spark) == (["whole"], ["Night show on Fri 8/1, 8pm."], [None])
    assert d(spark) == (["whole"], ["  "], [None]) and e(spark) == ([], [], [])


def test_more_blocks_than_any_bound(spark, a=cut("".join(f"<li>{1 + n % 12}:30 pm show {n}</li>" for n in range(700)))):
    assert len(a(spark)[0]) == 700


PATTERNS = [("event", "desk.example", r"/event/[0-9]+.*")]
CARD = '<div class="row"><a href="/event/{n}/"><img src="x"></a><h3><a href="/event/{n}#top">Show {n}</a></h3><time datetime="2030-05-0{n}T20:00">May {n}</time><span class="venue">Hall {n}</span><a href="/tickets">buy</a></div>'


SELECTORS = [("article", ("show",)), ("div", ("card",))]


def _read(spark, named):
    found = lp.listing_rows(pages(spark, *(p[0] for p in named)), "id", "url", "html", PATTERNS, SELECTORS).persist()
    rows, why = lp.page_rows(found, "id").orderBy("id", "nth", "night").collect(), {r["id"]: r for r in lp.page_reasons(found, "id").collect()}
    found.unpersist()
    return [([(r["title"], r["when"], r["place"], r["address"]) for r in rows if r["id"] == i], why[i]) for i in range(len(named))]


read = Batch(_read)


ROWS_BYCOMMITTED_HTML = f'<body><nav><a href="/event/9">nav</a></nav><main><h1>What is on</h1><div class="list">{CARD.format(n=1)}{CARD.format(n=2)}</div></main></body>'


def test_rows_by_committed_addresses(spark, a=read(ROWS_BYCOMMITTED_HTML)):
    rows, why = a(spark)
    assert rows == [(f"Show {n}", f"2030-05-0{n}T20:00", f"Hall {n}", f"https://desk.example/event/{n}") for n in (1, 2)]
    assert (why["tier"], why["furniture"], why["reason"]) == ("permalink", 1, None)


def test_one_address_on_a_page_does_not_grow_into_the_page(spark, a=read(f'<body><div class="wrap"><h1>Heading of the page</h1><ul><li>{CARD.format(n=3)}</li></ul></div></body>')):
    rows, _ = a(spark)
    assert rows == [("Show 3", "2030-05-03T20:00", "Hall 3", "https://desk.example/event/3")]


def test_a_bare_list_of_links(spark, a=read('<p><a href="/event/1">One</a> <a href="/event/2?date=3">Two</a></p>')):
    assert a(spark)[0] == [("One", None, None, "https://desk.example/event/1"), ("Two", None, None, "https://desk.example/event/2?date=3")]


LINKED_DATAAND_DATA = '<script type="application/ld+json">{"@type": "Event", "name": "Show 1", "startDate": "2030-05-01T20:00", "url": "https://desk.example/event/1", "location": "Hall of LINKED_DATAAND_DATA"}</script>'


def test_linked_data_and_cards_are_one_row_by_address(spark, a=read(LINKED_DATAAND_DATA + CARD.format(n=1) + CARD.format(n=2))):
    rows, why = a(spark)
    assert rows == [("Show 1", "2030-05-01T20:00", "Hall of LINKED_DATAAND_DATA", "https://desk.example/event/1"), ("Show 2", "2030-05-02T20:00", "Hall 2", "https://desk.example/event/2")]
    assert (why["tier"], why["structured"], why["printed"]) == ("structured+permalink", 1, 4)


A_ROWFOR_HTML = '<article class="show big"><h2>Run</h2><time datetime="2030-05-01">1</time><time datetime="2030-05-02">2</time><time class="event-end" datetime="2030-05-03">3</time><a href="https://desk.example/list">back</a></article>'


def test_a_row_for_each_printed_occurrence(spark, a=read(A_ROWFOR_HTML)):
    rows, why = a(spark)
    assert rows == [("Run", "2030-05-01", None, None), ("Run", "2030-05-02", None, None)]  # the list's own address is dropped, not the row
    assert (why["tier"], why["own_list"]) == ("selector", 1)


SELECTORS_TAKEWHOLE_HTML = '<div class="card"><div class="card a"><h3>In 1</h3></div><div class="card-grid"><h3>no</h3></div><div class="card b"><h3>In 2</h3></div></div>'


def test_selectors_take_whole_names_and_the_innermost(spark, a=read(SELECTORS_TAKEWHOLE_HTML)):
    assert [r[0] for r in a(spark)[0]] == ["In 1", "In 2"]


EVENT_ITEMSARE_HTML = '<div itemscope itemtype="https://schema.org/Event"><span itemprop="name">Item</span><meta itemprop="startDate" content="2030-06-01"><div itemprop="location" itemscope><span itemprop="name">Barn</span></div></div>'


def test_event_items_are_rows(spark, a=read(EVENT_ITEMSARE_HTML)):
    assert a(spark)[0] == [("Item", "2030-06-01", "Barn", None)]


EMPTY = [("<p>nothing</p>", "no_identity_declared"), ('<aside><a href="/event/4">x</a></aside>', "links_in_plumbing_only"), ('<li><a href="/event/4"></a></li>', "no_title"), (None, "no_identity_declared"), ("", "no_identity_declared")]


@pytest.mark.parametrize("page, reason", [(read(html), reason) for html, reason in EMPTY])
def test_a_page_without_rows_says_why(spark, page, reason):
    rows, why = page(spark)
    assert rows == [] and why["reason"] == reason


def _state(spark, named):
    df = spark.createDataFrame([(i, "https://desk.example/event/1", p[0]) for i, p in enumerate(named)], "id int, url string, html string")
    return lp.event_statements(df, "id", "url", "html").orderBy("id").collect()


state = Batch(_state)
OWN = '<body><header><a href="/">Desk</a></header><main><article><h1>Foo</h1><time datetime="2030-09-11T20:00">Wed, 8pm</time><div class="venue">Where: The Hall, 1 Red St</div></article>{}</main><footer class="location"><address>Desk, 9 Paper Row</address><time datetime="2031-01-01">x</time></footer></body>'


def test_a_page_states_its_date_and_place(spark, a=state(OWN.format(""))):
    s = a(spark)
    assert (s["when"], s["precision"], s["source"], s["place"], s["place_source"], s["foreign"]) == ("2030-09-11T20:00", "minute", "printed", "The Hall, 1 Red St", "line", 1)


CARDS_OFOTHER_CARD = '<div class="rel"><a href="/event/2">Other</a><time datetime="2030-10-01">x</time><p class="venue">Elsewhere</p></div>'


def test_cards_of_other_pages_are_foreign(spark, a=state(OWN.format(CARDS_OFOTHER_CARD)), b=state(f'<body><div><a href="/event/1">self</a> <time datetime="2030-01-05">x</time></div>{CARDS_OFOTHER_CARD}</body>'), c=state(f"<body><main><h1>Foo</h1>{CARDS_OFOTHER_CARD}</main></body>")):
    assert a(spark)["when"] == "2030-09-11T20:00"
    assert b(spark)["when"] == "2030-01-05"
    s = c(spark)
    assert (s["when"], s["place"], s["foreign"]) == (None, None, 1)


def test_several_dates_give_none_and_a_list(spark, a=state('<time datetime="2030-01-01">a</time><time datetime="2030-01-02T20:00">b</time>'), b=state('<time datetime="2030-01-01T20:00">a</time><time datetime="2030-01-01T22:00">b</time>'), c=state('<time datetime="2030-01-01">a</time><time class="end-time" datetime="2030-01-01T23:00">b</time>')):
    s = a(spark)
    assert (s["when"], s["dates"]) == (None, ["2030-01-01", "2030-01-02"])
    assert b(spark)["when"] == "2030-01-01"  # one night, two clocks
    assert c(spark)["when"] == "2030-01-01"


def test_ends_and_clocks_are_no_start(spark, a=state('<time itemprop="endDate" datetime="2030-01-01T23:00">until 11</time>'), b=state('<time class="calendar" datetime="2030-01-01T23:00">x</time>'), c=state('<time datetime="20:00">8pm</time>')):
    s = a(spark)
    assert (s["when"], s["end_only"]) == (None, True)
    assert b(spark)["when"] == "2030-01-01T23:00"
    s = c(spark)
    assert (s["when"], s["clock_only"]) == (None, True)


DATA = '<script type="application/ld+json">{}</script><h1>Foo</h1>'


LINKED_DATAOF_OWN = '{"@type": "MusicEvent", "url": "https://desk.example/event/1", "startDate": "2030-09-11", "location": {"name": "Hall", "address": "1 Red St"}}'
LINKED_DATAOF_OTHER = LINKED_DATAOF_OWN.replace("event/1", "event/2")


def test_linked_data_of_the_page(spark, a=state(DATA.format(LINKED_DATAOF_OWN)), b=state(DATA.format(LINKED_DATAOF_OTHER)), c=state(DATA.format(f"[{LINKED_DATAOF_OTHER}, {LINKED_DATAOF_OWN}]")), d=state(DATA.format(f"[{LINKED_DATAOF_OWN}, {LINKED_DATAOF_OWN}]")), e=state(DATA.format(LINKED_DATAOF_OWN) + '<time datetime="2030-09-12">x</time>'), f=state(DATA.format(LINKED_DATAOF_OWN) + '<time datetime="2030-09-11T20:00">x</time>'), g=state(None)):
    s = a(spark)
    assert (s["when"], s["precision"], s["source"], s["place"]) == ("2030-09-11", "date", "linked", "Hall, 1 Red St")
    assert b(spark)["when"] is None
    assert c(spark)["foreign"] == 1
    assert d(spark)["when"] is None
    s = e(spark)
    assert (s["when"], s["conflict"]) == (None, True)
    assert f(spark)["when"] == "2030-09-11"
    s = g(spark)
    assert (s["when"], s["place"], s["foreign"]) == (None, None, 0)


def test_addresses(spark):
    base = "https://h.example/a/b/c?x=1"
    cases = {"d": "/a/b/d", "../d": "/a/d", "../../../d": "/d", "/d": "/d", "?q": "/a/b/c?q", "./d": "/a/b/d", "d/../e": "/a/b/e", "HTTPS://H.example/a/#x": "/a", "/a/?b=1": "/a?b=1", "/": "/"}
    assert {h: markup.address(h, base) for h in cases} == {h: "https://h.example" + w for h, w in cases.items()}
    assert [markup.address(h, base) for h in ("", None, "#x", "mailto:a@b", "javascript:x()", "http://[bad")] == [None] * 6
    df = spark.createDataFrame([("HTTPS://H.example/a/#x", "https://h.example/a"), ("https://h.example/a/?b=1", "https://h.example/a?b=1"), ("https://h.example", "https://h.example"), ("/a", None)], "u string, w string")
    assert all(r["g"] == r["w"] for r in df.select("w", lp.plain_address(F.col("u")).alias("g")).collect())
