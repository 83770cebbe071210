"""What listing pages and event pages state, read from their element trees (sources.markup)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, host
from ..sources import markup
from ..sources.markup import attr, has_attr, has_word, text_of
from ..sources.texts import linked_event
from .union import first_known

# What counts as a printed date or clock, as a container of events, as a line for the place, as an end.
DATED = (
    r"\b\d{1,2}\s*[:.]\d{2}\s*(?:am|pm)?\b|\b\d{1,2}\s*(?:am|pm)\b|\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"
    r"|\b(?:mon|tue|tues|wed|weds|thu|thur|thurs|fri|sat|sun)(?:day|nesday|rsday|urday)?\b"
    r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|tember|ober|ember)?\b"
)
ANCHOR = rf"[ \t>*•‣●.\-–—#]*(?:{DATED})"
EVENT_TYPE = r"(?i)schema\.org/[a-z]*event\b"
CARD_CLASS = r"(?i)event|card|listing|show|gig|happening"
PLACE_NAME = r"(?i)venue|location|place|where"
PLACE_LABEL = r"(?i)^\s*(?:where|venue|location|place)\s*[:\-–—]\s*"
END_NAME = r"(?i)(?:^|[\s_-])end(?:s|ed|time)?(?:$|[\s_-])"
ROW_TAGS = ("li", "article", "tr", "div", "section")
LEAST_CHARS, MOST_PLACE = 8, 200
#: What is read of an event in linked data.
READ = ("name", "start", "url", "place", "address", "locality")
ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?$"



def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


# addresses -----------------------------------------------------------------------


def plain_address(url: Column) -> Column:
    """A whole http address as links of a tree are: without fragment and slash at the path's end, scheme and host in lower case; null for any other text."""
    head = F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1))
    rest = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^#]*)", 1), r"^(/[^?]*?)/+(\?|$)", "$1$2")
    return F.when(head != "", F.concat(head, rest))


def is_list(url: Column, page: Column) -> Column:
    """Whether an address is a site's root, or the listing page itself whatever its query."""
    path = lambda u: F.regexp_replace(F.regexp_extract(u, r"^[^/]*//[^/?#]*([^?#]*)", 1), "/+$", "")
    return ((path(url) == "") & ~url.contains("?")) | ((host(url) == host(page)) & (path(url) == path(page)))


# segments ------------------------------------------------------------------------


def stated_address(nodes: Column, card: Column) -> Column:
    """The one address that a card declares for itself (itemprop url at its own item), else null.

    The card has to be an item. What belongs to an item within it, and an element that is an item itself, says
    nothing of the card. Two addresses, on one element or on two, and an identity attribute stated
    twice with two values, contradict: the card then has none.
    """
    own = lambda x: x["link"].isNotNull() & (x["scope"] == card["node"]) & ~has_attr(x, "itemscope") & has_word(x, "itemprop", "url")
    stated = lambda within: F.array_distinct(F.transform(F.filter(within, own), lambda x: x["link"]))
    one = lambda within: bound(stated(within), lambda s: F.when((F.size(s) == 1) & ~F.exists(within, lambda x: x["clash"]), F.get(s, F.lit(0))))
    return F.when(has_attr(card, "itemscope"), bound(markup.inside(nodes, card), one))


def _blocks(nodes: Column, cards: Column) -> Column:
    made = F.transform(cards, lambda x: F.struct(text_of(nodes, x).alias("text"), stated_address(nodes, x).alias("address")))
    return F.filter(made, lambda b: F.length(b["text"]) >= LEAST_CHARS)


def _like_a_calendar(blocks: Column) -> Column:
    """Two dated blocks at least, and three in five."""
    dated = F.size(F.filter(blocks, lambda b: b["text"].rlike(f"(?i){DATED}")))
    return (dated >= 2) & (10 * dated >= 6 * F.size(blocks))


def _linked_blocks(nodes: Column) -> Column:
    events = F.filter(F.transform(markup.linked_objects(nodes), lambda t: linked_event(t, "is_event", *READ)), lambda e: e["is_event"])
    line = lambda e: F.concat_ws(" | ", e["name"], e["start"], e["place"], e["address"], e["locality"], e["url"])
    made = F.transform(events, lambda e: F.struct(line(e).alias("text"), plain_address(e["url"]).alias("address")))
    return F.filter(made, lambda b: F.length(b["text"]) >= LEAST_CHARS)


def _anchored(text: Column) -> Column:
    """Pieces of a text cut before lines that begin with a date or clock, what stands before the first with it; none unless there are two."""
    opens = lambda p: F.coalesce(p.rlike(rf"(?i)^{ANCHOR}"), F.lit(False))

    def pieces(parts: Column) -> Column:
        led = ~opens(F.get(parts, F.lit(0)))
        whole = F.when(led & (F.size(parts) > 1), F.concat(F.array(F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))), F.slice(parts, 3, F.size(parts)))).otherwise(parts)
        made = F.filter(F.transform(whole, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) >= LEAST_CHARS)
        return F.when(F.size(F.filter(parts, opens)) >= 2, bound(made, lambda m: F.when(F.size(m) >= 2, m)))

    return F.coalesce(bound(F.filter(F.split(text, rf"(?mi)^(?={ANCHOR})"), lambda p: F.trim(p) != ""), pieces), _none("string"))


def segments(pages: DataFrame, key: str, content: str) -> DataFrame:
    """key, pos, way, text and address of the blocks of events of each page or text.

    Ways, the first that finds a list: linked data (two events), event items (microdata),
    articles, elements whose class names an event, list items (each needs two dated
    blocks, three in five), lines that begin with a date, else the whole content as one block. Of nested
    matches the outermost is one block. An address that two blocks state is dropped from both.
    A null content gives no row, a blank one itself.
    """
    looks = F.coalesce(F.col(content).rlike(r"(?i)<(!doctype|html|head|body|div|p|ul|ol|li|table|tr|article|section|main|span|a|h[1-6]|script)\b"), F.lit(False))
    rows = pages.where(F.col(content).isNotNull()).select(F.col(key).alias("_key"), F.col(content).alias("content"), looks.alias("looks"), F.when(looks, F.col(content)).alias("html"))
    rows, nodes = markup.with_tree(rows, "html"), F.col("nodes")
    tries = [
        ("item", lambda x: F.coalesce(attr(x, "itemtype").rlike(EVENT_TYPE), F.lit(False))), ("article", lambda x: x["tag"] == "article"),
        ("card", lambda x: x["tag"].isin("div", "li", "section") & F.coalesce(attr(x, "class").rlike(CARD_CLASS), F.lit(False))), ("list", lambda x: x["tag"] == "li"),
    ]
    plain = lambda texts: F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("address")))
    lines = _anchored(F.when(F.col("looks"), markup.page_text(nodes)).otherwise(F.col("content")))
    ways = [("linked", _linked_blocks(nodes), F.size("blocks") >= 2), *((name, _blocks(nodes, markup.outermost(nodes, test)), _like_a_calendar(F.col("blocks"))) for name, test in tries), ("lines", plain(lines), F.size("blocks") >= 2)]
    rows = rows.withColumn("c", F.lit(None).cast("struct<way: string, blocks: array<struct<text: string, address: string>>>"))
    for name, blocks, test in ways:  # a way is tried on the pages that no way before it took
        rows = rows.withColumn("blocks", F.when(F.col("c").isNull(), blocks)).withColumn("c", F.when(F.col("c").isNotNull(), F.col("c")).when(test, F.struct(F.lit(name).alias("way"), F.col("blocks").alias("blocks"))))
    chosen = F.coalesce("c", F.struct(F.lit("whole").alias("way"), plain(F.array("content")).alias("blocks")))
    found = rows.select("_key", chosen.alias("c")).select("_key", "c.way", "c.blocks", F.posexplode("c.blocks").alias("pos", "b"))
    shared = F.size(F.filter("blocks", lambda o: o["address"] == F.col("b.address"))) > 1
    return found.select(F.col("_key").alias(key), "pos", "way", "b.text", F.when(~shared, F.col("b.address")).alias("address"))


# rows of a listing page ------------------------------------------------------------


def _first(nodes: Column, x: Column, test: markup.Test) -> Column:
    """The text of the first element within that passes and prints something."""
    texts = F.transform(F.filter(markup.below(nodes, x), test), lambda e: F.coalesce(attr(e, "content"), text_of(nodes, e)))
    return F.get(F.filter(texts, lambda t: t != ""), F.lit(0))


def _fields(nodes: Column, card: Column, own: Column) -> Column:
    """struct title, whens (each printed moment once, in order), when_text, place and address of a card; `own` is the address it is known by."""
    moment = lambda e: F.coalesce(attr(e, "datetime"), attr(e, "content"))
    ends = lambda e: has_word(e, "itemprop", "enddate") | F.coalesce(attr(e, "class").rlike(END_NAME), F.lit(False))
    timed = F.filter(markup.below(nodes, card), lambda e: (e["tag"] == "time") | has_word(e, "itemprop", "startdate", "startdatetime"))
    whens = F.array_distinct(F.filter(F.transform(F.filter(timed, lambda e: ~ends(e)), moment), lambda m: m.rlike(ISO_MOMENT)))
    printed = F.filter(F.transform(F.filter(timed, lambda e: e["tag"] == "time"), lambda e: text_of(nodes, e)), lambda t: t != "")
    placed = lambda e: has_word(e, "itemprop", "location", "address") | F.coalesce(attr(e, "class").rlike(PLACE_NAME), F.lit(False))
    links = F.filter(markup.below(nodes, card), lambda e: (e["tag"] == "a") & e["link"].isNotNull())
    name = _first(nodes, card, lambda e: has_word(e, "itemprop", "name") & ~F.coalesce(e["scope"] > card["node"], F.lit(False)))
    title = F.coalesce(name, _first(nodes, card, lambda e: e["tag"].rlike("^h[1-6]$")), _first(nodes, card, lambda e: (e["tag"] == "a") & ~placed(e)))
    return F.struct(
        title.alias("title"), whens.alias("whens"), F.nullif(F.array_join(printed, " "), F.lit("")).alias("when_text"), _first(nodes, card, placed).alias("place"),
        F.coalesce(own, stated_address(nodes, card), F.get(links, F.lit(0))["link"]).alias("address"))


ROW = "struct<title string, whens array<string>, when_text string, place string, address string>"


def listing_rows(pages: DataFrame, key: str, url: str, html: str, patterns: list[tuple[str, str, str]], selectors: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """One row a page (key, url) with tier, structured and printed (arrays of rows as read), furniture and untitled: the ladder of a listing page.

    A page's linked data and event items are rows as they stand. Its printed part is split by
    the first that finds something: links whose address fits a committed pattern (name, host,
    expression over the path) of the page's host, each with the nearest row-shaped element that holds
    this address alone and no structure of the page; else elements that a committed selector (tag,
    whole class names) names, the innermost. Links in the page's own plumbing are counted and left.
    A page with nothing of these is `unsplit`: no row, and a reason.
    """
    nodes, base = F.col("nodes"), F.col("url")
    rows = markup.with_tree(pages.select(F.col(key).alias("_key"), F.col(url).alias("url"), F.col(html).alias("html")), "html", "url")
    rows = rows.withColumn("events", F.filter(F.transform(markup.linked_objects(nodes), lambda t: linked_event(t, "is_event", *READ)), lambda e: e["is_event"]))
    linked = F.transform("events", lambda e: F.struct(
        e["name"].alias("title"), F.array_compact(F.array(e["start"])).alias("whens"), F.lit(None).cast("string").alias("when_text"), F.coalesce(e["place"], e["address"], e["locality"]).alias("place"),
        plain_address(e["url"]).alias("address")).cast(ROW))
    items = markup.outermost(nodes, lambda x: has_attr(x, "itemscope") & F.coalesce(attr(x, "itemtype").rlike(EVENT_TYPE), F.lit(False)))
    rows = rows.withColumn("structured", F.concat(linked, F.transform(items, lambda x: _fields(nodes, x, F.lit(None).cast("string")).cast(ROW))))

    path = lambda u: F.regexp_extract(u, r"^[^/]*//[^/?#]*([^?#]*)", 1)
    fits = lambda u: reduce(lambda a, b: a | b, [(host(base) == h) & (host(u) == h) & path(u).rlike(f"^(?:{p})$") for _, h, p in patterns], F.lit(False))
    links = F.transform(F.filter(nodes, lambda x: (x["tag"] == "a") & x["link"].isNotNull()), lambda x: F.struct(x["node"].alias("node"), x["aside"].alias("aside"), x["link"].alias("url")))
    rows = rows.withColumn("hits", F.filter(links, lambda h: fits(h["url"])))
    rows = rows.withColumn("furniture", F.size(F.filter("hits", lambda h: h["aside"]))).withColumn("hits", F.filter("hits", lambda h: ~h["aside"]))
    rows = rows.withColumn("cards", F.transform("hits", lambda h: F.struct(_row_around(nodes, F.col("hits"), h).alias("card"), h["url"].alias("url"))))
    permalink = F.transform("cards", lambda c: _fields(nodes, c["card"], c["url"]).cast(ROW))
    chosen = markup.innermost(nodes, lambda x: reduce(lambda a, b: a | b, [(x["tag"] == t) & markup.has_classes(x, c) for t, c in selectors], F.lit(False)))
    selected = F.transform(chosen, lambda x: _fields(nodes, x, F.lit(None).cast("string")).cast(ROW))
    rows = rows.withColumn("printed", F.when(F.size("hits") > 0, permalink).otherwise(selected))
    way = F.when(F.size("hits") > 0, "permalink").when(F.size("printed") > 0, "selector")
    tier = F.when((F.size("structured") > 0) & way.isNotNull(), F.concat(F.lit("structured+"), way)).otherwise(F.coalesce(way, F.when(F.size("structured") > 0, "structured"), F.lit("unsplit")))
    untitled = F.size(F.filter(F.concat("structured", "printed"), lambda r: r["title"].isNull()))
    return rows.select(F.col("_key").alias(key), "url", tier.alias("tier"), "structured", "printed", "furniture", untitled.alias("untitled"))


def _row_around(nodes: Column, hits: Column, hit: Column) -> Column:
    """The nearest row-shaped element around a hit that holds its address alone and no structure of the page; the hit itself without one."""
    def around(limits: Column) -> Column:
        between = F.slice(nodes, limits["lower"] + 2, hit["node"] - limits["lower"] - 1)
        return F.filter(between, lambda x: (x["last"] >= hit["node"]) & (x["last"] < limits["upper"]) & x["tag"].isin(*ROW_TAGS) & ~x["page"] & ~x["paged"])

    other = F.filter(hits, lambda o: o["url"] != hit["url"])
    return F.coalesce(F.try_element_at(bound(_limits(other, hit), around), F.lit(-1)), F.get(nodes, hit["node"]))


def _limits(other: Column, x: Column) -> Column:
    """struct lower, upper: the numbers of the last of the others before an element and of the first behind it."""
    before, behind = F.filter(other, lambda o: o["node"] < x["node"]), F.filter(other, lambda o: o["node"] > x["node"])
    lower, upper = F.array_max(F.transform(before, lambda o: o["node"])), F.array_min(F.transform(behind, lambda o: o["node"]))
    return F.struct(F.coalesce(lower, F.lit(-1)).alias("lower"), F.coalesce(upper, F.lit(2**31 - 1)).alias("upper"))


def page_rows(read: DataFrame, key: str) -> DataFrame:
    """The rows of listing_rows, one for each page and occurrence: key, pos, tier, title, when, when_text, place, address.

    A row with several printed moments is a row for each. An address that is the list's own, or a
    site's root, is dropped, not the row. Readings of one occurrence (equal address and moment, or
    without an address equal title and moment) are one row, whose holes later readings fill; a row without a title is left out.
    """
    every = read.select(key, "url", "tier", F.posexplode(F.concat("structured", "printed")).alias("nth", "r")).where("r.title is not null")
    each = every.select(key, "url", "tier", "nth", "r.*", F.posexplode_outer("r.whens").alias("night", "when"))
    address = F.when(~F.coalesce(is_list(F.col("address"), F.col("url")), F.lit(False)), F.col("address"))
    each = each.withColumn("address", address).withColumn("at", F.struct("nth", F.coalesce("night", F.lit(0)).alias("night")))
    own = F.when(F.col("address").isNotNull(), F.concat(F.lit("u"), "address")).otherwise(F.concat(F.lit("t"), F.lower("title")))
    spot = F.when(F.col("address").isNotNull(), F.coalesce("when", F.lit(""))).otherwise(F.coalesce("when", "when_text", F.lit("")))
    merged = each.groupBy(key, "tier", own.alias("own"), spot.alias("spot")).agg(
        F.min("at").alias("at"), *(first_known(c, "at").alias(c) for c in ("title", "when", "when_text", "place", "address")))
    return merged.select(key, "tier", F.col("at.nth").alias("nth"), F.col("at.night").alias("night"), "title", "when", "when_text", "place", "address")


def page_reasons(read: DataFrame, key: str) -> DataFrame:
    """key, tier, structured, printed, untitled, furniture, own_list (rows that named the list itself) and reason of each page: why it gave no row, else null."""
    rows = F.concat("structured", "printed")
    own = F.size(F.filter(rows, lambda r: F.coalesce(is_list(r["address"], F.col("url")), F.lit(False))))
    reason = F.when(F.col("tier") == "unsplit", F.when(F.col("furniture") > 0, "links_in_plumbing_only").otherwise("no_identity_declared")).when(F.col("untitled") == F.size(rows), "no_title")
    return read.select(key, "tier", F.size("structured").alias("structured"), F.size("printed").alias("printed"), "untitled", "furniture", own.alias("own_list"), reason.alias("reason"))


# the page of one event --------------------------------------------------------------


def _foreign_cards(nodes: Column, links: Column) -> Column:
    """Spans (node, last) of the outermost elements that hold links to one other page of the site, none to this page, and no structure of the page."""

    def span(a: Column) -> Column:
        def around(limits: Column) -> Column:
            between = F.slice(nodes, limits["lower"] + 2, a["node"] - limits["lower"])
            return F.get(F.filter(between, lambda x: (x["last"] >= a["node"]) & (x["last"] < limits["upper"]) & ~x["tag"].isin("html", "body") & ~x["paged"]), F.lit(0))

        other = F.filter(links, lambda o: (o["url"] != a["url"]) | o["own"])
        return bound(bound(_limits(other, a), around), lambda x: F.struct(x["node"].alias("node"), x["last"].alias("last")))

    return F.filter(F.transform(F.filter(links, lambda a: ~a["own"]), span), lambda s: s["node"].isNotNull())


def event_statements(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """What each page of one event states of itself: key, when, precision, source, dates, conflict, end_only, clock_only, place, place_source, foreign.

    The linked data counts if one event is addressed to the page, or the only one names no address. Of
    printed moments (time elements and start or end dates) those in the page's plumbing, and those in a
    card of another page of the site, are foreign. Several dates give no `when`, and `dates` lists them; so
    does a printed moment that contradicts the linked data (`conflict`). Only ends (`end_only`) or
    only a clock (`clock_only`) are no start. The place is that of the linked data, else an item
    property, else the first element named for it, at most 200 characters. A null page states nothing.
    """
    nodes, marked, here = F.col("nodes"), F.col("marked"), F.col("here")
    rows = markup.with_tree(pages.select(F.col(key).alias("_key"), F.col(url).alias("url"), F.col(html).alias("html")), "html", "url", ("node", "last", "tag", "text", "paged"), ("node", "last", "tag", "attrs", "link", "aside"))
    rows = rows.withColumns({"here": plain_address(F.col("url")), "site": host(F.col("url"))})
    links = F.transform(F.filter(marked, lambda x: (x["tag"] == "a") & x["link"].isNotNull()), lambda x: F.struct(x["node"].alias("node"), x["link"].alias("url"), (x["link"] == here).alias("own")))
    rows = rows.withColumns({"links": F.filter(links, lambda a: a["own"] | (host(a["url"]) == F.col("site"))), "objects": markup.linked_objects(nodes, marked)}).withColumn("cards", _foreign_cards(nodes, F.col("links")))
    elsewhere = lambda x: x["aside"] | F.exists("cards", lambda s: (s["node"] <= x["node"]) & (x["node"] <= s["last"]))

    raw = lambda x: F.coalesce(attr(x, "datetime"), attr(x, "content"))
    marks = F.filter(marked, lambda x: ((x["tag"] == "time") | has_word(x, "itemprop", "startdate", "enddate")) & raw(x).isNotNull())
    names = lambda x: F.concat_ws(" ", attr(x, "class"), attr(x, "id"), attr(x, "itemprop"))
    prop = lambda x, p: has_word(x, "itemprop", p)
    said = F.transform(marks, lambda x: F.struct(
        raw(x).alias("raw"), elsewhere(x).alias("foreign"), raw(x).rlike(ISO_MOMENT).alias("dated"), raw(x).rlike(r"^\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp]\.?[Mm]\.?)?$").alias("clock"),
        (prop(x, "startdate") | (~prop(x, "enddate") & ~names(x).rlike(END_NAME))).alias("start")))
    placed = F.filter(marked, lambda x: ~elsewhere(x) & (prop(x, "location") | names(x).rlike(PLACE_NAME)))
    place = lambda x: F.regexp_replace(F.coalesce(attr(x, "content"), text_of(nodes, x)), PLACE_LABEL, "")
    events = F.filter(F.transform("objects", lambda t: linked_event(t, "is_event", *READ)), lambda e: e["is_event"])
    rows = rows.select("_key", "here", events.alias("events"), said.alias("said"), F.transform(placed, lambda x: F.struct(prop(x, "location").alias("item"), place(x).alias("text"))).alias("placed"))

    mine = F.filter("events", lambda e: F.coalesce(plain_address(e["url"]) == here, F.lit(False)))
    event = bound(mine, lambda m: F.when(F.size(m) == 1, F.get(m, F.lit(0))).when((F.size("events") == 1) & F.get("events", F.lit(0))["url"].isNull(), F.get("events", F.lit(0))))
    rows = rows.withColumns({"event": event, "own": F.filter("said", lambda m: m["dated"] & ~m["foreign"])})
    rows = rows.withColumns({"nights": F.sort_array(F.array_distinct(F.transform("own", lambda m: F.substring(m["raw"], 1, 10)))), "starts": F.filter("own", lambda m: m["start"])})
    rows = rows.withColumn("timed", F.array_distinct(F.transform(F.filter("starts", lambda m: F.length(m["raw"]) > 10), lambda m: m["raw"])))
    own, dates, starts, timed = (F.col(c) for c in ("own", "nights", "starts", "timed"))
    printed = F.when((F.size(dates) == 1) & (F.size(starts) > 0), F.when(F.size(timed) == 1, F.get(timed, F.lit(0))).otherwise(F.get(dates, F.lit(0))))
    stated = F.col("event.start")
    moment = lambda t: F.when(F.length(t) > 10, F.coalesce(F.date_format(F.try_to_timestamp(t), "yyyy-MM-dd HH:mm"), t)).otherwise(t)
    agrees = (moment(stated) == moment(F.col("printed"))) | (F.least(F.length(stated), F.length("printed")) <= 10) & (F.substring(stated, 1, 10) == F.substring("printed", 1, 10))
    rows = rows.withColumns({"dates": F.when(F.size(dates) > 1, dates).otherwise(_none("string")), "printed": printed, "end_only": (F.size(own) > 0) & (F.size(starts) == 0) & (F.size(dates) == 1)})
    conflict = F.coalesce(stated.isNotNull() & ((F.size("dates") > 0) | ~agrees), F.lit(False))
    rows = rows.withColumn("conflict", conflict)
    when = F.when(~F.col("conflict"), F.coalesce(stated, "printed"))
    short = lambda item: F.get(F.filter(F.transform(F.filter("placed", lambda p: p["item"] == F.lit(item)), lambda p: p["text"]), lambda t: (t != "") & (F.length(t) <= MOST_PLACE)), F.lit(0))
    linked = F.nullif(F.concat_ws(", ", F.col("event.place"), F.coalesce(F.col("event.address"), F.col("event.locality"))), F.lit(""))
    rows = rows.withColumns({"when": when, "linked": F.substring(linked, 1, MOST_PLACE), "item": short(True), "line": short(False)})
    foreign = F.size(F.filter("said", lambda m: m["foreign"])) + F.size("events") - F.when(F.col("event").isNotNull(), 1).otherwise(0)
    return rows.select(
        F.col("_key").alias(key), "when", F.when(F.col("when").isNotNull(), F.when(F.length("when") > 10, "minute").otherwise("date")).alias("precision"),
        F.when(F.col("when").isNotNull(), F.when(stated.isNotNull(), "linked").otherwise("printed")).alias("source"), "dates", "conflict", (F.col("when").isNull() & F.col("end_only")).alias("end_only"),
        (F.col("when").isNull() & F.exists("said", lambda m: m["clock"] & ~m["foreign"])).alias("clock_only"), F.coalesce("linked", "item", "line").alias("place"),
        F.when(F.col("linked").isNotNull(), "linked").when(F.col("item").isNotNull(), "item").when(F.col("line").isNotNull(), "line").alias("place_source"), foreign.alias("foreign"))
