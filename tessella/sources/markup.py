"""Pages as flat element trees, one array a page, and what expressions need to read them.

An element's place in the array is its number in page order, and `last` is the number of
the last node within it, so everything below an element is a slice, containment is a
comparison of numbers, and the rules of a reader are column expressions on the row of
its page: nothing is shuffled, and a page is one row however its key repeats.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit, urlunsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound
from .staging import spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINES = frozenset("p div li ul ol article section tr table h1 h2 h3 h4 h5 h6 br hr header footer dd dt".split())
SECTIONS = frozenset("article section aside nav li tr".split())
#: Attributes that say which listing an element is of; stated twice with two values they say nothing.
IDENTITY = frozenset(("href", "content", "itemprop"))
TEXT, RAW = "#text", "#raw"
FIELDS = [
    ("node", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("link", pa.string()), ("scope", pa.int32()), ("line", pa.int32()),
    ("aside", pa.bool_()), ("page", pa.bool_()), ("paged", pa.bool_()), ("clash", pa.bool_()),
]
KINDS = dict(f.split(" ", 1) for f in "node int|last int|tag string|attrs map<string, string>|text string|link string|scope int|line int|aside boolean|page boolean|paged boolean|clash boolean".split("|"))
#: White space of an attribute, which is made single before expressions read it.
_BLANKS = re.compile("[ \t\n\x0b\f\r\xa0]+")
#: Addresses that need no joining: a path from the root without dots, seen from a page of a host in lower case.
_PLAIN_PATH, _PLAIN_ROOT = re.compile("(?:/[A-Za-z0-9_-]+)+/?"), re.compile(r"(https?://[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)(?:[/?#]|$)")
#: Pages, and bytes of several pages, that a Python worker turns into trees at a time.
SLICE, SLICE_BYTES = 256, 1 << 18


def address(href: str | None, base: str | None = None) -> str | None:
    """What `href` names as seen from the page `base` (as it is without one): without fragment, scheme and host in lower case, no slash at the path's end.

    Fragments and schemes other than http name no page: null, as does what can't be read.
    """
    if href and base and _PLAIN_PATH.fullmatch(href) and (root := _PLAIN_ROOT.match(base)):
        return root[1] + href.rstrip("/")
    href = " ".join((href or "").split())
    if not href or href.startswith("#"):
        return None
    try:
        parts = urlsplit(href)
        if parts.scheme and parts.scheme.lower() not in ("http", "https"):
            return None
        if base is None:
            return href
        parts = urlsplit(urljoin(base, href))
        return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path.rstrip("/") or parts.path[:1], parts.query, ""))
    except ValueError:
        return None


class _Nodes:
    """Nodes in page order: elements, texts, and the raw content of scripts and styles: `rows` of `_FIXED` fields, `attrs` as pairs, with `last` and `paged` beside them.

    link: the address that an element names (href, or the content of a meta with itemprop url), as seen from
    the page. scope: the nearest element around with an itemscope. line: grows where a new line begins. aside: within
    a nav, an aside, or a header or footer of the page itself. page, paged: is, or holds, structure
    of the page rather than of a part. clash: states an identity attribute, or its address, twice with two values.
    An end tag closes the nearest open element of its name, and is ignored without one; what is open at the end ends there.
    """

    def __init__(self, base: str | None) -> None:
        self.base, self.now = base, 0
        self.rows: list[tuple] = []
        self.last: list[int] = []
        self.paged: list[bool] = []
        # numbers and names of the open elements; the scope and the aside of what comes next, under all open elements
        self.open: list[int] = []
        self.names: list[str] = []
        self.around: list[tuple[int | None, bool]] = [(None, False)]

    def element(self, tag: str, stated: tuple, closed: bool) -> None:
        """An element with what `_stated` tells of its attributes; `closed` if it can hold nothing."""
        attrs, clash, item, href, content = stated
        if tag in LINES:
            self.now += 1
        link = None
        if href or content:
            found = {x for x in (address(href, self.base), address(content, self.base)) if x is not None}
            clash, link = clash or len(found) > 1, min(found, default=None)
        own = tag in ("header", "footer") and not any(x in SECTIONS for x in self.names)
        at, (scope, aside) = len(self.rows), self.around[-1]
        aside = aside or own or tag in _ASIDE
        self.rows.append((tag, attrs, None, link, scope, self.now, aside, own or tag in _PAGE, clash))
        self.last.append(at)
        self.paged.append(False)
        if not closed:
            self.open.append(at)
            self.names.append(tag)
            self.around.append((at if item else scope, aside))

    def end(self, tag: str) -> None:
        if tag in LINES:
            self.now += 1
        if self.names and self.names[-1] == tag:
            self.close(len(self.names) - 1)
        elif tag in self.names:
            self.close(len(self.names) - 1 - self.names[::-1].index(tag))

    def close(self, at: int) -> None:
        """Everything open from the place `at` on ends here."""
        end = len(self.rows) - 1
        for i in range(len(self.open) - 1, at - 1, -1):
            x = self.open[i]
            self.last[x] = end
            if i and (self.paged[x] or self.rows[x][_PAGE_AT]):
                self.paged[self.open[i - 1]] = True
        del self.open[at:], self.names[at:], self.around[at + 1 :]

    def data(self, text: str) -> None:
        raw = bool(self.names) and self.names[-1] in _RAW_TAGS
        scope, aside = self.around[-1]
        self.last.append(len(self.rows))
        self.paged.append(False)
        self.rows.append((RAW if raw else TEXT, (), text, None, scope, self.now, aside, False, False))


_FIXED = ("tag", "attrs", "text", "link", "scope", "line", "aside", "page", "clash")
_PAGE_AT = _FIXED.index("page")
_PAGE, _ASIDE, _RAW_TAGS = frozenset(("body", "main", "h1", "nav", "aside")), ("nav", "aside"), ("script", "style")


def _stated(attrs: list[tuple[str, str | None]]) -> tuple:
    """The attributes as pairs with single blanks, whether they clash, whether they make an item, and the two that may name an address."""
    found: dict[str, str] = {}
    clash = False
    for key, value in attrs:
        key, value = key.lower(), value or ""
        clash |= key in IDENTITY and found.get(key, value) != value
        found[key] = value
    content = found.get("content") if "url" in found.get("itemprop", "").lower().split() else None
    return tuple((k, _BLANKS.sub(" ", v).strip(" ")) for k, v in found.items()), clash, "itemscope" in found, found.get("href"), content


class _Any(HTMLParser):
    """Feeds whatever the library reads into `nodes`."""

    def __init__(self, nodes: _Nodes) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = nodes

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.nodes.element(tag, _stated(attrs), tag in VOID)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.nodes.element(tag, _stated(attrs), True)

    def handle_endtag(self, tag: str) -> None:
        self.nodes.end(tag)

    def handle_data(self, data: str) -> None:
        self.nodes.data(data)


#: Pages of these tokens alone are read without the library's parser, which takes several times as long: text, end tags, start tags with plain attributes in double quotes.
_TOKEN = re.compile(r'([^<]+)|<(?:/([a-z][a-z0-9]*)>|([a-z][a-z0-9]*)((?: [a-z][a-z-]*(?:="[^"&\0]*")?)*)( ?/)?>)')
_ATTR = re.compile(r' ([a-z][a-z-]*)(?:="([^"]*)")?')
#: Elements whose content the library may read by rules of its own.
_SPECIAL = frozenset("title textarea plaintext iframe noembed noframes noscript xmp".split())


@lru_cache(maxsize=1 << 14)
def _plain_attrs(text: str) -> tuple:
    return _stated(_ATTR.findall(text))


def _plain(html: str, nodes: _Nodes) -> bool:
    """Whether the page is of plain tokens alone, all of which are then in `nodes`."""
    at, raw = 0, None
    for m in _TOKEN.finditer(html):
        if m.start() != at:
            return False
        at = m.end()
        text, end, tag, attrs, closed = m.groups()
        if text is not None:
            nodes.data(text if raw or "&" not in text else unescape(text))
        elif raw and end != raw:
            return False
        elif end is not None:
            nodes.end(end)
            raw = None
        elif tag in _SPECIAL:
            return False
        else:
            nodes.element(tag, _plain_attrs(attrs), closed is not None or tag in VOID)
            raw = tag if tag in _RAW_TAGS and closed is None else None
    return at == len(html) and not raw


#: A tag of plain tokens, what stands between its angle brackets.
_MARK = re.compile(r'/([a-z][a-z0-9]*)|([a-z][a-z0-9]*)((?: [a-z][a-z-]*(?:="[^"&\0]*")?)*)( ?/)?')
#: Skeletons and tags up to so many characters are kept, for pages of one site repeat them.
_KEPT_SKELETON, _KEPT_MARK = 4096, 256
_SHAPE = {"tag", "node", "last", "scope", "line", "aside", "page", "paged"}


class _Page(NamedTuple):
    """A page's nodes: what depends on its tags alone (`_SHAPE`), and texts, attributes (number for each node, names, values), links and clashes (those of a few nodes)."""

    shape: pa.StructArray
    text: list[str | None]
    counts: list[int]
    keys: list[str]
    said: list[str]
    named: dict[int, tuple[str | None, bool]]

    @property
    def rows(self) -> list[tuple]:
        ends = list(accumulate(self.counts))
        attrs = [tuple(zip(self.keys[e - n : e], self.said[e - n : e])) for e, n in zip(ends, self.counts)]
        named = [self.named.get(i, (None, False)) for i in range(len(self.text))]
        own = zip(*(self.shape.field(c).to_pylist() for c in ("tag", "scope", "line", "aside", "page")))
        return [(tag, a, text, link, scope, line, aside, page, clash) for (tag, scope, line, aside, page), a, text, (link, clash) in zip(own, attrs, self.text, named)]

    @property
    def last(self) -> list[int]:
        return self.shape.field("last").to_pylist()

    @property
    def paged(self) -> list[bool]:
        return self.shape.field("paged").to_pylist()


def _shape_of(nodes: _Nodes) -> pa.StructArray:
    values = {**dict(zip(_FIXED, list(zip(*nodes.rows)) or [()] * len(_FIXED))), "node": range(len(nodes.rows)), "last": nodes.last, "paged": nodes.paged}
    kept = [f for f in FIELDS if f[0] in _SHAPE]
    return pa.StructArray.from_arrays([pa.array(values[name], kind) for name, kind in kept], fields=[pa.field(*f) for f in kept])


@lru_cache(maxsize=1 << 10)
def _shape(skeleton: str) -> pa.StructArray | None:
    """The shape of a page of these tags; null if they aren't plain."""
    nodes = _Nodes(None)
    if not _plain(skeleton, nodes):
        return None
    nodes.close(0)
    return _shape_of(nodes)


@lru_cache(maxsize=1 << 14)
def _mark(mark: str) -> tuple | None:
    """The tag as it stands in a skeleton, whether its text is raw, and for a start tag names and values of its attributes, and what may name an address or clash; null if it isn't plain."""
    m = _MARK.fullmatch(mark)
    if not m:
        return None
    end, tag, attrs, closed = m.groups()
    if end:
        return f"</{end}>", False, None, None, None
    pairs, clash, item, href, content = _stated(_ATTR.findall(attrs))
    code = f"<{tag}{' itemscope' * item}{'/' if closed else ''}>"
    return code, tag in _RAW_TAGS and not closed, tuple(k for k, _ in pairs), tuple(v for _, v in pairs), (clash, href, content) if clash or href or content else None


def _filled(html: str, base: str | None) -> _Page | None:
    """A page of plain tokens whose attributes hold no angle bracket: the shape of its skeleton, filled; null for any other page."""
    head, *pieces = html.split("<")
    skeleton, text, counts, keys, said, named = [], [], [], [], [], {}
    if head:
        skeleton.append("x")
        text.append(unescape(head))
        counts.append(0)
    for piece in pieces:
        mark, closed, rest = piece.partition(">")
        found = closed and (_mark(mark) if len(mark) <= _KEPT_MARK else _mark.__wrapped__(mark))
        if not found:
            return None
        code, raw, names, values, identity = found
        skeleton.append(code)
        if names is not None:
            if identity:
                clash, href, content = identity
                links = {x for x in (address(href, base), address(content, base)) if x is not None} if href or content else ()
                named[len(text)] = min(links, default=None), clash or len(links) > 1
            text.append(None)
            counts.append(len(names))
            keys += names
            said += values
        if rest:
            skeleton.append("x")
            text.append(rest if raw or "&" not in rest else unescape(rest))
            counts.append(0)
    tags = "".join(skeleton)
    shape = _shape(tags) if len(tags) <= _KEPT_SKELETON else _shape.__wrapped__(tags)
    return None if shape is None else _Page(shape, text, counts, keys, said, named)


def _read(html: str | None, base: str | None) -> _Page:
    if html and (page := _filled(html, base)):
        return page
    nodes = _Nodes(base)
    if html and not _plain(html, nodes):
        nodes = _Nodes(base)
        parser = _Any(nodes)
        parser.feed(html)
        parser.close()
    nodes.close(0)
    pairs = [pair for r in nodes.rows for pair in r[1]]
    named = {i: (r[3], r[-1]) for i, r in enumerate(nodes.rows) if r[3] is not None or r[-1]}
    return _Page(_shape_of(nodes), [r[2] for r in nodes.rows], [len(r[1]) for r in nodes.rows], [k for k, _ in pairs], [v for _, v in pairs], named)


def tree(html: str | None, base: str | None = None) -> list[dict]:
    """The nodes of a page at the address `base`; none of null."""
    page = _read(html, base)
    return [{"node": i, "last": n, "paged": p, **dict(zip(_FIXED, r))} | {"attrs": dict(r[1])} for i, (r, n, p) in enumerate(zip(page.rows, page.last, page.paged))]


def _columns(pages: list[_Page], fields: Sequence[str], marked: Sequence[str]) -> list[pa.Array]:
    """The nodes of each page as an array with these fields, and those with attributes as another with the fields `marked`, if there are any."""
    every, offsets = chain.from_iterable, np.cumsum([0, *(len(p.text) for p in pages)], dtype=np.int32)
    link, clash = [None] * int(offsets[-1]), [False] * int(offsets[-1])
    for start, page in zip(offsets.tolist(), pages):
        for i, said in page.named.items():
            link[start + i], clash[start + i] = said
    shape = pa.concat_arrays([p.shape for p in pages])
    made = {f.name: shape.field(f.name) for f in shape.type} | {"link": pa.array(link, pa.string()), "clash": pa.array(clash, pa.bool_()), "text": pa.array(list(every(p.text for p in pages)), pa.string())}
    counts = np.fromiter(every(p.counts for p in pages), np.int32, int(offsets[-1]))
    keys, said = (pa.array(list(every(x)), pa.string()) for x in ((p.keys for p in pages), (p.said for p in pages)))
    at = np.flatnonzero(counts)

    def listed(names: Sequence[str], some: np.ndarray | None = None) -> pa.Array:
        """Of all nodes, or of `some`."""
        number, where = (counts, offsets) if some is None else (counts[some], np.searchsorted(some, offsets).astype(np.int32))
        ends = np.cumsum([0, *number], dtype=np.int32)
        values = [pa.MapArray.from_arrays(ends, keys, said) if n == "attrs" else made[n] if some is None else made[n].take(pa.array(some)) for n in names]
        return pa.ListArray.from_arrays(where, pa.StructArray.from_arrays(values, fields=[pa.field(n, dict(FIELDS)[n]) for n in names]))

    return [listed(fields), *([listed(marked, at)] if marked else [])]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Where slices of pages of these sizes begin and end: SLICE pages at most, and SLICE_BYTES unless one page alone has more."""
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and (i - lo >= SLICE or held + size > SLICE_BYTES):
            yield lo, i
            lo, held = i, 0
        held += size
    if sizes:
        yield lo, len(sizes)


def with_tree(pages: DataFrame, html: str, url: str | None = None, fields: Sequence[str] = tuple(f[0] for f in FIELDS), marked: Sequence[str] = ()) -> DataFrame:
    """`pages` with `nodes`, the element tree of the column `html`, instead of it; a null or empty page has none. `url` names the column of the page's address.

    A reader that needs some of the nodes' fields names them in `fields`; those of the elements with attributes, which are few of a page,
    may come in an array of their own, `marked`, with the fields named there.
    """
    columns = [c for c in pages.columns if c != html]
    added = {"nodes": fields, **({"marked": marked} if marked else {})}
    schema = T.StructType([*(pages.schema[c] for c in columns), *(T.StructField(c, T._parse_datatype_string(f"array<struct<{', '.join(f'{n} {KINDS[n]}' for n in names)}>>")) for c, names in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo, hi in _slices(pc.fill_null(pc.binary_length(big.column(html)), 0).to_pylist()):
                batch = big.slice(lo, hi - lo)
                bases = batch.column(url).to_pylist() if url else [None] * batch.num_rows
                found = _columns([_read(h, b) for h, b in zip(batch.column(html).to_pylist(), bases)], fields, marked)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], names=[*columns, *added])

    return spread(pages).mapInArrow(run, schema)


def plain_references(html: Column) -> Column:
    """A page whose ampersands are text except in &lt; &gt; and &amp;: any other reference, or one without a semicolon, is read as it is written."""
    return F.regexp_replace(html, "&(?!(?:lt|gt|amp);)", "&amp;")


# expressions over `nodes` --------------------------------------------------------

Test = Callable[[Column], Column]


def below(nodes: Column, x: Column) -> Column:
    """The element and all within it."""
    return F.slice(nodes, x["node"] + 1, x["last"] - x["node"] + 1)


def inside(nodes: Column, x: Column) -> Column:
    return F.slice(nodes, x["node"] + 2, x["last"] - x["node"])


def squeezed(text: Column) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def text_of(nodes: Column, x: Column) -> Column:
    """The printed text of an element, scripts and styles left out."""
    texts = F.filter(below(nodes, x), lambda t: t["tag"] == TEXT)
    return squeezed(F.array_join(F.transform(texts, lambda t: t["text"]), " "))


def page_text(nodes: Column) -> Column:
    """The printed text of a page, with a line end wherever a block begins or ends."""
    first = lambda texts, t, i: (i == 0) | (t["line"] == F.get(texts, i - 1)["line"])
    lines = lambda texts: F.transform(texts, lambda t, i: F.when(first(texts, t, i), t["text"]).otherwise(F.concat(F.lit("\n"), t["text"])))
    return F.array_join(bound(F.filter(nodes, lambda t: t["tag"] == TEXT), lines), "")


def outermost(nodes: Column, test: Test) -> Column:
    """The elements that pass, without those within another one that passes."""
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<int>").alias("found"))
    step = lambda acc, x: F.when(x["node"] > acc["end"], F.struct(x["last"].alias("end"), F.concat(acc["found"], F.array(x["node"])).alias("found"))).otherwise(acc)
    found = F.aggregate(F.filter(nodes, test), start, step, lambda acc: acc["found"])
    return F.transform(found, lambda i: F.get(nodes, i))


def innermost(nodes: Column, test: Test) -> Column:
    """The elements that pass and hold no other one that passes."""
    return bound(F.filter(nodes, test), lambda found: F.filter(found, lambda x, i: F.coalesce(F.get(found, i + 1)["node"] > x["last"], F.lit(True))))


def attr(x: Column, name: str) -> Column:
    """A trimmed attribute; null if it isn't there or is empty."""
    return F.nullif(F.try_element_at(x["attrs"], F.lit(name)), F.lit(""))


def has_attr(x: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(x["attrs"], name), F.lit(False))


def has_word(x: Column, name: str, *words: str) -> Column:
    """Whether one of the words (ASCII, without marks of expressions) is among an attribute's, in any case."""
    return F.coalesce(F.try_element_at(x["attrs"], F.lit(name)).rlike(rf"(?i)(?:\A| )(?:{'|'.join(words)})(?: |\z)"), F.lit(False))


def has_classes(x: Column, classes: tuple[str, ...]) -> Column:
    """Whether all of the classes are among the element's, as whole names."""
    own = F.coalesce(F.split(attr(x, "class"), " "), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*map(F.lit, classes)), own)) == 0 if classes else F.lit(True)


def linked_objects(nodes: Column, marked: Column | None = None) -> Column:
    """JSON texts of all objects of the linked-data scripts (those of the elements `marked`, if given): a script is an object or a list, and either may hold @graph lists, four levels deep; a malformed script is left out."""
    scripts = F.filter(nodes if marked is None else marked, lambda x: (x["tag"] == "script") & F.coalesce(attr(x, "type").rlike("(?i)^application/ld\\+json"), F.lit(False)) & (x["last"] > x["node"]))
    return json_objects(F.transform(scripts, lambda x: F.get(nodes, x["node"] + 1)["text"]))


def json_objects(texts: Column) -> Column:
    """The objects within JSON texts: of lists, and of lists under @graph, four levels deep."""
    listed = lambda t: F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))
    found = F.transform(texts, lambda t: F.trim(t))
    for _ in range(4):
        spread = lambda t: F.when(t.startswith("["), listed(t)).otherwise(F.array(t))
        found = F.filter(F.flatten(F.transform(found, spread)), lambda t: t.isNotNull())
        graph = lambda t: F.when(t.startswith("{"), listed(F.get_json_object(t, "$['@graph']"))).otherwise(F.array().cast("array<string>"))
        # an object that has been opened is marked by a blank, so that its graph is opened once
        found = F.flatten(F.transform(found, lambda t: F.concat(F.array(F.when(t.startswith("{"), F.concat(F.lit(" "), t)).otherwise(t)), graph(t))))
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t.startswith("{") & F.get_json_object(t, "$").isNotNull())
