"""Maximal periodic runs of words, by tandem repeats in a suffix tree.

Texts are taken many at a time: equal words of one text share a symbol, words of
different texts never do, and a symbol of its own ends each text, so one suffix
tree holds them side by side. The tree is the sorted suffixes with their common
prefixes; an inner node is an interval of them.

1. Leaf lists: at every inner node v of depth d, all leaves but those of its
   largest child are taken (the smaller halves, n log n in all). With such a leaf i, i + d
   or i - d below v as well means two equal strings of d words side by side.
2. Such a pair branches if the next word breaks it; each maximal run has one that ends with it.
3. Rotation: branching repeats are carried to the left for as long as the words agree
   (doubling steps over names of 2^l words), which gives the run's start.
4. Merging: what has the same start and end is one run; its smallest period stays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, split_words

#: Words whose suffixes are sorted together; a longer text is taken alone.
BATCH_WORDS = 1 << 17


def sort_suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and for each l the names of the strings of 2^l symbols (equal names for equal strings).

    Each text ends in a symbol that occurs nowhere else. Only suffixes that are not yet
    told apart are sorted again, by the name of what follows their known part.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    slots, key = np.arange(n), symbols[order]
    rank, known = np.empty(n, np.int32 if n < 1 << 31 else np.int64), 0
    levels: list[np.ndarray] = []
    while True:
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[order[slots]] = np.maximum.accumulate(np.where(head, slots, 0))
        levels.append(rank)
        slots = slots[~(head & np.append(head[1:], True))]
        if not len(slots):
            return order, levels
        known = 2 * known or 1
        at = order[slots]
        key = rank[at].astype(np.int64) * n + rank[at + known]
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` and the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    near = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[near - 1], order[near]
    length = np.zeros(len(near), np.int64)
    for l in reversed(range(len(levels))):
        length += (levels[l][a + length] == levels[l][b + length]).astype(np.int64) << l
    out[near] = length
    return out


def inner_nodes(prefixes: np.ndarray) -> np.ndarray:
    """Rows (depth, first slot, end slot, first and end slot of the largest child) of the inner nodes below the root."""
    inside = prefixes > 0
    ends = np.flatnonzero(inside | np.concatenate([[False], inside[:-1]]))
    values = prefixes[ends].tolist()
    ends = ends.tolist()
    if inside[-1:].any():
        ends.append(len(prefixes))
        values.append(0)
    found: list[tuple[int, int, int, int, int]] = []
    depth, first, big, big_end = [], [], [], []  # the open nodes, root side first
    for k, h in zip(ends, values):
        child = k - 1
        while depth and depth[-1] > h:
            d, lo, b, e = depth.pop(), first.pop(), big.pop(), big_end.pop()
            if k - child > e - b:
                b, e = child, k
            found.append((d, lo, k, b, e))
            child = lo
        if h:
            if depth and depth[-1] == h:
                if k - child > big_end[-1] - big[-1]:
                    big[-1], big_end[-1] = child, k
            else:
                depth.append(h)
                first.append(child)
                big.append(child)
                big_end.append(k)
    return np.array(found, np.int64).reshape(-1, 5)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi), and which range each is of."""
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    return np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which], which


def branching_repeats(symbols: np.ndarray, order: np.ndarray, slot: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Rows (start, d): d symbols from start come again right behind, and the symbol after that ends it."""
    depth, lo, hi, big, big_end = nodes.T
    found = []
    for a, b in ((lo, big), (big_end, hi)):
        at, v = _spread(a, b)
        at, d = order[at], depth[v]
        for start, other in ((at, at + d), (at - d, at - d)):
            ok = (other >= 0) & (other < len(symbols))
            there = slot[np.where(ok, other, 0)]
            ok &= (there >= lo[v]) & (there < hi[v])
            s, k = start[ok], d[ok]
            ok = symbols[s + k] != symbols[s + 2 * k]
            found.append(np.stack([s[ok], k[ok]], 1))
    return np.unique(np.concatenate(found), axis=0)


def maximal_runs(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of two periods or more, by start, then period.

    Every text within `symbols` ends in a symbol that occurs nowhere else.
    """
    if not len(symbols):
        return np.empty((0, 3), np.int64)
    order, levels = sort_suffixes(symbols)
    nodes = inner_nodes(common_prefixes(order, levels))
    if not len(nodes):
        return np.empty((0, 3), np.int64)
    start, period = branching_repeats(symbols, order, levels[-1], nodes).T
    end = start + 2 * period
    for l in reversed(range(len(levels))):
        back = start - (1 << l)
        same = back >= 0
        at = np.where(same, back, 0)
        same &= levels[l][at] == levels[l][at + period]
        start = np.where(same, back, start)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return np.stack([start, end - start, period], 1)[by]


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of two periods or more of each list of words."""
    codes: list[int] = []
    bounds = [0]
    for words in texts:
        base = len(codes)
        known: dict[bytes, int] = {}
        codes += [known.setdefault(w, base + k) for k, w in enumerate(words)]
        codes.append(len(codes))  # ends the text; a symbol is the place where it occurs first
        bounds.append(len(codes))
    runs = maximal_runs(np.array(codes, np.int64))
    cut = np.searchsorted(runs[:, 0], bounds)
    return [runs[a:b] - np.array([lo, 0, 0]) for a, b, lo in zip(cut, cut[1:], bounds)]


def long_runs(runs: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    return runs[runs[:, 1] >= np.maximum(least, times * runs[:, 2])]


def repeat_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a text whose id's crc32 ends in 0: from a place on, a piece of them again and again; of others as they are.

    A null id changes nothing.
    """
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """`words` without those that lie in a run behind its first period."""
    if not len(runs):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


_KINDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_RUNS = ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
WITH_TEXT = SCHEMA + ", runs array<struct<start bigint, length bigint, period bigint>>, collapsed string"


def _row(doc_id: int | None, words: list[bytes], runs: np.ndarray, with_text: bool) -> tuple:
    listed = runs.tolist()
    best = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = hashlib.sha256(b"".join(b"%d,%d,%d\n" % tuple(r) for r in listed)).hexdigest()
    text = b" ".join(collapse(words, runs))
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    more = ([dict(zip(("start", "length", "period"), r)) for r in listed], text.decode("utf-8", "surrogatepass")) if with_text else ()
    return (doc_id, len(listed), *head, digest, hashlib.sha256(text).hexdigest(), *more)


def find_runs(docs: DataFrame, planted: bool = False, least: int = 6, times: int = 4, with_text: bool = False) -> DataFrame:
    """The periodic runs of the words of every row of `docs` (doc_id, text): their number, the longest, and digests of all and of the text without repeats.

    A run has `least` words and `times` periods at least. with_text adds the runs and the collapsed
    text. `planted` repeats words of a tenth of the texts first (repeat_words). A null
    or empty text has no words and no run; its longest run is null and its digests are those of
    nothing. Equal rows, and rows with a null doc_id, are texts like any other. Of runs of one length
    the first counts, then the one of the smaller period. Other columns are ignored.
    """
    kinds = [*_KINDS, *((_RUNS, ("collapsed", pa.string())) if with_text else ())]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = runs_of_texts([words for _, words in held])
            rows = [_row(i, words, long_runs(runs, least, times), with_text) for (i, words), runs in zip(held, found)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[c for c, _ in kinds])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_words(text.as_py().encode("utf-8", "surrogatepass"))
                words = repeat_words(words, i) if planted else words
                if held and size + len(words) > BATCH_WORDS:
                    yield flush()
                    held, size = [], 0
                held.append((i, words))
                size += len(words) + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, WITH_TEXT if with_text else SCHEMA)
