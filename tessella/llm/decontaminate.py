"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then overlap of question and answer.

Every passage of every document is a query. Items are numbered by length and
lie in blocks of neighbours; for each block, passages are overlapping windows
of 1.25 times its longest item, so that a copy lies whole in one of them. Before a
query walks any postings, the block's largest impacts of its terms are summed; a
passage whose bound cannot reach the block's least threshold is dropped, a
document at a time in numpy. The others are walked with block-max WAND, which
returns all items whose score reaches their threshold. An item's
threshold is a share of the score it gives itself. Where an item's pieces lie apart, or
its lost words weigh more than that share, no passage retrieves it; the shingles that the
whole document holds give what is left, so no pair that would be verified is missed, and
`retrieved` tells by which of the two a pair was found. Found pairs are
verified on the document: `percent` of the distinct 5-word shingles of both question
and answer or, with `whole`, of the item as a whole; `whole` also compares words
without the ASCII punctuation at their edges.

The index is made of items only. It is built in blocks of at most `max_words`
words of items, each sent to the executors in turn, so what is broadcast has
a fixed bound however large the test set is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix64

LEAST_BLOCK, MOST_BLOCKS = 16, 64
K1, B = 1.2, 0.75
EDGES = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
FOUND = "doc_id bigint, item_id bigint, n_question bigint, question_hits bigint, n_answer bigint, answer_hits bigint, score double, retrieved boolean"


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bare(words: list[bytes]) -> list[bytes]:
    """The words without ASCII punctuation at their edges; a word of nothing else stays."""
    return [w.strip(EDGES) or w for w in words]


def shingles(words: list[bytes], k: int = 5) -> set[bytes]:
    """Distinct k-word shingles; the whole sequence where it is shorter; none of nothing."""
    if not words:
        return set()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words of all sentences but the last, and of the last; of one sentence, its first and second half.

    A sentence ends in . ! or ? before white space.
    """
    text = (text or "").strip(" \t\n\x0b\x0c\r")
    ends = [m.end() for m in re.finditer(r"[.!?](?=[\x20\x09-\x0D])", text)]
    if ends:
        return words_of(text[: ends[-1]]), words_of(text[ends[-1] :])
    words = words_of(text)
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


@dataclass
class Index:
    """Postings of each term: item numbers in order, impacts, and each block's largest impact and last item."""

    items: list[int | None]
    parts: list[tuple[set[bytes], set[bytes], set[bytes]]]  # question, answer, the whole
    terms: dict[bytes, int]
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    bound: np.ndarray
    threshold: np.ndarray
    blocks: list[tuple[int, int, float, int]]  # first item and end, least threshold, longest item
    most: np.ndarray  # each block's largest impact of each term; 0 for a word that is no term
    bare: bool
    grams: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # words, filter, hashes, their first slot, slots (3 * item + part)
    sizes: np.ndarray  # distinct hashes of each slot
    lone: bool  # some item has no part of five words beside the whole
    numbers: _Numbers | None = None  # of words, filled by each worker


def runs(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k term numbers."""
    out = np.full(max(0, len(ids) - k + 1), k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + ids[i : i + len(out)].astype(np.uint64)
    return mix64(out)


def gram_index(parts: list[tuple[list[bytes], ...]], terms: dict[bytes, int]) -> tuple[list[tuple], np.ndarray, bool]:
    """For each length, longest first, the shingles of all parts with the slots that hold them; the number of shingles of each slot; `lone`."""
    sizes, by_length = np.zeros(3 * len(parts), np.int64), {}
    for i, sides in enumerate(parts):
        for j, words in enumerate(sides):
            if words:
                k = min(5, len(words))
                found = np.unique(runs(np.array([terms[w] for w in words], np.int64), k))
                sizes[3 * i + j] = len(found)
                hashes, slots = by_length.setdefault(k, ([], []))
                hashes.append(found)
                slots.append(np.full(len(found), 3 * i + j))
    grams = []
    for k, (hashes, slots) in sorted(by_length.items(), reverse=True):
        h, slot = np.concatenate(hashes), np.concatenate(slots)
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        seen = np.zeros(1 << 20, bool)
        seen[keys >> np.uint64(44)] = True
        grams.append((k, seen, keys, np.append(first, len(h)), slot[order]))
    return grams, sizes, any(max(map(len, sides[:2])) < 5 for sides in parts)


def build_index(items: list[tuple[int | None, str | None]], share: float, whole: bool = False) -> Index:
    """BM25 index; item impacts are those of the item's text, a query counts each of its distinct terms once."""
    form = bare if whole else list
    texts = [form(words_of(t)) for _, t in items]
    keep = [i for i, w in enumerate(texts) if w]
    keep.sort(key=lambda i: len(texts[i]))
    items, texts = [items[i] for i in keep], [texts[i] for i in keep]
    per_block = max(LEAST_BLOCK, -(-len(items) // MOST_BLOCKS))
    n, mean = len(texts), np.mean([len(w) for w in texts]) if texts else 1.0
    counts: dict[bytes, dict[int, int]] = {}
    for i, words in enumerate(texts):
        for w in words:
            of = counts.setdefault(w, {})
            of[i] = of.get(i, 0) + 1
    terms, postings, own = {}, [], np.zeros(n)
    for w, of in counts.items():
        idf = np.log(1 + (n - len(of) + 0.5) / (len(of) + 0.5))
        at = np.array(sorted(of))
        tf = np.array([of[i] for i in at.tolist()], float)
        size = np.array([len(texts[i]) for i in at.tolist()], float)
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        np.add.at(own, at, impact)
        starts = np.flatnonzero(np.diff(at // per_block, prepend=-1))
        terms[w] = len(postings)
        postings.append((at, impact, np.maximum.reduceat(impact, starts), at[np.append(starts[1:], len(at)) - 1]))
    bound = np.array([p[2].max() for p in postings] + [0.0])
    sides = [(*map(form, question_and_answer(t)), w) for (_, t), w in zip(items, texts)]
    parts = [tuple(map(shingles, x)) for x in sides]
    threshold = share * own
    blocks, mosts = [], []
    for lo in range(0, n, per_block):
        most = np.zeros(len(postings) + 1)
        for t, (at, _, largest, last) in enumerate(postings):
            k = int(np.searchsorted(last // per_block, lo // per_block))
            if k < len(last) and last[k] // per_block == lo // per_block:
                most[t] = largest[k]
        mosts.append(most)
        blocks.append((lo, min(lo + per_block, n), float(threshold[lo : lo + per_block].min()), max(map(len, texts[lo : lo + per_block]))))
    mosts = np.array(mosts).reshape(len(blocks), len(postings) + 1)
    return Index([i for i, _ in items], parts, terms, postings, bound, threshold, blocks, mosts, whole, *gram_index(sides, terms))


def block_max_wand(index: Index, query: list[int], lo: int = 0, hi: int | None = None, bounds: np.ndarray | None = None) -> list[tuple[int, float]]:
    """(item, score) of all items in [lo, hi), or of all, that reach their threshold for the distinct terms in `query`.

    Thresholds differ between items, so the least of them guides the pivot and
    each fully scored item is held against its own. `bounds` has the terms' largest impacts in the range.
    """
    hi = len(index.items) if hi is None else hi
    bounds = index.bound if bounds is None else bounds
    least = float(index.threshold[lo:hi].min()) - 1e-9
    lists, ends = [], {}
    for t in query:
        held = index.postings[t]
        first, end = (0, len(held[0])) if hi - lo == len(index.items) else np.searchsorted(held[0], (lo, hi)).tolist()
        if first < end:
            lists.append((held, [first], float(bounds[t])))
            ends[id(lists[-1])] = end
    out = []
    while True:
        lists = [x for x in lists if x[1][0] < ends[id(x)]]
        lists.sort(key=lambda x: x[0][0][x[1][0]])
        total, pivot = 0.0, None
        for k, x in enumerate(lists):
            total += x[2]
            if total >= least:
                pivot = k
                break
        if pivot is None:
            return out
        item = int(lists[pivot][0][0][lists[pivot][1][0]])
        while pivot + 1 < len(lists) and lists[pivot + 1][0][0][lists[pivot + 1][1][0]] == item:
            pivot += 1
        # the blocks that would hold the pivot: can they reach the threshold?
        ahead, limit = 0.0, None
        for (at, _, most, last), place, _ in lists[: pivot + 1]:
            b = int(np.searchsorted(last, item))
            if b < len(most):
                ahead += float(most[b])
                limit = int(last[b]) if limit is None else min(limit, int(last[b]))
        if ahead < least:
            # no item up to the end of the shortest of these blocks can reach it
            to = (limit if limit is not None else item) + 1
            if pivot + 1 < len(lists):
                to = min(to, int(lists[pivot + 1][0][0][lists[pivot + 1][1][0]]))
            to = max(to, item + 1)
            for (at, *_), place, _ in lists[: pivot + 1]:
                place[0] = max(place[0], int(np.searchsorted(at, to)))
            continue
        score = 0.0
        for (at, impact, _, _), place, _ in lists[: pivot + 1]:
            k = int(np.searchsorted(at, item))
            if k < len(at) and at[k] == item:
                score += float(impact[k])
            place[0] = max(place[0], int(np.searchsorted(at, item + 1)))
        if score >= index.threshold[item] - 1e-9:
            out.append((item, score))


def held_items(index: Index, ids: np.ndarray, percent: int) -> list[int]:
    """Items that the document as a whole holds, by the hashes of their shingles."""
    slots = []
    for k, seen, keys, first, of in index.grams:
        if k < 5 and not slots and not index.lone:
            return []  # every item has a part that needs a five-word shingle
        h = runs(ids, k)
        h = np.unique(h[seen[h >> np.uint64(44)]])
        at = np.searchsorted(keys, h)
        at = at[keys[np.minimum(at, len(keys) - 1)] == h]
        slots += [of[first[a] : first[a + 1]] for a in at.tolist()]
    if not slots:
        return []
    slot, n = np.unique(np.concatenate(slots), return_counts=True)
    item = np.unique(slot // 3)
    hits = np.zeros((len(item), 3), np.int64)
    hits[np.searchsorted(item, slot // 3), slot % 3] = n
    enough = 100 * hits >= percent * index.sizes.reshape(-1, 3)[item]
    return item[enough[:, :2].all(1) | (index.bare & enough[:, 2])].tolist()


def earlier(ids: np.ndarray) -> np.ndarray:
    """The last place before each where the same number stands; -1 without one."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1)
    again = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][again]] = order[:-1][again]
    return out


#: Impacts of words under blocks that are summed together.
SUMS = 1 << 20


def candidates(index: Index, ids: np.ndarray, percent: int) -> dict[int, tuple[float, bool]]:
    """Items that some passage of the document (numbers of its words) retrieves, with the best score, or that only the document as a whole holds, with its score; and which of both."""
    none = len(index.postings)
    found: dict[int, tuple[float, bool]] = {}
    before = None
    together = max(1, SUMS // (len(ids) + 1))
    for group in range(0, len(index.blocks), together):
        values = index.most[group : group + together][:, ids]
        totals = np.zeros((len(values), len(ids) + 1))
        np.cumsum(values, axis=1, out=totals[:, 1:])
        for value, total, most, (first, last, least, longest) in zip(values, totals, index.most[group:], index.blocks[group:]):
            least -= 1e-9
            if total[-1] < least:
                continue
            step = max(4, longest // 4)
            start = np.arange(0, len(ids), step)
            end = np.minimum(start + longest + longest // 4 + step, len(ids))
            hopeful = total[end] - total[start] >= least  # repeated terms only raise the bound
            for lo, hi in zip(start[hopeful].tolist(), end[hopeful].tolist()):
                if before is None:
                    before = earlier(ids)
                if value[lo:hi][before[lo:hi] < lo].sum() < least - 1e-9:  # each term counted once
                    continue
                query = np.unique(ids[lo:hi])
                query = query[most[query] > 0]
                for item, score in block_max_wand(index, query[query < none].tolist(), first, last, most):
                    found[item] = max((score, True), found.get(item, (0.0, True)))
    for item in set(held_items(index, ids, percent)).difference(found):
        score = 0.0
        for t in np.unique(ids[ids < none]).tolist():
            at, impact, *_ = index.postings[t]
            k = int(np.searchsorted(at, item))
            if k < len(at) and at[k] == item:
                score += float(impact[k])
        found[item] = score, False
    return found


#: Words whose numbers a Python worker keeps.
KEPT_WORDS = 500_000


class _Numbers(dict):
    """The number of each word of a text, once it has been looked up in the index."""

    def __init__(self, index: Index):
        super().__init__()
        self.get_term, self.none, self.bare = index.terms.get, len(index.postings), index.bare

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        number = self[word] = self.get_term(word.strip(EDGES) or word if self.bare else word, self.none)
        return number


def leaks(index: Index, text: str | None, percent: int) -> list[tuple]:
    """(item_id, question shingles, hits, answer shingles, hits, score, retrieved) of each item that the text holds."""
    raw = words_of(text)
    if not raw or not index.items:
        return []
    if index.numbers is None:
        index.numbers = _Numbers(index)
    found = candidates(index, np.fromiter(map(index.numbers.__getitem__, raw), np.int64, len(raw)), percent)
    if not found:
        return []
    words = bare(raw) if index.bare else raw
    have, joined, out = shingles(words), b" " + b" ".join(words) + b" ", []
    for item, (score, retrieved) in found.items():
        sides = index.parts[item]
        # a side of under five words is one shingle, found as a run of words
        hits = [sum(s in have or (s.count(b" ") < 4 and b" " + s + b" " in joined) for s in side) for side in sides]
        enough = [100 * h >= percent * len(side) for h, side in zip(hits, sides)]
        if all(enough[:2]) or index.bare and enough[2]:
            out.append((index.items[item], len(sides[0]), hits[0], len(sides[1]), hits[1], score, retrieved))
    return out


def indexes(benchmark: DataFrame, share: float, max_words: int, whole: bool) -> Iterator[Index]:
    """The index of each block of items; a block has about `max_words` words."""
    sized = benchmark.select("item_id", "text")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * max_words)))
    for block in range(blocks):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else sized
        rows = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        yield build_index([(r["item_id"], r["text"]) for r in rows], share, whole)


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, share: float = 0.7, max_words: int = 2_000_000, whole: bool = False) -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id, shingle counts and hits, best BM25 score, and whether a passage retrieved it.

    `docs` has doc_id and text, `benchmark` item_id and text. Items or documents
    without words match nothing. A side of an item without words counts as
    held. With `whole`, an item held as a whole counts too, and words are compared
    and counted without punctuation at their edges. Equal rows give equal results, each its own; null ids are kept as they
    are. Other columns are ignored.
    """
    out = None
    for built in indexes(benchmark, share, max_words, whole):
        index = docs.sparkSession.sparkContext.broadcast(built)

        @frugal
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in leaks(index.value, text, percent)]
                cols = list(zip(*rows)) or [()] * 8
                kinds = [pa.int64()] * 6 + [pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

        found = docs.select("doc_id", "text").mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, share: float = 0.7, max_words: int = 2_000_000, whole: bool = False) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns and without a shuffle."""
    schema, at = docs.schema, docs.columns.index("text")
    for built in indexes(benchmark, share, max_words, whole):
        index = docs.sparkSession.sparkContext.broadcast(built)

        @frugal
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not leaks(index.value, t, percent) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
