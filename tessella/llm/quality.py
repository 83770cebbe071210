"""Document statistics and quality rules: fixed rules, then gradient-boosted trees.

The trees are grown in numpy on a bounded sample of labelled documents, are
flattened into node arrays, and score whole batches of documents at a time.
Chosen features are constrained: more of them never raises the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, split_words

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"[0-9]")
_STOPS = re.compile(r"[.!?]")
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "stops", "lines"]
#: Features that may only lower the score as they grow.
FALLING = ("symbols", "dup_lines", "repeats")


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """STATS of one text; words are runs of anything but the six ASCII white-space characters.

    n_dup_lines counts lines that hold a word and equal an earlier line.
    n_repeat_words counts the words that lie in a run of three words found at
    least twice in the text.
    """
    if not text:
        return 0, 0, 0, 0, 0
    words = split_words(text.encode("utf-8", "surrogatepass"))
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = text.split("\n")
    dup = len(lines) - len(set(lines))
    if dup:
        seen, dup = set(), 0
        for line in lines:
            if line in seen:
                dup += bool(line.strip(" \t\n\x0b\x0c\r"))
            else:
                seen.add(line)
    repeat = 0
    if n > 3:
        runs = list(zip(words, words[1:], words[2:]))
        if len(set(runs)) < len(runs):
            first: dict[tuple, int] = {}
            marked = np.zeros(n, bool)
            for i, run in enumerate(runs):
                at = first.setdefault(run, i)
                if at != i:
                    marked[at : at + 3] = marked[i : i + 3] = True
            repeat = int(marked.sum())
    return n, chars, len(_SYMBOLS.findall(text)), dup, repeat


def features(text: str | None, stats: tuple[int, ...]) -> list[float]:
    n, chars, symbols, dup, repeat = stats
    text = text or ""
    size, lines = max(1, len(text)), text.count("\n") + 1
    return [
        np.log1p(n), chars / max(1, n), symbols / size, dup / lines, repeat / max(1, n),
        len(_UPPER.findall(text)) / size, len(_DIGIT.findall(text)) / size, len(_STOPS.findall(text)) / max(1, n), np.log1p(lines),
    ]


@dataclass
class Trees:
    """All trees in flat node arrays; a node whose left child is itself is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cutoff: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x: every tree of every row steps one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)


def grow(x: np.ndarray, y: np.ndarray, falling: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 5.0) -> Trees:
    """Gradient boosting with logistic loss on histograms.

    A split on a feature in `falling` is taken only if its left (smaller) side
    gets the larger value, and both sides' descendants stay on their side of
    the middle, so the sum of trees falls in that feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    score, nodes, roots = np.full(len(y), base), [], []

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([0, 0.0, me, me, rate * value])
        best = (1e-6, None)
        if level < depth and len(rows) >= 20:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                lg = np.cumsum(np.bincount(code[rows, j], g[rows], len(e) + 1))[:-1]
                lh = np.cumsum(np.bincount(code[rows, j], h[rows], len(e) + 1))[:-1]
                ln = np.cumsum(np.bincount(code[rows, j], minlength=len(e) + 1))[:-1]
                rg, rh = total_g - lg, total_h - lh
                gain = lg**2 / (lh + penalty) + rg**2 / (rh + penalty) - total_g**2 / (total_h + penalty)
                bad = (ln < 10) | (len(rows) - ln < 10)
                if j in falling:
                    bad |= lg / (lh + penalty) < rg / (rh + penalty)
                gain[bad] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, np.clip(lg[k] / (lh[k] + penalty), low, high), np.clip(rg[k] / (rh[k] + penalty), low, high)))
        if best[1]:
            j, k, lv, rv = best[1]
            middle = float(lv + rv) / 2
            bounds = ((middle, high), (low, middle)) if j in falling else ((low, high), (low, high))
            inside = code[rows, j] <= k
            left = build(rows[inside], g, h, level + 1, *bounds[0])
            right = build(rows[~inside], g, h, level + 1, *bounds[1])
            nodes[me] = [j, float(edges[j][k]), left, right, 0.0]
        return me

    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(build(np.arange(len(y)), y - q, q * (1 - q), 0, -np.inf, np.inf))
        a = np.array(nodes[first:])
        one = Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int) - first, a[:, 3].astype(int) - first, a[:, 4], np.array([0]), depth, 0.0)
        score = score + one.score(x)
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), depth, base)


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, keep_recall: float = 0.995) -> Trees | None:
    """Fit on at most `sample` labelled documents, chosen by the hash of their id; None without both classes. Of several texts of one id the least features count.

    One document in four is held out; the cutoff is the score that keeps
    `keep_recall` of the good held-out documents, and is never above even odds.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, 2 * sample / max(1, chosen.count()))  # cut by a range of the hash first, so no task sorts more than about twice the sample
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= int((1 << 40) * share)).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = [features(t, text_stats(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # of repeated ids one row, so no more than `sample` rows reach the driver
    rows = joined.mapInArrow(run, "doc_id bigint, quality int, x array<double>").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows], float)
    if len(rows) < 40 or not 0 < y.sum() < len(y):
        return None
    held = np.arange(len(y)) % 4 == 3
    model = grow(x[~held], y[~held], [FEATURES.index(f) for f in FALLING])
    good = model.score(x[held & (y == 1)])
    model.cutoff = min(0.0, float(np.quantile(good, 1 - keep_recall))) if len(good) else -np.inf
    return model


def quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 50, repeat_percent: int = 50, sample: int = 8000) -> DataFrame:
    """doc_id, STATS, base_failed, kept and score of every row of `docs` (doc_id, text).

    A null or empty text has no words and fails the rules. Repeated rows are
    judged alike; a null doc_id is passed through. Without usable labels the
    rules alone decide and score is null. Other columns are ignored.
    """
    model = train(docs, labels, sample)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            stats = [text_stats(t) for t in texts]
            s = np.array(stats, np.int64)
            failed = (s[:, 0] < min_words) | (100 * s[:, 4] > repeat_percent * s[:, 0])
            if model is None:
                score, kept = pa.nulls(len(s), pa.float64()), ~failed
            else:
                values = model.score(np.array([features(t, v) for t, v in zip(texts, stats)]))
                score, kept = pa.array(values), ~failed & (values >= model.cutoff)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(s[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), score],
                names=["doc_id", *STATS, "base_failed", "kept", "score"],
            )

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in STATS) + ", base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, min_words: int = 50, repeat_percent: int = 50, sample: int = 8000) -> DataFrame:
    """The rows of `docs` that quality_rules keeps, with all their columns and without a shuffle.

    A null or empty text goes, as it has no words. Repeated rows stay or go
    together, a row with a null doc_id is judged like any other.
    """
    model = train(docs, labels, sample)
    at = docs.columns.index("text")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(at).to_pylist()
                stats = [text_stats(t) for t in texts]
                s = np.array(stats, np.int64)
                keep = (s[:, 0] >= min_words) & (100 * s[:, 4] <= repeat_percent * s[:, 0])
                if model is not None:
                    keep &= model.score(np.array([features(t, v) for t, v in zip(texts, stats)])) >= model.cutoff
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
