"""Cross-entropy difference of documents under a target and a background n-gram model.

Tokens are words, A-Z in lower case, of one vocabulary that both models share: all
words of the corpus. Both are bigram models backed by unigrams, with the same
smoothing. The target is counted over the labelled good documents, the background
over all others, and the counts of the larger are scaled down to the size of the
smaller, so that both weigh against the smoothing alike. A document's own words
are taken out of the model that counted them, so no document is scored by itself.

Counts grow with the corpus and stay distributed. Documents lie in blocks of about
`block_bytes`, named by a hash of the row. A block sends each of its distinct
n-grams once, packed by ranges of the hash, to the range's group, where
the blocks' counts are added up; the totals go back in the same order,
without the n-grams, and the block's documents are scored. Texts are shuffled
once, and both steps read that one exchange. A frequent word is one entry a block in its
range, whatever it occurs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, join_ids, mix64, stage, word_hashes

SCORES = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"
PACKED = "range bigint, block bigint, grams binary, n binary, target binary"
TOTALS = "range bigint, block bigint, n binary, target binary"  # counts as narrow() writes them
#: The boundary before each document, as a unigram; unigrams are even, bigrams odd.
START = np.uint64(0x5D17A2C4B8E6F390)
_BI, _EVEN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xFFFFFFFFFFFFFFFE)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unigram, context and bigram name of every word of all texts in order, and the number of words of each text."""
    words, n = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])  # bytes.lower() changes A-Z alone
    words = words & _EVEN
    words[words == START] = 0
    before = np.concatenate([[START], words[:-1]]) if len(words) else words
    before[(np.cumsum(n) - n)[n > 0]] = START
    return words, before, mix64(before * _BI + words) | np.uint64(1), n


@dataclass
class Block:
    """The n-grams of some texts: sorted distinct names, and for every word its spots among them and their counts in its own text."""

    names: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    spot: dict[str, np.ndarray]  # of the word, its context and the bigram
    own: dict[str, np.ndarray]
    every: np.ndarray  # spots of all unigrams, bigrams and starts
    every_doc: np.ndarray


def block_of(texts: list[str | None]) -> Block:
    uni, before, bi, n = grams(texts)
    doc, first, size = np.repeat(np.arange(len(n)), n), before == START, len(uni)
    every, every_doc = np.concatenate([uni, bi, before[first]]), np.concatenate([doc, doc, doc[first]])
    order = np.argsort(every, kind="stable")  # within a name, by text
    named, owner = every[order], every_doc[order]
    head = np.concatenate([[True], named[1:] != named[:-1]])[: len(named)]
    run = head | np.concatenate([[True], owner[1:] != owner[:-1]])[: len(named)]
    spots, counts, at = np.empty(len(named), np.int64), np.empty(len(named), np.int64), np.cumsum(run) - 1
    spots[order] = np.cumsum(head) - 1
    counts[order] = np.bincount(at)[at] if len(at) else 0
    context, mine = np.empty(size, np.int64), np.ones(size, np.int64)
    context[first] = spots[2 * size :]
    inner = np.flatnonzero(~first)
    context[inner], mine[inner] = spots[inner - 1], counts[inner - 1]
    return Block(
        named[head], n, doc, {"w": spots[:size], "v": context, "b": spots[size : 2 * size]}, {"w": counts[:size], "v": mine, "b": counts[size : 2 * size]}, spots, every_doc)


def ranges(names: np.ndarray, count: int) -> np.ndarray:
    """The range, 0 to count - 1, of each name; ascending with the names."""
    return (((names >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def narrow(counts: np.ndarray) -> bytes:
    """Counts as one byte each, 255 where the count follows behind in full; compressed, as most are alike."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(small.tobytes() + counts[small == 255].astype("<u8").tobytes(), 1)


def widen(data: bytes, size: int) -> np.ndarray:
    data = zlib.decompress(data)
    out = np.frombuffer(data, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=size)
    return out


def packed_names(names: np.ndarray) -> bytes:
    """Sorted names as steps, byte by byte: within a range the high bytes of all steps are alike, which the shuffle's codec takes out."""
    return np.ascontiguousarray(np.diff(names, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked_names(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def sizes(docs: DataFrame) -> tuple[int, int, int, int]:
    """Bytes and words of all texts of `docs` (text, good), words of the good ones, and the number of good texts with words."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    data = text.encode("utf-8", "surrogatepass")
                    n = len(data.split())
                    total += (len(data), n, n * good, good and n > 0)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in total], names=["bytes", "words", "target", "texts"])

    counted = docs.select("text", "good").mapInArrow(run, "bytes bigint, words bigint, target bigint, texts bigint")
    return tuple(x or 0 for x in counted.agg(F.sum("bytes"), F.sum("words"), F.sum("target"), F.sum("texts")).first())


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all labelled good documents."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0")
    return good.select("doc_id", F.lit(True).alias("good"))


def losses(block: Block, good: np.ndarray, total: np.ndarray, target: np.ndarray, words: int, target_words: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss of each text of a block under target and background; `total` and `target` count its names over the corpus."""
    n, doc = block.n, block.doc
    end, means, others = np.cumsum(n), [], words - target_words
    for table, size, mine, other in ((target, target_words, good, others), (total - target, others, ~good, target_words)):
        s, held = (min(1.0, other / size) if size else 1.0) or 1.0, mine[doc]
        c = {k: s * (table[spot] - block.own[k] * held) for k, spot in block.spot.items()}
        one = (c["w"] + prior / max(1, words)) / (s * (size - (n * mine)[doc]) + prior)
        two = (c["b"] + prior * one) / (c["v"] + prior)
        lost = np.concatenate([[0.0], np.cumsum(-np.log(two))])
        means.append(np.divide(lost[end] - lost[end - n], n, out=np.zeros(len(n)), where=n > 0))
    return means[0], means[1]


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, prior: float = 2.0, block_bytes: int = 1 << 23) -> DataFrame:
    """doc_id, n_tokens, mean loss (nats a word) under each model and score, their difference, of every row of `docs`.

    `docs` has doc_id and text; `labels` has doc_id, quality and toxic, and a
    document is good where some label says quality 1 and none says toxic 1; the
    target is counted on all good documents, the background on all the rest. A low score is like the target. A null or empty text has no words
    and null losses. Without good documents the target knows no words. Repeated rows
    count and score alike, each without itself alone; other columns are ignored.
    `prior` is the weight of the lower order; a word that no other document has is as
    likely as one word of the corpus.
    """
    marked = join_ids(docs.select("doc_id", "text"), stage(good_ids(labels), "good"), "left").withColumn("good", F.coalesce("good", F.lit(False)))
    n_bytes, words, target_words, _ = sizes(marked)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks, n_ranges = n_bytes // block_bytes + 1, n_bytes // (2 * block_bytes) + 1
    # equal rows of one id lie in several partitions of the input, which keep them apart
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_blocks))
    blocks = marked.select(block.alias("block"), "doc_id", "text", "good").repartition(max(parts, n_blocks), "block")

    def pack(group: pa.Table) -> pa.Table:
        """Each distinct n-gram of a block, with its counts in all texts and in good ones."""
        good = group.column("good").to_numpy().astype(bool)
        found = block_of(group.column("text").to_pylist())
        size, held = len(found.names), found.every[good[found.every_doc]]
        count, of_target = (np.bincount(x, minlength=size) for x in (found.every, held))
        where = ranges(found.names, n_ranges)
        cut = np.flatnonzero(np.diff(where, prepend=-1, append=n_ranges))
        slices = list(zip(cut[:-1], cut[1:]))
        each = lambda x: pa.array([narrow(x[a:b]) for a, b in slices], pa.binary())
        names = pa.array([packed_names(found.names[a:b]) for a, b in slices], pa.binary())
        block = pa.array([group.column("block")[0].as_py()] * len(slices), pa.int64())
        return pa.table({"range": pa.array(where[cut[:-1]]), "block": block, "grams": names, "n": each(count), "target": each(of_target)})

    def add_up(group: pa.Table) -> pa.Table:
        """The totals over all blocks, in each block's own order."""
        parts = group.column("grams").to_pylist()
        sizes_ = [len(x) // 8 for x in parts]
        ends = np.cumsum(sizes_).tolist()
        names = np.concatenate([unpacked_names(x) for x in parts])
        order = np.argsort(names, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], names[order[1:]] != names[order[:-1]]]))
        repeats = np.diff(np.append(heads, len(names)))
        columns = {"range": group.column("range"), "block": group.column("block")}
        for c in ("n", "target"):
            x = np.concatenate([widen(data, k) for data, k in zip(group.column(c).to_pylist(), sizes_)])
            x[order] = np.repeat(np.add.reduceat(x[order], heads), repeats)
            columns[c] = pa.array([narrow(x[a:b]) for a, b in zip([0, *ends], ends)], pa.binary())
        return pa.table(columns)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        good, found = left.column("good").to_numpy().astype(bool), block_of(left.column("text").to_pylist())
        right = right.sort_by("range")
        each = np.unique(ranges(found.names, n_ranges), return_counts=True)[1].tolist()
        total, target = (np.concatenate([np.empty(0, np.int64), *(widen(data, k) for data, k in zip(right.column(c).to_pylist(), each))]) for c in ("n", "target"))
        a, b = losses(found, good, total, target, words, target_words, prior)
        cols = [pa.array(x, mask=found.n == 0) for x in (a, b, a - b)]
        return pa.table([left.column("doc_id"), pa.array(found.n.astype(np.int64)), *cols], names=[x.split()[0] for x in SCORES.split(", ")])

    packed = blocks.groupBy("block").applyInArrow(pack, PACKED)
    totals = packed.groupBy("range").applyInArrow(add_up, TOTALS)
    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, SCORES)
