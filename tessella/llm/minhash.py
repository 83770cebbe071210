"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. A document's shingle set is hashed once; bins of the hash space keep their
   smallest value, and an empty bin takes that of a random filled bin (the same
   order of bins for every document). Documents with equal sets form a class at
   once, and one of the class stands for it from here on.
2. Bands of the signature give buckets. Each bucket names its smallest member the
   centre, and only (member, centre) pairs are compared, on full sets.
   A pair whose signatures agree in fewer than 60 of 100 bins waits for the next step.
3. Linked pairs give components. A bucket that still holds several components
   isn't settled: the members of all such buckets are joined exactly across components, by
   prefixes of their rarest shingles, however many they are. So a link is missed only if its
   two documents share no bucket (below one in ten million at a similarity of 0.8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, frugal, join_ids, mix64, shingle_hashes, stage, word_hashes

BINS, ROWS = 128, 4
#: Shingles of more documents than HOT are dealt over SALTS keys.
HOT, SALTS = 256, 16
_ORDER = np.argsort(mix64(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(77)).reshape(BINS, BINS), axis=1)


def shingle_set(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() changes A-Z alone
    words, counts = word_hashes(data)
    out, at = [], 0
    for n in counts:
        out.append(np.unique(shingle_hashes(words[at : at + n], k)))
        at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each bin's smallest hash; empty bins take those of the first filled bin in their own fixed order."""
    hashed = np.sort(mix64(shingles))
    bins = (hashed >> np.uint64(64 - 7)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = hashed[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDER[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return (mix64(values) & np.uint64(0xFFFF)).astype("<u2")


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit name (h1, h2) and signature; the last three are null for an empty set."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                batch = big.slice(lo, 512)
                sets = shingle_set(batch.column(1).to_pylist(), k)
                names = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
                signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([None if v is None else signed(v >> 64) for v in names], pa.int64()),
                        pa.array([None if v is None else signed(v & (1 << 64) - 1) for v in names], pa.int64()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary")


def bucket_keys() -> Column:
    """The bucket names of a signature, one for each band."""
    return F.array(*(F.xxhash64(F.lit(i), F.substring("sig", i * 2 * ROWS + 1, 2 * ROWS)) for i in range(BINS // ROWS)))


def plausible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures agree in at least percent / 100 - 0.2 of the bins.

    The share of equal bins has a standard error of 0.036 at 80 percent, so
    a similar pair falls short by more than five of them. `signed` may hold
    several signatures of one doc_id; one that agrees is enough.
    """
    sigs = signed.select("doc_id", "sig")
    both = (
        pairs.join(sigs.select(F.col("doc_id").alias("id_a"), F.col("sig").alias("sig_a")), F.col("a") == F.col("id_a"))
        .join(sigs.select(F.col("doc_id").alias("id_b"), F.col("sig").alias("sig_b")), F.col("b") == F.col("id_b")).select("a", "b", "sig_a", "sig_b")
    )
    least = BINS * (percent / 100 - 0.2)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BINS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def similar_pairs(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of `pairs` (distinct doc_ids) whose full sets have 100 * intersection >= percent * union."""
    named = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "named")
    texts = join_ids(docs.select("doc_id", "text"), named, "left_semi").withColumnRenamed("doc_id", "id")
    both = (
        pairs.join(texts, pairs.a == texts.id).select("a", "b", F.col("text").alias("text_a"))
        .join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), F.col("b") == F.col("id_b")).select("a", "b", "text_a", "text_b")
    )

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                left = shingle_set(batch.column(2).to_pylist(), k)
                keep = []
                for x, text in zip(left, batch.column(3).to_pylist()):
                    if text != held[0]:  # a star's rows come together
                        held = (text, shingle_set([text], k)[0])
                    y = held[1]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) of every node of `edges` (a, b).

    Labels spread along edges and then along labels (pointer jumping); each
    round is stored, and the loop ends when no label changes.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("component", "seen"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("seen").alias("seen"))
        better = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "seen").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("label"), F.col("component").alias("jump"))
        jumped = stage(better.join(up, F.col("component") == F.col("label"), "left").select("node", F.least("component", "jump").alias("component"), "old"), "labels")
        labels = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return labels


def prefix_pairs(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of `members` (doc_id, component) across components, among them every one that is similar.

    Shingles are ordered from rare to common among the members. Of a similar pair the first common
    shingle in this order has, in both documents, at least as many shingles from it on as the least
    overlap that the lengths ask for. So the shorter document is indexed by a prefix for partners
    no shorter, the longer one looks up a prefix for all its partners, and both ends are checked.

    A shingle of one component alone is left out. Of a hot shingle, the component that holds
    most of its documents (near copies that are linked already) never meets itself: its
    indexed documents meet lookups from outside only (`side` 1), all others meet every lookup.
    """
    texts = join_ids(docs.select("doc_id", "text").where("text is not null"), members, "inner").distinct().select("doc_id", "text", "component")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 64):
                batch = big.slice(lo, 64)
                sets = shingle_set(batch.column(1).to_pylist(), k)
                size = np.array([len(x) for x in sets], np.int64)
                each = lambda i: pa.array(np.repeat(batch.column(i).to_numpy(), size))
                names = pa.array(np.repeat([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], size).astype(np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([each(0), each(2), names, pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "component", "name", "n", "g"])

    grams = stage(texts.select("doc_id", "text", "component").mapInArrow(run, "id bigint, component bigint, name bigint, n bigint, g bigint"), "grams")
    counted = grams.groupBy("g", "component").agg(F.count("*").alias("n")).groupBy("g").agg(
        F.sum("n").alias("df"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
    # one document's shingles come together, each counted once a document
    ranked = grams.join(counted, "g").groupBy("id", "name", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g", "main", "parts"))).alias("grams"))
    placed = ranked.select("id", "component", "n", F.posexplode("grams").alias("at", "x")).select("id", "component", "n", "x.*", (F.col("n") - F.col("at")).alias("left"))
    probe = stage(placed.where((F.col("parts") > 1) & (100 * F.col("left") >= percent * F.col("n"))), "prefixes")
    hot, outside = F.col("df") > HOT, F.col("component") != F.col("main")
    index = probe.where((100 + percent) * F.col("left") >= 2 * percent * F.col("n")).select(
        F.col("id").alias("i_id"), F.col("component").alias("i_component"), F.col("n").alias("i_n"), F.col("left").alias("i_left"), "g",
        F.when(hot & ~outside, 1).otherwise(0).alias("side"),
        F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    probe = probe.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)).withColumn(
        "side", F.explode(F.when(hot & outside, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    fits = (
        (F.col("i_component") != F.col("component")) & (F.col("i_n") <= F.col("n")) & (100 * F.col("i_n") >= percent * F.col("n"))
        & ((100 + percent) * F.least("i_left", "left") >= percent * (F.col("i_n") + F.col("n")))
    )
    pairs = probe.join(index, ["g", "salt", "side"]).where(fits)
    return pairs.select(F.greatest("id", "i_id").alias("a"), F.least("id", "i_id").alias("b")).distinct()


def open_pairs(buckets: DataFrame, links: DataFrame, tested: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Pairs (a, b) not in `tested` (compared on full sets) of the buckets that `links` leave with several components, among them every link of their members; None without such buckets."""
    found = components(links)
    labelled = buckets.join(found, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    members = stage(labelled.join(mixed, "bucket").select("doc_id", "component").distinct(), "members")
    if members.isEmpty():
        return None
    return stage(prefix_pairs(members, docs, k, percent).join(tested, ["a", "b"], "left_anti").distinct(), "pairs")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at least
    `percent` percent; kept is doc_id = component_id. A null or empty text has
    no shingles and is a component of its own. Rows with equal sets are linked,
    whatever their ids; rows that share a doc_id are one document for links, and
    each keeps its own n_shingles. A row with a null doc_id takes the component
    of an equal set, else has a null component, and is kept only then.
    Other columns are ignored.
    """
    rows = stage(document_sets(docs, k), "sets")
    # one document stands for each set; copies never meet in a bucket
    classes = rows.where("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    classes = stage(classes, "classes")
    signed = classes.select(F.col("rep").alias("doc_id"), "sig")
    hot = max(HOT, HOT_SHARE * rows.count())
    # a doc_id with several sets belongs to several classes, which it links
    same_id = named_classes(rows.where("h1 is not null and doc_id is not null"), classes.select("h1", "h2", "rep", "n"), hot).where("doc_id <> rep").groupBy("doc_id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    keyed = signed.select("doc_id", F.explode(bucket_keys()).alias("bucket"))
    centres = keyed.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n")).where("n > 1")
    buckets = stage(keyed.join(centres, "bucket"), "buckets")
    star = stage(buckets.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    likely = stage(plausible(star, signed, percent), "plausible")
    links = same_id.unionByName(stage(similar_pairs(likely, docs, k, percent), "links"))
    new = open_pairs(buckets, links, likely, docs, k, percent)
    if new is not None:
        links = links.unionByName(stage(similar_pairs(new, docs, k, percent), "links"))
    found = components(links)
    rep_of = classes.join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"), "n")
    joined = named_classes(rows, rep_of, hot)
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.isnull(component)).alias("kept"))


def named_classes(rows: DataFrame, classes: DataFrame, hot: float) -> DataFrame:
    """`rows` left-joined with `classes` (h1, h2, n, ...); classes of more than `hot` rows, of which there are few, are broadcast, so their rows stay where they are."""
    names, few = ["h1", "h2"], F.broadcast(classes.where(F.col("n") > hot).drop("n"))
    rows = rows.select("doc_id", "n_shingles", *names)
    return rows.join(few, names).unionByName(rows.join(few.select(*names), names, "left_anti").join(classes.where(F.col("n") <= hot).drop("n"), names, "left"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that near_duplicates keeps, one of each component, with all their columns.

    An empty or null text is a component of its own and stays. Rows that share a doc_id
    are one document: they stay or go together, but of rows with equal doc_id and text one
    stays, so no different text is lost. A row with a null doc_id cannot be named and stays.
    """
    gone = stage(near_duplicates(docs, k, percent).where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    rest = join_ids(docs, gone, "left_anti")
    name = F.xxhash64("text")
    twice = stage(docs.where("doc_id is not null").groupBy("doc_id", name.alias("name")).agg(F.count("*").alias("n")).where("n > 1").select("doc_id").distinct(), "twice")
    return join_ids(rest, twice, "left_anti").unionByName(join_ids(rest, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
