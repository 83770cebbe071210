"""Content-addressed store of token ids.

Rolling hashes cut each document's id stream into chunks; every distinct chunk
is stored once under its SHA-256; a document is a recipe (the list of its
chunks' names), and the recipe's Merkle root names the document's ids. The store
is a folder of Parquet files written by Spark's own commit protocol:

  objects/kind=chunk    name, n, payload (ids as little-endian u16, or u32 beyond 65,536 ids)
  objects/kind=recipe   documents as they were encoded
  recipes               doc_id, n_tokens, names, root, in ascending doc_id order over `part`
  manifest              part, documents, n_tokens, root: Merkle roots over the recipes of each part
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, mix64, shared_dir, small_batches
from .tokens import encoder

SLICE, LEAF = 256, 4096
RECIPES = "doc_id bigint, n_tokens bigint, names binary, root binary, part int, place bigint"
MANIFEST = "leaf bigint, root binary, part int, documents bigint, n_tokens bigint"
OBJECTS = "kind string, key bigint, doc_id bigint, n bigint, name binary, payload binary"


def cut_points(streams: list[np.ndarray], window: int = 16, bits: int = 10, least: int = 256, most: int = 4096) -> list[list[int]]:
    """Ends of the chunks of each stream: where the hash of the last `window` ids has `bits` low zero bits.

    The hash is a rolling sum of mixed ids, so an edit moves only the cuts near
    it. Chunks hold at least `least` ids (but the last) and at most `most`. An
    empty stream has no chunk. All streams are hashed at once; `window` is at most
    `least`, so no cut looks back beyond its own stream.
    """
    if window > least:
        raise ValueError("window is longer than the shortest chunk")
    long = [s for s in streams if len(s) > least]
    if long:
        total = np.cumsum(mix64(np.concatenate(long).astype(np.uint64) + np.uint64(1)))
        rolled = total.copy()
        rolled[window:] -= total[:-window]
        marks = np.flatnonzero((mix64(rolled) & np.uint64((1 << bits) - 1)) == 0) + 1
    out, first = [], 0
    for s in streams:
        n, at, ends = len(s), 0, []
        while n - at > least:
            k = np.searchsorted(marks, first + at + least)
            end = min(int(marks[k]) - first if k < len(marks) else n, at + most, n)
            ends.append(end)
            at = end
        if at < n:
            ends.append(n)
        first += n if n > least else 0
        out.append(ends)
    return out


def merkle_root(names: list[bytes]) -> bytes:
    """Root of the binary hash tree over `names`; an odd node rises unchanged; of nothing, the hash of nothing."""
    level = list(names) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


# CRC-32 of a concatenation from the parts' CRCs: multiplication of polynomials
# over GF(2), reflected, modulo the CRC's polynomial.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    p = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            p ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return p


@lru_cache(maxsize=1 << 16)
def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    out, square, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = _times(square, out)
        square = _times(square, square)
        n >>= 1
    return out


def crc_joined(first: int, second: int, second_bytes: int) -> int:
    return _times(_shift(second_bytes), first) ^ second


def write_store(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, id_bytes: int = 2) -> None:
    """Encode `docs` (doc_id, text; a null text is empty) and write the store to `path`.

    A null doc_id sorts first; rows with the same doc_id stay separate
    documents, in the order of their roots. An empty table gives an empty store.
    """
    spark = docs.sparkSession

    most = 1 << 8 * id_bytes

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stored = encoder(tokenizer, kind), set()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for big in batches:
            for lo in range(0, big.num_rows, SLICE):
                batch = big.slice(lo, SLICE)
                rows: list[tuple] = []
                streams = [np.frombuffer(data, "<u4") for data in enc.encode(batch.column(1).to_pylist(), end_id)]
                if max(int(s.max(initial=0)) for s in streams) >= most:
                    raise ValueError(f"an id does not fit in {id_bytes} bytes")
                for doc, ids, ends in zip(batch.column(0).to_pylist(), streams, cut_points(streams)):
                    stream, at, names = ids.astype(f"<u{id_bytes}").tobytes(), 0, []
                    for end in ends:
                        payload = stream[at * id_bytes : end * id_bytes]
                        name = hashlib.sha256(payload).digest()
                        names.append(name)
                        if name not in stored:  # within the task; across tasks the shuffle below decides
                            stored.add(name)
                            rows.append(("chunk", int.from_bytes(name[:8], "little", signed=True), None, end - at, name, payload))
                        at = end
                    spread = int.from_bytes(hashlib.sha256(f"{doc}".encode() + (names or [b""])[0]).digest()[:8], "little", signed=True)
                    rows.append(("recipe", spread, doc, len(ids), merkle_root(names), b"".join(names)))
                if len(stored) > 1_000_000:
                    stored.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["kind", "key", "doc_id", "n", "name", "payload"])

    # One exchange carries payloads and recipes alike. A chunk arrives once a task, a recipe by
    # its own hash, so no key gathers more than a row a task.
    rows = docs.select("doc_id", "text").mapInArrow(run, OBJECTS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nth = F.row_number().over(Window.partitionBy("key", "kind", "name").orderBy("key"))
    once = rows.repartition(parts, "key").withColumn("nth", nth).where("kind = 'recipe' or nth = 1")
    with small_batches(spark):
        once.drop("key", "nth").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    recipes = spark.read.schema("doc_id bigint, n bigint, name binary, payload binary, kind string").parquet(f"{path}/objects").where("kind = 'recipe'")
    (
        recipes.select("doc_id", F.col("n").alias("n_tokens"), F.col("payload").alias("names"), F.col("name").alias("root"))
        .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "root")
        .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
        .write.parquet(f"{path}/recipes")
    )

    leaf_roots(spark, path).write.parquet(f"{path}/manifest")


def leaf_roots(spark: SparkSession, path: str) -> DataFrame:
    """leaf, root, part, documents and n_tokens of each leaf of recipes: a tree of bounded fan-out, leaves of 4,096 recipes, then parts."""

    @frugal
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = [merkle_root([x["root"] for x in sorted(r, key=lambda x: x["place"])]) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.binary())], names=["leaf", "root"])

    leaf = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select(
        "part", F.floor(F.col("place") / LEAF).alias("leaf"), "n_tokens", F.struct("place", "root").alias("entry")
    )
    hashed = leaf.groupBy("leaf").agg(F.collect_list("entry").alias("entries")).mapInArrow(roots, "leaf bigint, root binary")
    sums = leaf.groupBy("part", "leaf").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("n_tokens"))
    return hashed.join(sums, "leaf")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Work out every leaf's root and counts from the recipes; any difference from the manifest, or a leaf of only one of the two, raises."""
    stored, found = (
        df.select("leaf", F.struct("root", "part", "documents", "n_tokens").alias(name))
        for df, name in ((spark.read.schema(MANIFEST).parquet(f"{path}/manifest"), "stored"), (leaf_roots(spark, path), "found"))
    )
    wrong = stored.join(found, "leaf", "full_outer").where(~F.col("stored").eqNullSafe(F.col("found"))).select("leaf").head(1)
    if wrong:
        raise ValueError(f"the recipes of leaf {wrong[0]['leaf']} don't match the manifest")


def chunk_digests(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """name, n and CRC-32 (over u32 ids) of every stored chunk, from its bytes; a chunk that doesn't match its name raises."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if hashlib.sha256(payload).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = np.frombuffer(payload, f"<u{id_bytes}").astype("<u4")
                crcs.append(zlib.crc32(ids.tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["name", "n", "crc"])

    chunks = spark.read.schema("name binary, payload binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'")
    return chunks.select("name", "payload").mapInArrow(run, "name binary, n bigint, crc bigint")


def _references(spark: SparkSession, path: str) -> DataFrame:
    """One row for each chunk of each document, in its place."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    size = 32
    spots = F.sequence(F.lit(0), (F.length("names") / size - 1).cast("int"))
    return recipes.select("place", F.posexplode(F.transform(spots, lambda i: F.substring("names", i * size + 1, F.lit(size)))).alias("pos", "name"))


def read_index(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    Every chunk's bytes are read and checked against their name; a document's
    checksum is that of its chunks joined in the recipe's order, worked out
    from the chunks' checksums, so no bytes are copied once per document. A
    recipe that doesn't match its root, or lacks a chunk, raises, as do recipes
    that don't match the manifest.
    """
    verify_manifest(spark, path)
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    parts = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # as many rows as the recipes have files
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    starts = recipes.select("doc_id", "place", "part", "n_tokens", "root", running.alias("inside")).join(F.broadcast(before), "part")
    found = _references(spark, path).join(chunk_digests(spark, path, id_bytes), "name", "left")
    entries = found.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "n", "crc"))).alias("chunks"))
    rows = starts.join(entries, "place").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "root", "chunks")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for tokens, root, chunks in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if any(c["n"] is None for c in chunks):
                    raise ValueError("a chunk is missing")
                if merkle_root([c["name"] for c in chunks]) != root or sum(c["n"] for c in chunks) != tokens:
                    raise ValueError("a recipe doesn't match its root")
                crc = 0
                for c in chunks:
                    crc = crc_joined(crc, c["crc"], 4 * c["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def reconstruct(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """doc_id and ids (u32, little-endian) of every document, from chunks and recipes; what doesn't match its name, root or the manifest raises."""
    verify_manifest(spark, path)
    chunks = spark.read.schema("name binary, payload binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'")
    parts = _references(spark, path).join(chunks.select("name", "payload"), "name", "left")
    whole = parts.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
    rows = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("place", "doc_id", "root").join(whole, "place").select("doc_id", "parts", "root")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, root in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if any(p["payload"] is None for p in parts):
                    raise ValueError("a chunk is missing")
                if merkle_root([hashlib.sha256(p["payload"]).digest() for p in parts]) != root:
                    raise ValueError("a recipe doesn't match its root")
            ids = [np.frombuffer(b"".join(p["payload"] for p in parts), f"<u{id_bytes}").astype("<u4").tobytes() for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id bigint, ids binary")


def store_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 1) -> DataFrame:
    """Write `docs` to a new store in the shared folder and return its index, read back from the files."""
    path = f"{shared_dir(docs.sparkSession)}/store"
    write_store(docs, path, tokenizer, kind, end_id)
    return read_index(docs.sparkSession, path)
