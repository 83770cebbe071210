"""Best-fit packing planned on the histogram of lengths.

The plan is made over counts: best-fit decreasing places "c pieces of length l"
into runs of equal bins, so the driver handles at most `capacity` counts
however many documents there are. Pieces then take the planned slots by
joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, stage
from .tokens import CACHE_ENTRIES, encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all hold `capacity` but the first, which may be shorter."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int, with_ids: bool = False, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row for each piece of each document's ids; with_ids adds the ids as bytes (u32, little-endian)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind, cache_entries)
        for batch in batches:
            rows: list[tuple] = []
            for doc, data in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist(), end_id)):
                for i, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc, i, start, length, zlib.crc32(part), *((part,) if with_ids else ())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Each row (length, first_rank, bins, per_bin, first_sequence, offset) gives
    bins * per_bin pieces their places: piece number r of these goes to sequence
    first_sequence + r // per_bin, at offset + (r % per_bin) * length.
    Runs of bins with the same free space are kept together, so the number of
    rows depends on the capacity and not on the number of pieces.
    """
    free: list[int] = []  # sorted free spaces that occur
    runs: dict[int, list[tuple[int, int]]] = {}
    rows: list[tuple[int, int, int, int, int, int]] = []
    next_bin = 0

    def give(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in runs:
                bisect.insort(free, space)
                runs[space] = []
            runs[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = runs[space].pop()
                if not runs[space]:
                    del runs[space]
                    free.pop(at)
            else:
                space, first = capacity, next_bin
                n = -(-left // (capacity // length))
                next_bin += n
            each = space // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full, each, first, capacity - space))
                give(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                rows.append((length, rank, 1, left, first + full, capacity - space))
                give(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            give(space, first + full, n - full)
    return rows


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give each row of `pieces` (doc_id, piece, length, ids_crc32, ...) sequence_id and offset.

    `pieces` must be stored (a table or the result of stage()): it is read
    twice. Ranks within a length are counted per (length, salt), the salt taken
    from the piece's own key, so one length that holds most pieces is spread over
    many tasks. Identical rows take any of each other's slots. An empty input
    gives an empty result.
    """
    spark = pieces.sparkSession
    salts = 2 * max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan_slots(counts, capacity) or [(0, 0, 0, 1, 0, 0)],
        "slot_length bigint, first_rank bigint, bins bigint, per_bin bigint, first_sequence bigint, slot_offset bigint",
    )
    before = sizes.select(
        F.col("length").alias("of_length"), F.col("salt").alias("of_salt"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    ranked = salted.withColumn(
        "in_salt", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ).join(before, (F.col("length") == F.col("of_length")) & (F.col("salt") == F.col("of_salt")))
    rank = ranked.withColumn("rank", F.col("before") + F.col("in_salt") - 1)
    nth = F.col("rank") - F.col("first_rank")
    placed = rank.join(
        F.broadcast(slots),  # its size depends on the capacity alone
        (F.col("length") == F.col("slot_length")) & nth.between(0, F.col("bins") * F.col("per_bin") - 1),
    )
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("slot_offset") + F.pmod(nth, F.col("per_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", kind: str = "byte", end_id: int = 2, capacity: int = 1024, with_ids: bool = False, cache_entries: int = CACHE_ENTRIES
) -> DataFrame:
    """Encode `docs` (doc_id, text) and pack them into as few sequences of `capacity` tokens as best-fit decreasing does.

    A null or empty text is its end id alone. Rows with a null or repeated doc_id
    are packed like any others. Other columns of `docs` are ignored. cache_entries
    bounds what a Python worker remembers of the tokenizer's work; it changes no result.
    """
    return pack(stage(token_pieces(docs, tokenizer, kind, end_id, capacity, with_ids, cache_entries), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack_documents(with_ids=True): sequence_id, n_tokens, ids (u32 bytes).

    A sequence has at most `capacity` pieces, which bounds each group.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
