"""Exact removal of byte strings that occur twice anywhere in the corpus.

Every string of `length` bytes is assigned to its anchor, the first of the
smallest hashes of the 32-byte strings that start in its first half: equal
strings have their anchors at equal places. A block is a run of string starts
of one document with one anchor. Blocks are compared in three steps, each over
less data than the one before:

1. All strings of a block share the bytes behind the anchor; if no other block
   has these (the key), none of its strings is repeated.
2. A block whose whole context (first start to last end) occurs again is
   repeated as a whole; such copies are counted with partial aggregation.
3. What is left, mostly the edges of copied passages, is settled byte by byte:
   the distinct contexts of a key are cut into 8-byte cells, counted from the
   anchor, their suffixes are sorted (suffix_array), and neighbours' common
   prefixes tell which starts are repeated. A key with more than `limit` distinct
   contexts is first cut into blocks of fewer starts, whose keys are longer, down to
   single strings, so that no task holds an unbounded group. `limit` decides where
   a string is compared, never whether: tests run every case on both sides of it.

So the suffix array decides the edges of repeats and whatever overlaps differently;
whole copies of a context, and what is left of a very common key, are told by
their bytes' names (64-bit hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, delete_path, frugal, join_keys, mix64, shared_dir, stage
from .suffix_array import suffix_array

GRAM = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
CONTEXT = "key bigint, ctx bigint, w bigint, rid bigint, did bigint, s0 int, n int, aoff int, data binary"
RUN = "rid bigint, did bigint, s int, n int"


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-symbol string (k a power of two) of 64-bit values, by doubling."""
    h, w = data, 1
    while w < k:
        h = mix64(h[:-w] * _STEP + h[w:])
        w *= 2
    return h


def _window(length: int) -> int:
    w = 1
    while 2 * w + GRAM <= length:
        w *= 2
    return w


def text_blocks(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """First start, number of starts, anchor's distance, key and context name of each block of one text."""
    n = len(data)
    grams = gram_hashes(_BYTE[np.frombuffer(data, np.uint8)], GRAM)
    starts, window = n - length + 1, _window(length)
    low, at, w = grams, np.arange(len(grams), dtype=np.int32), 1
    while w < window:  # smallest hash of each window, leftmost of equals
        right = low[w:] < low[:-w]
        low, at = np.where(right, low[w:], low[:-w]), np.where(right, at[w:], at[:-w])
        w *= 2
    at = at[:starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, starts))
    anchor = at[first]
    key, behind = grams[anchor], length - window
    for off in [*range(GRAM, behind - GRAM + 1, GRAM), behind - GRAM]:
        if off > 0:
            key = mix64(key * _STEP + grams[anchor + off])
    off = anchor - first
    names = [_name(data[s : s + c + length - 1], o) for s, c, o in zip(first.tolist(), count.tolist(), off.tolist())]
    return first, count, off, key.view(np.int64), names


def _name(context: bytes, off: int) -> int:
    v = xxhash.xxh3_64_intdigest(context, seed=off & 0xFFFFFFFF)
    return v - (1 << 64) if v >= 1 << 63 else v


def find_blocks(docs: DataFrame, length: int) -> DataFrame:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                found = []
                for rid, did, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    data = text.encode("utf-8", "surrogatepass")
                    if len(data) >= length:
                        first, count, off, key, names = text_blocks(data, length)
                        m = len(first)
                        found.append((np.full(m, rid), np.full(m, did), first, count, off, key, np.array(names, np.int64)))
                if found:
                    cols = [np.concatenate(c) for c in zip(*found)]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["rid", "did", "s0", "n", "aoff", "key", "ctx"])

    return docs.select("rid", "did", "text").mapInArrow(run, "rid bigint, did bigint, s0 int, n int, aoff int, key bigint, ctx bigint")


def repeated_starts(contexts: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """Which starts of each context begin a string that begins at another listed start too.

    A context is (bytes, number of starts, anchor's distance). Suffixes are
    sorted at cell borders; for a start u bytes before a border the u bytes must
    agree as well.
    """
    cell = 8
    whole = length // cell - 1  # cells that must agree in any case
    symbols, owner, border, raw, edge = [], [], [], [], []
    for c, (data, _, off) in enumerate(contexts):
        shift = off % cell
        body = data[shift:]
        cells = np.frombuffer(body + b"\0" * (-len(body) % cell), ">u8").astype(np.uint64)
        m = len(cells)
        at = shift + cell * np.arange(m)
        before = np.empty(m, np.uint64)
        before[1:] = cells[: m - 1]
        before[0] = int.from_bytes(data[:shift].rjust(cell, b"\0"), "big")
        symbols += [cells, np.zeros(1, np.uint64)]
        edge += [np.zeros(m, bool), np.ones(1, bool)]
        raw += [before, np.zeros(1, np.uint64)]
        border += [at, np.full(1, -1)]
        owner += [np.full(m, c), np.full(1, -1)]
    cells, ends, tails, at, who = (np.concatenate(x) for x in (symbols, edge, raw, border, owner))
    _, code = np.unique(cells, return_inverse=True)
    code = code.astype(np.int64) + 1
    code[ends] = 0
    order = suffix_array(code)
    # neighbours in the array: do the first `whole` cells agree, and how many bytes of the next?
    padded = np.concatenate([code.astype(np.uint64), np.zeros(whole + 1, np.uint64)])
    prefix, place, w = np.zeros(len(code), np.uint64), 0, 1
    level = mix64(padded)
    while w <= whole:
        if whole & w:
            prefix = mix64(prefix * _STEP + level[place : place + len(code)])
            place += w
        level = mix64(level[:-w] * _STEP + level[w:]) if len(level) > w else level
        w *= 2
    same = np.concatenate([[False], prefix[order[1:]] == prefix[order[:-1]]])
    behind = np.concatenate([cells, np.zeros(whole + 2, np.uint64)])
    agree = np.zeros(len(code), np.int64)
    for place in (whole, whole + 1):  # a start next to its border may need bytes of two cells
        nxt = behind[place : place + len(code)]
        diff = np.concatenate([[np.uint64(0)], nxt[order[1:]] ^ nxt[order[:-1]]])
        so_far = agree == cell * (place - whole)
        for k in range(1, cell + 1):
            agree += so_far & ((diff >> np.uint64(8 * (cell - k))) == 0)
    out = [np.zeros(n, bool) for _, n, _ in contexts]
    counts = np.array([n for _, n, _ in contexts])
    w_sorted, at_sorted, tail_sorted = who[order], at[order], tails[order]
    for u in range(1, cell + 1):
        run = np.cumsum(~(same & (agree >= length - u - cell * whole)))
        start = at_sorted - u
        own = (w_sorted >= 0) & (start >= 0) & (start < counts[w_sorted])
        if not own.any():
            continue
        tail = tail_sorted[own] & np.uint64((1 << 8 * u) - 1 if u < 8 else 0xFFFFFFFFFFFFFFFF)
        pair = mix64(run[own].astype(np.uint64) * _STEP + mix64(tail))
        _, inverse, number = np.unique(pair, return_inverse=True, return_counts=True)
        hit = number[inverse] > 1
        for c, s in zip(w_sorted[own][hit].tolist(), start[own][hit].tolist()):
            out[c][s] = True
    return out


def _runs(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


def settle(contexts: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts within the contexts of single copies; a key's contexts meet in one task."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            marks = repeated_starts([(r[8], r[6], r[7]) for r in rows], length) if len(rows) > 1 else [np.zeros(r[6], bool) for r in rows]
            found = [(r[3], r[4], r[5] + a, k) for r, mark in zip(rows, marks) if r[2] == 1 for a, k in _runs(mark)]
            cols = list(zip(*found)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["rid", "did", "s", "n"])

        for big in batches:
            for lo in range(0, big.num_rows, 512):
                for row in zip(*(c.to_pylist() for c in big.slice(lo, 512).columns)):
                    if size >= 400_000 and held[-1][0] != row[0]:
                        yield flush(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[8])
        if held:
            yield flush(held)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, RUN)


def split_contexts(contexts: DataFrame, step: int, length: int) -> DataFrame:
    """Each context as contexts of `step` starts; the new key names all bytes that these starts' strings share."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, _, w, rid, did, s0, n, aoff, data in zip(*(c.to_pylist() for c in batch.columns)):
                # pieces are cut at multiples of `step` counted from the anchor, the same for all contexts of the key
                cuts = sorted({0, n} | {k for k in range(aoff % step, n, step)})
                for a, b in zip(cuts, cuts[1:]):
                    part = data[a : b + length - 1]
                    # the block of starts as counted from the anchor, even where this context has a part of it
                    block = (a - aoff) // step
                    lo, hi = aoff + block * step, aoff + (block + 1) * step - 1
                    shared = data[max(hi, 0) : min(lo + length, len(data))]
                    out.append((_name(shared, block), _name(part, aoff - a), w, rid, did, s0 + a, b - a, aoff - a, part))
            cols = list(zip(*out)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in CONTEXT.split(", ")])

    return contexts.select(*(x.split()[0] for x in CONTEXT.split(", "))).mapInArrow(run, CONTEXT)


def remove_repeats(docs: DataFrame, length: int = 400, limit: int = 500, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs` (doc_id, text); with_text adds the kept bytes.

    `length` is at least 40. Each byte goes that lies in a string of `length` bytes which starts anywhere
    else too, in the same text or another row's. A null text is empty. Repeated
    rows remove each other wholly if they are long enough; a null doc_id is a
    document like any other. Other columns are ignored.
    """
    if length < GRAM + 8:
        raise ValueError(f"length {length} is below {GRAM + 8}")
    text = F.coalesce("text", F.lit(""))
    did = F.coalesce("doc_id", F.lit(-(1 << 63)))
    docs = docs.select(did.alias("did"), F.xxhash64("doc_id", text).alias("rid"), text.alias("text"))
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/blocks"
    find_blocks(docs, length).write.parquet(path)
    every = spark.read.parquet(path)
    common = stage(every.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "keys")
    blocks = stage(join_keys(every, common, "key", "k", every.count()).drop("k"), "common")
    delete_path(spark, path)
    spot = F.struct("rid", "did", "s0", "n", "aoff")
    names = stage(blocks.groupBy("key", "ctx").agg(F.count("*").alias("w"), F.min(spot).alias("spot")), "names")
    keys = names.groupBy("key").agg(F.count("*").alias("contexts"), F.count_if(F.col("w") == 1).alias("single")).where("contexts > 1 and single > 0")
    wanted = stage(join_keys(names, stage(keys, "keys"), "key", "contexts", names.count()).select("key", "ctx", "w", "spot.*", "contexts"), "wanted")
    copied = blocks.join(names.where("w > 1").select("key", "ctx"), ["key", "ctx"]).select("rid", "did", F.col("s0").alias("s"), "n")

    def with_bytes(rows: DataFrame) -> DataFrame:
        places = rows.groupBy("rid", "did").agg(F.collect_list(F.struct("key", "ctx", "w", "s0", "n", "aoff")).alias("places"))

        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for lo in range(0, big.num_rows, 256):
                    batch, out, seen = big.slice(lo, 256), [], set()
                    for rid, did, text, spots in zip(*(c.to_pylist() for c in batch.columns)):
                        if (rid, did) in seen:  # an equal row has the same places
                            continue
                        seen.add((rid, did))
                        data = text.encode("utf-8", "surrogatepass")
                        out += [(p["key"], p["ctx"], p["w"], rid, did, p["s0"], p["n"], p["aoff"], data[p["s0"] : p["s0"] + p["n"] + length - 1]) for p in spots]
                    cols = list(zip(*out)) or [()] * 9
                    kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in CONTEXT.split(", ")])

        return docs.join(places, ["rid", "did"]).select("rid", "did", "text", "places").mapInArrow(run, CONTEXT)

    covered = copied.unionByName(settle(with_bytes(wanted.where(f"contexts <= {limit}")), length))
    rest = wanted.where(f"contexts > {limit}")
    if not rest.isEmpty():
        many = with_bytes(rest)
        for step in (32, 4, 1):
            parts = stage(split_contexts(many, step, length), "parts")
            sizes = parts.groupBy("key", "ctx").agg(F.sum("w").alias("all"), F.count("*").alias("rows"), F.min(F.struct("rid", "did", "s0")).alias("spot"))
            copies = parts.join(sizes.where("all > 1").select("key", "ctx"), ["key", "ctx"]).where("w = 1")
            covered = covered.unionByName(copies.select("rid", "did", F.col("s0").alias("s"), "n"))
            if step == 1:
                break
            # one context of each name goes on, with the weight of all
            kept = sizes.select("key", "ctx", F.col("all").alias("w"), "spot.*")
            groups = kept.groupBy("key").agg(F.count("*").alias("contexts"), F.count_if(F.col("w") == 1).alias("single")).where("contexts > 1 and single > 0")
            onward = parts.drop("w").join(kept, ["key", "ctx", "rid", "did", "s0"]).join(groups, "key")
            covered = covered.unionByName(settle(onward.where(f"contexts <= {limit}").select(*(x.split()[0] for x in CONTEXT.split(", "))), length))
            many = stage(onward.where(f"contexts > {limit}").select(*(x.split()[0] for x in CONTEXT.split(", "))), "many")
            if many.isEmpty():
                break
    runs = covered.groupBy("rid", "did").agg(F.collect_list(F.struct("s", "n")).alias("runs"))

    @frugal
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "surrogatepass")
                cover = np.zeros(len(data) + 1, np.int64)
                for r in runs or ():
                    cover[r["s"]] += 1
                    cover[r["s"] + r["n"] + length - 1] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((None if did == -(1 << 63) else did, len(data), int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest(), *((kept,) if with_text else ())))
            cols = list(zip(*rows)) or [()] * (5 + with_text)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return docs.join(runs, ["rid", "did"], "left").select("did", "text", "runs").mapInArrow(finish, schema)
