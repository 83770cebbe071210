"""Shared pieces of the corpus operators: table access, shared staging, words and hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = b" \t\n\x0b\x0c\r"

_own_dirs: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors of a cluster share.

    Where the setting is absent on a local master (tests) a temporary folder is set as
    the checkpoint folder first; on a cluster that raises, as no local folder is shared.
    Folders made here are deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        _own_dirs.append((spark, base))
    path = f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"
    _own_dirs.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    while _own_dirs:
        spark, path = _own_dirs.pop()
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started inside hand at most `rows` whole texts at a time to a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage: what was computed survives the loss of any executor
    and is not computed again by later jobs.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, mostly whole texts, that a Python worker takes at a time.
SLICE = 512


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` (a function for mapInArrow) over slices of at most SLICE rows, however large Spark's batches are.

    What its task has freed is given back to the machine at the end, as Python workers outlive their tasks.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(big.slice(lo, SLICE) for big in batches for lo in range(0, big.num_rows, SLICE))
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # C libraries other than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: So many ids, 8 bytes each, are broadcast at most.
BROADCAST_IDS = 1_000_000


def join_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """`docs` joined by doc_id with `ids`, a stored table of few columns; up to BROADCAST_IDS rows of it are broadcast, so that texts stay where they are."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


#: A key of more than this share of all rows is hot; there are at most its inverse of them.
HOT_SHARE = 0.001


def join_keys(rows: DataFrame, keys: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """`rows` (of about `total`) joined with `keys`, stored and unique in `on`, whose `size` tells how many rows each has.

    Hot keys, of which there are at most 1 / HOT_SHARE, are broadcast, so that their rows are not gathered in one task.
    """
    hot = F.broadcast(keys.where(F.col(size) > HOT_SHARE * total))
    cold = keys.where(F.col(size) <= HOT_SHARE * total)
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on))


def split_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 text: bytes.split() separates at exactly these six characters."""
    return text.split()


# ---------------------------------------------------------------------------
# 64-bit hashes of words and shingles, many documents at a time
# ---------------------------------------------------------------------------

_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    v = 1
    for i in range(n):
        out[i] = v
        v = v * base & _MASK
    return out


_POWER = _powers(0xD6E8FEB86659FD93, 4096)


def _power(n: int) -> np.ndarray:
    global _POWER
    while len(_POWER) < n:
        step = np.uint64(pow(0xD6E8FEB86659FD93, len(_POWER), 1 << 64))
        _POWER = np.concatenate([_POWER, _POWER * step])
    return _POWER


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_hashes(texts: list[bytes], step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order, and the number of words of each text.

    Bytes are taken in pieces of about `step`, cut at white space, so the
    arrays in use at once do not grow with the texts.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + step, len(data))
        while not _IS_SPACE[data[hi - 1]]:  # the last byte of all is a line end
            hi = min(hi + 4096, len(data))
            back = np.flatnonzero(_IS_SPACE[data[max(lo, hi - 4096) : hi]])
            if len(back):
                hi = max(lo, hi - 4096) + int(back[-1]) + 1
        found, start = _piece_hashes(data[lo:hi])
        hashes.append(found)
        starts.append(start + lo)
        lo = hi
    start = np.concatenate(starts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(start, np.concatenate([[0], ends])))


def _piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of `data`, which ends in white space."""
    space = _IS_SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(start):
        return np.empty(0, np.uint64), start
    word = np.cumsum(np.bincount(start, minlength=len(data)), dtype=np.int32) - np.int32(1)
    pos = np.arange(len(data), dtype=np.int32) - start.astype(np.int32)[np.maximum(word, 0)]
    pos[space] = 0
    value = _power(int(pos.max()) + 1)[pos]
    value *= _BYTE[data]
    value[space] = 0
    return mix64(np.add.reduceat(value, start)), start


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; of the whole sequence where it is shorter; none of nothing."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : n - k + 1 + i]
    return mix64(out)
