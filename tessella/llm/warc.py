"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id into shards whose bounds depend on the data
alone, so a rerun writes the same files. Each task streams its shard into
gzip-member archives, rolls to a new file by compressed size, writes under a
temporary name and renames when a file is complete; the manifest written after
all tasks names the files that count. A retried task overwrites its files with
the same bytes; files that no manifest names are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stage

DATE = "2024-01-01T00:00:00Z"  # regenerated headers carry a fixed date, or archives would differ between runs
MANIFEST = "shard bigint, file string, records bigint, bytes bigint, first_page bigint, last_page bigint, sha256 string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record with regenerated headers; a revisit has no payload of its own."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head if revisit else head + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c for c in url or "" if c not in "\r\n"), f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {n_bytes}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without name or time, so that equal records have equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def shard_bounds(ids: DataFrame, target: int, buckets: int = 2048) -> list[int]:
    """First page_id of each shard but the first, so that shards hold about `target` bytes.

    `ids` has page_id and payload_bytes. Sizes are summed in at most `buckets`
    equal ranges of ids a pass, and a range that alone exceeds the target is
    divided again; only these sums reach the driver.
    """
    span = ids.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    if span["lo"] is None:
        return []

    def sums(lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
        width = max(1, -(-(hi - lo + 1) // buckets))
        found = (
            ids.where(F.col("page_id").between(lo, hi)).groupBy(F.floor((F.col("page_id") - lo) / width).cast("bigint").alias("b"))
            .agg(F.sum("payload_bytes").alias("n")).orderBy("b").collect()
        )
        out: list[tuple[int, int]] = []
        for r in found:
            first = lo + r["b"] * width
            if r["n"] > target and width > 1 and depth < 4:
                out += sums(first, min(hi, first + width - 1), depth + 1)
            else:
                out.append((first, r["n"]))
        return out

    bounds, held = [], 0
    for first, n in sums(span["lo"], span["hi"], 0):
        if held and held + n > target:
            bounds.append(first)
            held = 0
        held += n
    return bounds


def write_warc(pages: DataFrame, path: str, shard_bytes: int = 16 << 20, roll_bytes: int = 8 << 20, revisit_from: int = 0) -> None:
    """Write a record per row of `pages` (page_id, url, html) below `path`.

    Of the rows with equal payloads of at least `revisit_from` bytes, those with
    the largest page_id are responses and the others revisit it; smaller payloads
    are all responses. A null html is an empty payload. A null page_id is written
    first, and is a response only if no row with an id has its payload. Rows with
    the same page_id are separate records. An empty table gives no archives.
    `shard_bytes` bounds the payload bytes of a task, `roll_bytes` the size of an
    archive (raise both with the input: 1 GB each suits 100 TB).
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload"))
    ids = stage(pages.select("page_id", F.sha1("payload").alias("sha1"), F.length("payload").cast("bigint").alias("payload_bytes")), "ids")
    # The copies of a payload: ids and digests only. The count is pre-aggregated,
    # and the join is one that Spark splits where a digest is common.
    copied = ids.where(F.col("payload_bytes") >= revisit_from).groupBy("sha1").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null")
    revisits = ids.join(copied.select("sha1", "keep"), "sha1").where("page_id is null or page_id <> keep").select("page_id", "sha1", "keep").distinct()
    # Marks travel beside the pages in the one exchange that moves payloads.
    rows = pages.select("page_id", F.sha1("payload").alias("sha1"), F.lit(1).alias("is_page"), "url", "payload", F.lit(None).cast("bigint").alias("keep")).unionByName(
        revisits.select("page_id", "sha1", F.lit(0).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "keep")
    )
    bounds = shard_bounds(ids, shard_bytes)
    n_shards = len(bounds) + 1

    @F.pandas_udf("int")
    def shard(page_id: pd.Series) -> pd.Series:
        found = np.searchsorted(np.array(bounds, np.int64), page_id.fillna(-(1 << 63)).astype("int64"), side="right")
        return pd.Series(found)

    sharded = rows.withColumn("shard", shard("page_id"))
    ordered = sharded.repartitionById(n_shards, "shard").sortWithinPartitions("shard", "page_id", "sha1", "is_page", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _files(path)
        system.create_dir(root, recursive=True)
        done: list[tuple] = []
        out = None
        attempt = uuid.uuid4().hex

        def close() -> None:
            nonlocal out
            if out:
                out["stream"].close()
                system.move(out["temp"], f"{root}/{out['file']}")
                done.append((out["shard"], out["file"], out["records"], out["bytes"], out["first"], out["last"], out["sha"].hexdigest()))
            out = None

        mark, numbers = None, {}
        for batch in batches:
            for page, sha1, is_page, url, body, keep, shard in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if not is_page:
                    mark = (page, sha1, keep)
                    continue
                target = mark[2] if mark and mark[:2] == (page, sha1) else None
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = gzip_member(record(page, url, body, len(body), digest, target, target is not None))
                if out and (out["shard"] != shard or out["bytes"] + len(member) > roll_bytes):
                    close()
                if not out:
                    k = numbers[shard] = numbers.get(shard, -1) + 1
                    file = f"pages-{shard:06d}-{k:04d}.warc.gz"
                    temp = f"{root}/.{file}.{attempt}"
                    out = {"shard": shard, "file": file, "temp": temp, "stream": system.open_output_stream(temp, compression=None), "records": 0, "bytes": 0, "first": page, "sha": hashlib.sha256()}
                out["stream"].write(member)
                out["sha"].update(member)
                out["records"] += 1
                out["bytes"] += len(member)
                out["last"] = page
        close()
        cols = list(zip(*done)) or [()] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    ordered.select("page_id", "sha1", "is_page", "url", "payload", "keep", "shard").mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")


def parse_record(data: bytes) -> dict:
    head, block = data.split(b"\r\n\r\n", 1)
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = block[: int(names["Content-Length"])]
    if names["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
        raise ValueError(f"block digest of {names['WARC-Record-ID']} doesn't match")
    return names | {"payload": block.split(b"\r\n\r\n", 1)[1]}


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    rest, z, parts = b"", zlib.decompressobj(31), []
    while True:
        chunk = rest or stream.read(step)
        if not chunk:
            if parts or z.unconsumed_tail:
                raise ValueError("the archive ends within a record")
            return
        parts.append(z.decompress(chunk))
        rest = b""
        if z.eof:
            rest = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that the manifest names.

    Digests of blocks and response payloads are worked out again and checked.
    with_payload adds the url and the payload (null for a revisit).
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if with_payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string(), pa.binary()] if with_payload else [])]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _files(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with system.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for data in members(stream):
                        r = parse_record(data)
                        kind, digest, n = r["WARC-Type"], r["WARC-Payload-Digest"].removeprefix("sha1:"), int(r["X-Payload-Length"])
                        if kind == "response" and (base32_sha1(r["payload"]) != digest or len(r["payload"]) != n):
                            raise ValueError(f"payload of {r['WARC-Record-ID']} doesn't match its header")
                        page, refers = r.get("X-Page-Id"), r.get("X-Refers-To-Page")
                        more = (r.get("WARC-Target-URI", ""), r["payload"] if kind == "response" else None) if with_payload else ()
                        rows.append((int(page) if page else None, n, digest, kind, int(refers) if refers else None, *more))
                        if len(rows) >= 1000:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", url string, payload binary" if with_payload else "")
    return manifest.repartition(parts, "file").mapInArrow(run, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write `pages` to archives in the shared folder and return what the archives say."""
    path = f"{shared_dir(pages.sparkSession)}/warc"
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
