"""Fetch attempts as a stream: counts by window with late data, and failure streaks as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.staging import shared_dir

STREAKS = "source_id bigint, fail_streak bigint, last_success timestamp, n bigint"


def attempts(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files under `path`, a folder or one file, with the columns of fetch attempts."""
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, which may name a file too
    rows = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double").option("maxFilesPerTrigger", per_batch).parquet(path)
    return rows.select(F.col("event_id").alias("fetch_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("fetched_at"), (F.col("event_type") == "error").alias("failed"))


def windowed_counts(fetches: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """hour, n and failures of each window; rows later than `late` behind the newest are left to the watermark."""
    grouped = fetches.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.count_if("failed").alias("failures")).select(F.col("w.start").alias("hour"), "n", "failures")


def fail_streaks(fetches: DataFrame) -> DataFrame:
    """After each batch, the failures of a source since its last success.

    Attempts count in order of time, then id, whatever batch brings them: state is a source's last success and the
    failures after it, so a late success takes back those before it. A source's batch is read piece by piece.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, id_, n, times, ids = state.get if state.exists else (None, None, 0, [], [])
        success = None if at is None else (at, id_)
        failures = list(zip(times, ids))
        for rows in batches:
            n += len(rows)
            moments = list(zip(rows["fetched_at"].astype("datetime64[us]").astype("int64").tolist(), rows["fetch_id"].tolist(), rows["failed"].tolist()))
            success = max([(t, i) for t, i, failed in moments if not failed], default=success) if success is None else max([success, *((t, i) for t, i, failed in moments if not failed)])
            failures = [f for f in [*failures, *((t, i) for t, i, failed in moments if failed)] if success is None or f > success]
        at, id_ = success or (None, None)
        state.update((at, id_, n, [t for t, _ in failures], [i for _, i in failures]))
        last = None if at is None else pd.Timestamp(at, unit="us").to_pydatetime()
        yield pd.DataFrame({"source_id": [key[0]], "fail_streak": [len(failures)], "last_success": pd.Series([last], dtype="datetime64[ns]"), "n": [n]})

    held = "success_at bigint, success_id bigint, n bigint, fail_at array<bigint>, fail_id array<bigint>"
    return fetches.groupBy("source_id").applyInPandasWithState(step, STREAKS, held, "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, with the number of its batch; files and progress lie in the shared folder."""
    path = shared_dir(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")  # a batch that runs again replaces itself

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/out")
