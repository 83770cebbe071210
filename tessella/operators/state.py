"""Crawl state, schedules and trends: what the reference keeps per source is rebuilt from the attempt log with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stored


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first by `order` (which must end in a unique key)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "pos", width: int = 250_000) -> DataFrame:
    """`rows` with the place of each, from 1, among those of its key by `order` (which must end in a unique key).

    Rows are dealt by sorted ranges of (key, order) of about `width` rows and stored with their place in the range; how
    many of a key lie in the ranges before is a row a range. No task holds a key, and a task holds no more of a larger table. For few keys.
    """
    parts = 1 + rows.count() // width
    dealt = stored(rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the number of the range; the other bits count its rows
    ranges = dealt.groupBy(F.col(key).alias("_key"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = stored(ranges.select("_key", "_part", (before - F.col("_first") + 1).alias("_add")))
    found = dealt.join(F.broadcast(places), F.col(key).eqNullSafe(F.col("_key")) & (part == F.col("_part")))
    return found.select(*rows.columns, (F.col("_at") + F.col("_add")).alias(name))


def fail_streak(fetches: DataFrame) -> DataFrame:
    """Failed attempts of each source after its last success; all of them if there was none.

    Two aggregations by source in one: the last success first, then a count over the same partitioning.
    """
    last_ok = fetches.groupBy("source_id").agg(F.max(F.when(~F.col("failed"), F.col("fetched_at"))).alias("last_ok"))
    joined = fetches.join(last_ok, "source_id")
    since = F.col("failed") & (F.col("last_ok").isNull() | (F.col("fetched_at") > F.col("last_ok")))
    return joined.groupBy("source_id").agg(F.count_if(since).alias("fail_streak"))


def crawl_state(fetches: DataFrame) -> DataFrame:
    """source_id, last attempt, last success, attempts, successes and current fail streak."""
    log = fetches.groupBy("source_id").agg(
        F.max("fetched_at").alias("last_attempt"), F.max(F.when(~F.col("failed"), F.col("fetched_at"))).alias("last_success"),
        F.count("*").alias("attempts"), F.count_if(~F.col("failed")).alias("successes"),
    )
    return log.join(fail_streak(fetches), "source_id")


def interval_minutes(streak: Column, base: int = 150, fail_base: int = 60, cap: int = 10080) -> Column:
    """Minutes to the next attempt: the base, or for failing sources a doubling wait under a cap."""
    wait = F.lit(fail_base) * F.pow(F.lit(2.0), F.least(streak, F.lit(30)) - 1)
    return F.when(streak <= 0, base).otherwise(F.least(wait, F.lit(float(cap)))).cast("bigint")


def due_order(states: DataFrame, now: Column) -> DataFrame:
    """states with overdue_minutes, most overdue first; a source never attempted is before all."""
    waited = F.timestamp_diff("MINUTE", F.col("last_attempt"), now)
    return states.withColumn("overdue_minutes", waited - interval_minutes(F.col("fail_streak"))).orderBy(F.desc_nulls_first("overdue_minutes"), "source_id")


def crossed_rung(hours_left: Column, hours_at_last: Column, rungs: tuple[int, ...] = (720, 336, 168, 72, 24, 6)) -> Column:
    """The nearest refresh rung (hours before start) passed since the last read; null if none or already started."""
    out = F.lit(None).cast("int")
    for rung in sorted(rungs, reverse=True):  # the smallest that fits comes last and wins
        out = F.when((hours_left >= 0) & (hours_left <= rung) & (hours_at_last.isNull() | (hours_at_last > rung)), rung).otherwise(out)
    return out


def host_budget(rows: DataFrame, host: str, per_host: int, total: int, *order: str) -> DataFrame:
    """The first `total` rows by `order` among each host's first `per_host`; a host over its cap uses up no budget.

    The total is a top-k over at most per_host rows a host.
    """
    nth = F.row_number().over(Window.partitionBy(host).orderBy(*order))
    return rows.withColumn("nth_of_host", nth).where(F.col("nth_of_host") <= per_host).orderBy(*order).limit(total)


def round_robin(rows: DataFrame, queue: str, total: int, *order: str) -> DataFrame:
    """One row of each queue in turn until `total`."""
    depth = F.row_number().over(Window.partitionBy(queue).orderBy(*order))
    return rows.withColumn("depth", depth).orderBy("depth", queue).limit(total)


def trend(current: Column, previous: Column, eps: float = 0.0001) -> Column:
    return F.when(previous.isNull(), "-").when(current > previous + eps, "up").when(current < previous - eps, "down").otherwise("flat")


def rolling_baseline(series: Window, value: str, size: int = 10) -> Column:
    """Mean of up to `size` values before the current one; null without any."""
    return F.avg(value).over(series.rowsBetween(-size, -1))


def ratchet(series: Window, value: str, eps: float = 1e-9) -> Column:
    """Whether the value falls behind the best before it."""
    best = F.max(value).over(series.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.col(value) + eps < best, F.lit(False))


def half_split(rows: DataFrame, key: str, order: str, value: str, least: int = 4) -> DataFrame:
    """Mean of the first half (rounded down) and of the rest of each key's series, and its direction; null under `least` rows."""
    w = Window.partitionBy(key)
    halves = rows.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    means = halves.groupBy(key).agg(
        F.max("_n").alias("n"), F.avg(F.when(first, F.col(value))).alias("first_mean"), F.avg(F.when(~first, F.col(value))).alias("second_mean"))
    direction = F.when(F.col("n") < least, None).when(F.col("second_mean") > F.col("first_mean"), "up").when(F.col("second_mean") < F.col("first_mean"), "down").otherwise("flat")
    return means.withColumn("direction", direction)


def clamped_scores(rows: DataFrame, key: str, order: list[str], delta: str, start: float = 0.5) -> DataFrame:
    """key and score: `start` moved by each delta in turn and kept within 0 and 1; the order matters because of the clamp.

    Steps of this kind compose: several of them are x -> clamp(x + shift, lo, hi) again. So rows are
    dealt by ranges of (key, order), each range is folded to one step, and the few steps of
    a key are applied in order; no task holds a whole key.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, *order, delta).repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id())
    runs = dealt.groupBy(key, "_part").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(delta).alias("d")))).alias("s"))
    clamp = lambda x, lo, hi: F.greatest(lo, F.least(hi, x))
    zero, one = F.lit(0.0), F.lit(1.0)
    none = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), zero.alias("shift"))
    then = lambda f, x: F.struct(clamp(f["lo"] + x["d"], zero, one).alias("lo"), clamp(f["hi"] + x["d"], zero, one).alias("hi"), (f["shift"] + x["d"]).alias("shift"))
    steps = runs.select(key, F.struct(F.element_at("s", 1).alias("first"), F.aggregate("s", none, then).alias("f")).alias("step"))
    folded = steps.groupBy(key).agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return folded.select(key, F.aggregate("steps", F.lit(start), lambda acc, x: clamp(acc + x["f"]["shift"], x["f"]["lo"], x["f"]["hi"])).alias("score"))


def smoothed(values: Column, alpha: float = 0.3) -> Column:
    """Exponentially weighted mean of an ordered array, starting at its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda acc, v: acc * (1 - alpha) + v * alpha)
