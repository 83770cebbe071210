"""Upserts on plain tables: functions of the stored and the incoming rows that return the merged table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; on equal versions the incoming one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(version)))
    return both.withColumn("_n", nth).where("_n = 1").drop("_n", "_new")


def upsert_seen(stored: DataFrame, fresh: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Upsert that keeps the first sighting and moves the last one; other columns follow the last."""
    others = [c for c in stored.columns if c not in (*keys, first, last)]
    both = stored.unionByName(fresh)
    latest = F.max_by(F.struct(*others), F.col(last))
    return both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), latest.alias("_o")).select(*keys, first, last, *(F.col(f"_o.{c}").alias(c) for c in others))


def fenced_update(stored: DataFrame, fresh: DataFrame, key: str, allowed, columns: list[str]) -> DataFrame:  # noqa: ANN001
    """Stored rows with `columns` taken from `fresh` where the stored row allows it; a null there leaves the old value; `refused` tells where it didn't."""
    new = fresh.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    both = stored.join(new, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    kept = [c for c in stored.columns if c not in columns]
    values = [F.when(hit & allowed, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) for c in columns]
    return both.select(*kept, *values, (hit & ~allowed).alias("refused"))


def compare_and_swap(stored: DataFrame, stamps: DataFrame, key: str, column: str) -> DataFrame:
    """stored with `column` changed to the stamp's `new` only where it still has the stamp's `expected`; `swapped` tells."""
    both = stored.join(stamps.select(key, "expected", "new"), key, "left")
    swap = F.coalesce(F.col(column) == F.col("expected"), F.lit(False))
    return both.select(*(c for c in stored.columns if c != column), F.when(swap, F.col("new")).otherwise(F.col(column)).alias(column), swap.alias("swapped"))


def violations(rows: DataFrame, rules: dict) -> DataFrame:
    """rule and n: how many rows break each rule (a boolean column; unknown counts as kept). One pass."""
    counted = rows.agg(*(F.count_if(~rule).alias(name) for name, rule in rules.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("r")).select("r.*")
