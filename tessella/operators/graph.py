"""Graph and bi-temporal operators over node, edge and fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import components as components
from .chains import trace


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id and depth of what `start` (id) reaches in at most `hops` undirected steps over `edges` (src, dst); the plan has one join a hop."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, hops + 1):
        new = front.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = new.withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen


def intervals(rows: DataFrame, key: str, at: str, unique: str) -> DataFrame:
    """rows with valid_from and valid_to (half open, null while current): each row holds until the next of its key."""
    w = Window.partitionBy(key).orderBy(at, unique)
    return rows.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def valid_at(rows: DataFrame, moment: str) -> DataFrame:
    """Rows whose interval holds at the moment and that nothing supersedes."""
    at = F.lit(moment).cast("timestamp_ntz")
    return rows.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def single_fact(claims: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value that all claims of a key agree on, or the dispute."""
    found = claims.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("found"))
    state = F.when(F.size("found") == 0, "abstain").when(F.size("found") == 1, "fact").otherwise("dispute")
    return found.select(*keys, state.alias("state"), F.when(F.size("found") == 1, F.element_at("found", 1)).alias("value"), F.size("found").alias("n_values"))


def ledger_as_of(log: DataFrame, moment: str) -> DataFrame:
    """Entries known at the moment that no entry known then supersedes; the latest of each key and type."""
    known = log.where(F.col("retrieved_at") <= F.lit(moment).cast("timestamp_ntz"))
    gone = known.where("supersedes_seq is not null").select(F.col("supersedes_seq").alias("seq")).distinct()
    live = known.join(gone, "seq", "left_anti")
    nth = F.row_number().over(Window.partitionBy("key", "type").orderBy(F.desc("seq")))
    return live.withColumn("_n", nth).where("_n = 1").drop("_n")


def lineage(parents: DataFrame, start: DataFrame) -> DataFrame:
    """id, ancestor and step of each chain from `start` up `parents` (id, parent) to its origin; a chain that comes back to a node ends before it."""
    return trace(parents, start)


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int, kinds: list[str] | None = None, gone: DataFrame | None = None) -> DataFrame:
    """The edges (src, dst, kind) among all nodes within `hops` undirected steps of `start` (id); `kinds` limits the steps and edges.

    `gone` (id) names nodes that don't hold at the moment asked for: they neither appear nor bridge.
    """
    live = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    if gone is not None:
        for end in ("src", "dst"):
            live = live.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        start = start.join(gone, "id", "left_anti")
    reached = k_hop(live, start, hops)
    for end in ("src", "dst"):
        live = live.join(reached.select(F.col("id").alias(end)), end, "left_semi")
    return live.select("src", "dst", "kind").distinct()


def contradictions(claims: DataFrame, key: str, value: str, source: str) -> DataFrame:
    """key, n_values, values and sources (both sorted) of each key whose sources disagree."""
    found = claims.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"), F.array_sort(F.collect_set(source)).alias("sources"))
    return found.where(F.size("values") > 1).select(key, F.size("values").alias("n_values"), "values", "sources")


def superseded(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `superseded_by` (null for the current one) and revision; nothing is deleted."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("revision", F.row_number().over(w)).withColumn("superseded_by", F.lead(order[-1]).over(w))


def folded(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """id and canonical of every entity after the standing merges (seq, src, dst, undo): of each src the latest row counts, and an undo takes it back."""
    latest = merges.groupBy("src").agg(F.max_by(F.struct("dst", "undo"), "seq").alias("m")).where("not m.undo").select("src", "m.dst")
    return entities.join(latest, F.col("id") == F.col("src"), "left").select("id", F.coalesce("dst", "id").alias("canonical"))
