"""Fuzzy and interval matching with blocking keys: no pair is made that shares no key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_pairs(rows: DataFrame, key: str, minute: str, unique: str, width: int) -> DataFrame:
    """Pairs (a, b), a < b by `unique`, of one key whose minutes differ by at most `width`.

    Times fall into buckets of that width and the right side is copied into the
    buckets beside its own, so it is an equi-join on (key, bucket) with the exact test behind it.
    """
    bucket = F.floor(F.col(minute) / width)
    left = rows.select(F.col(key).alias("k"), bucket.alias("b"), F.col(unique).alias("a_id"), F.col(minute).alias("a_min"))
    right = rows.select(F.col(key).alias("k2"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b2"), F.col(unique).alias("b_id"), F.col(minute).alias("b_min"))
    near = (F.col("k") == F.col("k2")) & (F.col("b") == F.col("b2")) & (F.col("a_id") < F.col("b_id")) & (F.abs(F.col("a_min") - F.col("b_min")) <= width)
    return left.join(right, near).select(F.col("k").alias(key), "a_id", "b_id", (F.col("b_min") - F.col("a_min")).alias("apart"))


def differing_pairs(rows: DataFrame, keys: list[str], name: str, unique: str) -> DataFrame:
    """Pairs (a_id, b_id), a_id < b_id, of rows with equal `keys` and other names; a null part is equal to nothing.

    The names of a key meet first, each once, so copies of one name make no pair; only rows of names that differ from another
    are joined then, dealt by pair of names over as many tasks as the session has partitions.
    """
    known = rows.dropna(subset=[*keys, name])
    names = known.select(*keys, name).distinct()
    two = names.join(names.withColumnRenamed(name, "_other"), keys).where(F.col(name) != F.col("_other"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = known.join(two, [*keys, name]).select(*keys, F.col(name).alias("_name"), "_other", F.col(unique).alias("a_id"))
    right = known.select(*keys, F.col(name).alias("_other"), F.col(unique).alias("b_id"))
    by = [*keys, "_other"]
    pairs = left.repartition(parts, *by).join(right.repartition(parts, *by), by)
    return pairs.where("a_id < b_id").select("a_id", "b_id")


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct [a-z0-9]+ runs of two characters or more, without stop words; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    keep = F.filter(found, lambda w: F.length(w) > 1)
    if stop_words:
        keep = F.array_except(keep, F.array(*map(F.lit, stop_words)))
    return F.array_distinct(keep)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word padded with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays of distinct values; 0 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float, at_least: str = ">=") -> DataFrame:
    """(l_id, r_id, similarity) of all pairs of `left` and `right` (id, items) with Jaccard similarity of at least `threshold`.

    Prefix filter: both sides order their items by rarity and only the first
    n - ceil(threshold * n) + 1 of each are join keys, which every similar pair shares.
    """
    rarity = left.select(F.explode("items").alias("item")).unionByName(right.select(F.explode("items").alias("item"))).groupBy("item").agg(F.count("*").alias("df"))

    def keyed(rows: DataFrame) -> DataFrame:
        ranked = rows.select("id", "items", F.explode("items").alias("item")).join(rarity, "item")
        place = F.row_number().over(Window.partitionBy("id").orderBy("df", "item"))
        need = F.size("items") - F.ceil(F.lit(threshold) * F.size("items")) + 1
        return ranked.withColumn("place", place).where(F.col("place") <= need).select("id", "items", "item")

    a, b = keyed(left), keyed(right)
    pairs = a.select(F.col("id").alias("l_id"), F.col("items").alias("l_items"), "item").join(b.select(F.col("id").alias("r_id"), F.col("items").alias("r_items"), "item"), "item")
    scored = pairs.dropDuplicates(["l_id", "r_id"]).select("l_id", "r_id", jaccard(F.col("l_items"), F.col("r_items")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def best_match(pairs: DataFrame) -> DataFrame:
    """Of each l_id the most similar r_id; ties go to the smaller r_id."""
    nth = F.row_number().over(Window.partitionBy("l_id").orderBy(F.desc("similarity"), "r_id"))
    return pairs.withColumn("_n", nth).where("_n = 1").drop("_n")


def identity_verdict(pairs: list[tuple[Column, Column]]) -> Column:
    """different if any field that both sides state differs, else same if any agrees, else unknown."""
    differ, agree = F.lit(False), F.lit(False)
    for a, b in pairs:
        differ = differ | F.coalesce(a != b, F.lit(False))
        agree = agree | F.coalesce(a == b, F.lit(False))
    return F.when(differ, "different").when(agree, "same").otherwise("unknown")


def drifted(fields: list[str], old: str, new: str) -> Column:
    """Names of the fields whose value changed, null counting as a value."""
    marks = [F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in fields]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())
