"""Wishes that a listing answers, and a plan for an evening that picks one listing a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Genres by mood.
DANCE = ("Cumbia", "Salsa", "Country", "Honky-tonk", "Tejano", "Latin", "Dance/Electronic", "House", "Techno", "Disco")
QUIET = ("Jazz", "Classical", "Acoustic", "Folk", "Singer-Songwriter", "Blues", "Americana", "Bluegrass", "Ambient")
LOUD = ("Rock", "Punk", "Metal", "Hard Rock", "Hardcore", "Alternative", "Alternative Rock", "Nu-Metal", "Metalcore", "Emo", "Grunge")
ARTS = ("performing-arts", "theater", "visual-arts", "dance", "literary")
#: Blocks of a night, in hours of the day it starts on.
NIGHT = (("Early", 17.0, 20.0), ("Main", 20.0, 22.5), ("Late", 22.5, 27.0))


def desires() -> dict[str, Column]:
    """Whether a listing (is_free, price_min, price_max, hour, category, genre) answers each wish; what it doesn't state answers none."""
    genre, category = F.substring_index(F.coalesce("genre", F.lit("")), " · ", 1), F.coalesce("category", F.lit(""))
    tests = {
        "free": F.coalesce("is_free", F.lit(False)) | (F.col("price_min") == 0), "cheap": F.col("price_max") <= 20, "late": F.col("hour") >= 22,
        "dance": genre.isin(*DANCE) | category.isin("dance", "nightlife"), "quiet": genre.isin(*QUIET), "loud": genre.isin(*LOUD), "laugh": category == "comedy",
        "family": category == "family", "arts": category.isin(*ARTS),
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}


def evening_plans(rows: DataFrame, market: str, blocks: tuple = NIGHT) -> DataFrame:
    """market, and by block the id picked, of `rows` (market, id, hours, area, domain).

    Of each block the best listing goes first: two points for the area of the pick before it,
    one against its domain, then the earliest, then the least id. Blocks don't overlap, so only
    the earliest listing of each (block, area, domain) can be picked; these few are folded in order.
    """
    block = F.lit(None).cast("int")
    for i, (_, lo, hi) in reversed(list(enumerate(blocks))):
        block = F.when((F.col("hours") >= lo) & (F.col("hours") < hi), i).otherwise(block)
    first = rows.select(market, "id", "hours", "area", "domain", block.alias("block")).where("block is not null").groupBy(market, "block", "area", "domain").agg(F.min(F.struct("hours", "id")).alias("f"))
    folded = first.groupBy(market).agg(F.collect_list(F.struct("block", F.col("f.hours").alias("hours"), F.col("f.id").alias("id"), "area", "domain")).alias("all"))
    state = F.struct(F.lit(None).cast("string").alias("area"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<bigint>").alias("picks"))

    def step(s: Column, b: Column) -> Column:
        score = lambda x: F.when(F.coalesce(x["area"] == s["area"], F.lit(False)), -2).otherwise(0) + F.when(F.coalesce(x["domain"] == s["domain"], F.lit(False)), 1).otherwise(0)
        scored = F.transform(F.filter("all", lambda x: x["block"] == b), lambda x: F.struct(score(x).alias("score"), x["hours"].alias("hours"), x["id"].alias("id"), x["area"].alias("area"), x["domain"].alias("domain")))
        best = F.array_min(scored)
        return F.struct(F.coalesce(best["area"], s["area"]).alias("area"), F.coalesce(best["domain"], s["domain"]).alias("domain"), F.concat(s["picks"], F.array(best["id"])).alias("picks"))

    done = F.aggregate(F.array(*map(F.lit, range(len(blocks)))), state, step)["picks"]
    return folded.select(market, done.alias("p")).select(market, *(F.col("p")[i].alias(name.lower().replace(" ", "_")) for i, (name, *_) in enumerate(blocks)))
