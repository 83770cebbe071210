"""Large graphs in few rounds: components by star contraction, chains by doubled jumps. Each round is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of `edges` (u, v; u > v): of every node, the neighbours on one side are tied to the least of all."""
    low = F.col("low")
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), F.least("u", "low").alias("low"))
        tied = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), low.alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("low"))
        near = edges.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where(F.col("v") != low).select(F.col("v").alias("u"), low.alias("v"))
        tied = near.unionByName(least.select("u", low.alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and component (least id reachable) of every id of `nodes`, over undirected `edges` (src, dst); a null end is no edge.

    Large and small stars in turn until nothing changes: the number of rounds grows with the logarithm
    of the longest path, every node is gathered by partial minima, and a round keeps no more edges than the one before.
    """
    known = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, seen, components.rounds = Stage(known), None, 0
    while True:
        state = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen, components.rounds = tuple(state), components.rounds + 1
        for large in (True, False):
            following = Stage(_stars(now.df, large))
            now.drop()
            now = following
    # no node has two roots now
    return nodes.select("id").distinct().join(now.df, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))


components.rounds = 0  #: rounds of the last call, for tests


def trace(parents: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """id, ancestor and step of the chain of every `start` (id) up `parents` (id, parent): itself at step 0, then each node once, at most `most` of them.

    Jumps are doubled: after k rounds every node knows what lies 2^k steps on, and a chain is twice
    as long as before. A chain that comes back to a node ends before it, wherever the circle
    lies. Of a repeated id the least parent counts; an id that nobody names ends its chain.
    """
    up = parents.where("id is not null and parent is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    jumps = Stage(up)
    rows = Stage(start.where("id is not null").select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("step")).distinct())
    width, count = 1, rows.df.count()
    while most is None or width < most:
        on = rows.df.join(jumps.df.select(F.col("id").alias("of"), "parent"), F.col("ancestor") == F.col("of"))
        longer = rows.df.unionByName(on.select("id", F.col("parent").alias("ancestor"), (F.col("step") + width).alias("step")))
        following = Stage(longer.groupBy("id", "ancestor").agg(F.min("step").alias("step")))
        rows.drop()
        rows, before, count = following, count, following.df.count()
        if count == before:
            break
        far = jumps.df.select(F.col("id").alias("of"), F.col("parent").alias("far"))
        further = Stage(jumps.df.join(far, F.col("parent") == F.col("of")).select("id", F.col("far").alias("parent")))
        jumps.drop()
        jumps, width = further, 2 * width
    return rows.df if most is None else rows.df.where(F.col("step") < most)


def walks(pages: DataFrame, doors: DataFrame, most: int = 80) -> tuple[DataFrame, DataFrame]:
    """The walk of every door (door, start) over its desk's own next links: its pages (door, step, url), and why it stopped (door, pages, last, reason).

    `pages` has url (unique), next, status (null or 200: read), last (the desk says it is the last page) and
    control (it has a next control that is no link). Reasons: wall (401, 402, 403, 407, 429), fetch_error (any
    other status, or a page that nobody fetched), desk_last_page, next_control_not_a_link, no_next_link, cycle, max_pages.
    """
    read = F.coalesce(F.col("status"), F.lit(200)) == 200
    known = Stage(pages.select("url", "next", "status", F.coalesce("last", F.lit(False)).alias("last"), F.coalesce("control", F.lit(False)).alias("control")))
    links = known.df.where(read & ~F.col("last")).select(F.col("url").alias("id"), F.col("next").alias("parent"))
    steps = trace(links, doors.select(F.col("start").alias("id")), most)
    rows = Stage(doors.select("door", "start").join(steps, F.col("start") == F.col("id")).select("door", "start", "step", F.col("ancestor").alias("url")))
    ends = rows.df.groupBy("door").agg(F.max_by("url", "step").alias("last_url"), F.count("*").alias("pages"), F.collect_set("url").alias("seen"))  # at most `most` of them
    at = ends.join(known.df, F.col("last_url") == F.col("url"), "left")
    reason = (
        F.when(F.col("url").isNull(), "fetch_error").when(F.col("status").isin(401, 402, 403, 407, 429), "wall").when(~read, "fetch_error").when(F.col("last"), "desk_last_page")
        .when(F.col("next").isNull(), F.when(F.col("control"), "next_control_not_a_link").otherwise("no_next_link")).when(F.array_contains("seen", F.col("next")), "cycle").otherwise("max_pages")
    )
    return rows.df.select("door", "step", "url"), at.select("door", "pages", F.col("last_url").alias("last"), reason.alias("reason"))
