"""What every order of the filters removes, step by step.

The orders of the filters are the paths of a trie. It is walked depth first: a node's
survivors are those of the node above without what the last filter fails, kept as
a persisted DataFrame while the nodes below are at work. The same filters in
another order leave the same survivors, so a node is looked up by its set of filters and
counted once. At each node one aggregation counts, for every filter that may
come next, what it removes from the survivors: the edges of the trie. The counts
of a node are written to the shared folder, and the report joins them with the
paths; nothing of the size of the input, nor of its parts, goes through the driver.

Survivors are filtered from a stored table of flags, so a lost executor costs one short scan.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, shared_dir, stage

#: Words are separated by these six characters, and only by them.
_SPACE = "[\\x20\\x09-\\x0D]+"


def word_count_below(text: Column, n: int) -> Column:
    return F.size(_words(text)) < n


def distinct_share_below(text: Column, percent: int) -> Column:
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def capitals_above(text: Column, percent: int) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > percent * F.length(text)


def symbols_present(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def filter_flags(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Column], copies: str | None) -> DataFrame:
    """part, fails (bit k: the k-th filter fails), good and toxic of each row of `docs`, stored.

    `rules` gives the condition of failure of each letter over the column `text`; the letter
    `copies`, which comes last, fails a text that a row of a smaller doc_id has too.
    """
    fails = sum((F.when(rule, F.lit(1 << k)).otherwise(0) for k, rule in enumerate(rules.values())), F.lit(0))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), fails.alias("fails"))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    if copies is None:
        return stage(rows.select("part", "fails", "good", "toxic"), "flags")
    rows = stage(rows, "rows")
    first = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    hot = F.broadcast(first.where(F.col("n") > F.lit(HOT_SHARE) * rows.count()).select("digest", "first"))  # so frequent are at most 1 / HOT_SHARE texts
    cold = first.where(F.col("n") <= F.lit(HOT_SHARE) * rows.count()).select("digest", "first")
    found = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest", "left"))
    again = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(rules))).otherwise(0)
    return stage(found.select("part", (F.col("fails") + again).alias("fails"), "good", "toxic"), "flags")


class _Audit:
    """One walk over the trie of filter orders."""

    def __init__(self, flags: DataFrame, filters: str):
        self.filters, self.spark = filters, flags.sparkSession
        self.folder = shared_dir(self.spark)
        #: States whose edges are counted, by their unordered set of filters.
        self.counted: set[int] = set()
        self.visit((), flags)

    def state(self, prefix: tuple[int, ...]) -> int:
        return sum(1 << k for k in prefix)

    def visit(self, prefix: tuple[int, ...], above: DataFrame) -> None:
        """Count the edges below `prefix`; `above` holds the survivors of all its filters but the last."""
        state = self.state(prefix)
        if state in self.counted or len(prefix) == len(self.filters):  # the last filter's removals lie on the edge to it
            return
        self.counted.add(state)
        survivors = above.where(F.col("fails").bitwiseAND(1 << prefix[-1]) == 0) if prefix else above
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.count_edges(state, survivors)
            for k in range(len(self.filters)):
                if k not in prefix:
                    self.visit((*prefix, k), survivors)
        finally:
            survivors.unpersist()

    def count_edges(self, state: int, survivors: DataFrame) -> None:
        counts = [F.count("*").alias("there")]
        for k in range(len(self.filters)):
            if not state >> k & 1:
                gone = F.col("fails").bitwiseAND(1 << k) != 0
                counts += [F.count_if(gone).alias(f"removed{k}"), F.count_if(gone & F.col("good")).alias(f"good{k}"), F.count_if(gone & F.col("toxic")).alias(f"toxic{k}")]
        edges = [
            F.struct(F.lit(k).alias("next"), *(F.col(f"{c}{k}").alias(c) for c in ("removed", "good", "toxic")))
            for k in range(len(self.filters))
            if not state >> k & 1
        ]
        table = survivors.groupBy("part").agg(*counts).select("part", "there", F.inline(F.array(*edges)))
        table.coalesce(1).write.parquet(f"{self.folder}/state={state}")

    def edges(self) -> DataFrame:
        """state, next, part, there (survivors before), removed, good and toxic of each edge and part that has survivors."""
        schema = "part string, there bigint, next int, removed bigint, good bigint, toxic bigint, state int"
        return self.spark.read.schema(schema).parquet(self.folder)


def audit_filters(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Column], copies: str | None = None) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    A part is a value of `lang`; a null one is the empty string. A null text is empty, so it equals
    other empty texts. Rows count one by one: equal rows of one doc_id are no copies of each other, as
    none has a smaller id, and a row with a null doc_id is never a copy, nor has it labels. A document with
    several labels is good or toxic if one says so. An empty table gives no rows. Columns other
    than doc_id, text and lang are ignored, as are labels of other documents.
    """
    filters = "".join(rules) + (copies or "")
    n = len(filters)
    flags = filter_flags(docs, labels, rules, copies)
    edges = _Audit(flags, filters).edges()
    alone = [F.count_if(F.col("fails") == 1 << k) for k in range(n)]
    fails = [F.count_if(F.col("fails").bitwiseAND(1 << k) != 0) for k in range(n)]
    orders = list(itertools.permutations(range(n)))
    steps = [("".join(filters[k] for k in o), s + 1, sum(1 << k for k in o[:s]), o[s]) for o in orders for s in range(n)]
    spark = docs.sparkSession
    plan = spark.createDataFrame(steps, "filter_order string, step int, state int, next int")
    parts = flags.groupBy("part").agg(F.count("*").alias("all"), F.array(*alone).alias("alone"), F.array(*fails).alias("failing"))
    # each order takes an edge's filter on top of the edge's state, with |state|! ways before and (n - 1 - |state|)! ways behind
    before = F.bit_count("state")
    ways = F.element_at(F.array(*(F.lit(math.factorial(s) * math.factorial(n - 1 - s)) for s in range(n))), (before + 1).cast("int"))
    share = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    each = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("next"), "all", "alone", "failing")
    each = each.join(share, ["part", "next"], "left")
    rows = each.join(F.broadcast(plan), "next").join(edges, ["part", "state", "next"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("there", "removed", "good", "toxic", "shapley")}
    return rows.withColumns(zero).select(
        "part", "filter_order", "step",
        (F.col("there") - F.col("removed")).alias("kept"), "removed",
        (F.get("failing", F.col("next")) - F.col("removed")).alias("redundant"), F.get("alone", F.col("next")).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def standard_filters(text: str = "text") -> dict[str, Column]:
    """A: under 200 words; B: fewer than half of them distinct; C: more than 3 in 100 characters are capitals; D: a symbol among #$%&*|."""
    t = F.col(text)
    return {"A": word_count_below(t, 200), "B": distinct_share_below(t, 50), "C": capitals_above(t, 3), "D": symbols_present(t)}
