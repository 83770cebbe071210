"""Trust: source-class gates, opinions (belief, disbelief, uncertainty, base rate), and decisions by expected loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIOR_WEIGHT = 2.0


def gate(classes: Column, anchors: list[str], needed: int = 2) -> Column:
    """ready if any class is an anchor or there are `needed` distinct ones, else how many are missing; over an array of distinct classes."""
    anchored = F.arrays_overlap(classes, F.array(*map(F.lit, anchors)))
    return F.when(anchored | (F.size(classes) >= needed), "ready").otherwise(F.concat(F.lit("needs "), (F.lit(needed) - F.size(classes)).cast("string")))


def derived_confidence(classes: Column, anchors: list[str], needed: int = 2) -> Column:
    return F.when(gate(classes, anchors, needed) == "ready", "confirmed").otherwise("unverified")


def opinion(r: Column, s: Column, base: float = 0.5) -> Column:
    """struct b, d, u, a from r supporting and s opposing pieces of evidence."""
    total = r + s + PRIOR_WEIGHT
    return F.struct((r / total).alias("b"), (s / total).alias("d"), (F.lit(PRIOR_WEIGHT) / total).alias("u"), F.lit(base).alias("a"))


def expectation(o: Column) -> Column:
    return o["b"] + o["a"] * o["u"]


def averaged(rows: DataFrame, key: str, b: str, d: str, u: str) -> DataFrame:
    """Averaging fusion of dependent opinions of a key: weights 1 / u; where some are dogmatic (u = 0) only these count, alike."""
    sure = F.count_if(F.col(u) == 0)
    w = F.when(F.col(u) > 0, 1 / F.col(u))
    mix = lambda x: F.when(F.col("n0") > 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1") / F.col("w"))
    mean = lambda x: F.avg(F.when(F.col(u) == 0, F.col(x))).alias(f"{'b' if x == b else 'd'}0")
    sums = rows.groupBy(key).agg(sure.alias("n0"), F.sum(w).alias("w"), F.count("*").alias("n"), mean(b), mean(d), F.sum(w * F.col(b)).alias("b1"), F.sum(w * F.col(d)).alias("d1"))
    return sums.select(key, mix("b").alias("b"), mix("d").alias("d"), F.when(F.col("n0") > 0, 0.0).otherwise(F.col("n") / F.col("w")).alias("u"))


def three_way_gate(base_ready: Column, instants: Column, ambiguous: Column, invalid: Column, private: Column) -> Column:
    """struct decision, reason, hole, note: an unready base holds, an invalid or private row is escalated, else it passes; a contested clock is a hole and decides nothing."""
    why = F.concat_ws("; ", F.when(invalid, "validation_error"), F.when(private, "private"))
    return F.struct(
        F.when(~base_ready, "hold").when(why != "", "escalate").otherwise("pass").alias("decision"), F.when(base_ready & (why != ""), why).alias("reason"),
        F.when(instants > 1, "start_time").alias("hole"), F.when(ambiguous, "identity_unsettled").alias("note"))


def verification(spoof: Column, authoritative: Column, resolved: Column, second_signals: Column, unreachable: Column, confirmed_from: int = 2) -> Column:
    """struct decision, confidence, hold_reason: spoof holds, an authority or what resolves to one verifies, a second signal validates, else held."""
    return F.struct(
        F.when(spoof, "hold").when(authoritative | resolved, "verified").when(second_signals >= 1, "validated").otherwise("hold").alias("decision"),
        F.when(spoof, None).when(authoritative | resolved | (second_signals >= confirmed_from), "confirmed").when(second_signals >= 1, "unverified").alias("confidence"),
        F.when(spoof, "spoof").when(authoritative | resolved | (second_signals >= 1), None).when(unreachable, "no_second_signal").otherwise("no_authority").alias("hold_reason"))


def settled_conflicts(claims: DataFrame, key: str, source: str, instant: str) -> DataFrame:
    """key, n_settled and contested: a source that contradicts itself is not settled, and only two settled sources with different instants contest a clock."""
    each = claims.where(F.col(instant).isNotNull()).groupBy(key, source).agg(F.min(instant).alias("lo"), F.max(instant).alias("hi")).where("lo = hi")
    return each.groupBy(key).agg(F.count("*").alias("n_settled"), (F.min("lo") < F.max("lo")).alias("contested"))


def value_of_information(modes: DataFrame, branches: DataFrame, costs: DataFrame, key: str, price: float) -> DataFrame:
    """key, prior and value: the least prior loss, less the expected least loss behind an answer, less its price.

    `modes` has key, mode, p; `branches` has key, answer, mode, p (joint, adding up to `modes`);
    `costs` has action, mode, loss and is a small fixed table.
    """

    def least(rows: DataFrame, by: list[str]) -> DataFrame:
        losses = rows.join(F.broadcast(costs), "mode").groupBy(*by, "action").agg(F.sum(F.col("p") * F.col("loss")).alias("loss"))
        return losses.groupBy(*by).agg(F.min("loss").alias("loss"))

    after = least(branches, [key, "answer"]).groupBy(key).agg(F.sum("loss").alias("after"))
    return least(modes, [key]).join(after, key).select(key, F.col("loss").alias("prior"), (F.col("loss") - F.col("after") - price).alias("value"))


def discounted(o: Column, trust: Column) -> Column:
    """The opinion as seen through a source that is trusted by `trust` (0..1)."""
    b, d = trust * o["b"], trust * o["d"]
    return F.struct(b.alias("b"), d.alias("d"), (1 - b - d).alias("u"), o["a"].alias("a"))


def fused(rows: DataFrame, key: str, r: str, s: str) -> DataFrame:
    """Cumulative fusion of all opinions of a key: evidence adds up, so it is one aggregation in any order."""
    return rows.groupBy(key).agg(F.sum(r).alias("r"), F.sum(s).alias("s")).withColumn("opinion", opinion(F.col("r"), F.col("s")))


def four_state(o: Column, *, dispute: float, confirm: float, uncertain: float) -> Column:
    """disputed before confirmed before unverified before likely."""
    return (
        F.when((o["d"] >= dispute) & (o["b"] >= dispute), "disputed").when(expectation(o) >= confirm, F.when(o["u"] < uncertain, "confirmed").otherwise("unverified"))
        .when(o["u"] >= uncertain, "unverified").when(expectation(o) >= 0.5, "likely").otherwise("unverified")
    )


def decide(probabilities: DataFrame, costs: DataFrame, key: str) -> DataFrame:
    """Action of least expected loss of each key; ties go to the action listed first.

    `probabilities` has key, mode, p; `costs` has action, pos, mode, loss and is a small fixed table.
    """
    losses = probabilities.join(F.broadcast(costs), "mode").groupBy(key, "action", "pos").agg(F.sum(F.col("p") * F.col("loss")).alias("loss"))
    return losses.groupBy(key).agg(F.min(F.struct(F.round("loss", 9).alias("loss"), "pos", "action")).alias("best")).select(key, "best.action", "best.loss")


def publish_decision(fabrication: Column, ratified: Column, gate_decision: Column, reliability: Column) -> Column:
    """First rule that applies: fabrication holds, an unratified class waits, an escalation and a weak source go to a human, then the gate."""
    return (
        F.when(fabrication, "hold").when(~ratified, "not_ratified").when(gate_decision == "escalate", "human").when(reliability < 0.35, "human")
        .when(gate_decision == "pass", "publish").when(gate_decision == "hold", "hold").otherwise("human")
    )
