"""What each acquisition teaches: recipes of sources and the record of techniques, as state that is kept by event time."""

from __future__ import annotations

import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How much an outcome moves reliability, how many yields are remembered, and how many empty outcomes in a row call for a new look.
ALPHA, YIELDS, EMPTIES = 0.3, 20, 2
START = {"attempts": 0, "successes": 0, "reliability": 0.5, "confidence": 0.5, "empty": 0, "version": 0, "last_yield": None, "median_yield": None}
RECIPE = "source_id bigint, attempts bigint, successes bigint, last_yield bigint, median_yield double, reliability double, confidence double, empty bigint, rediscover boolean, version bigint, replaced bigint, techniques string"
_STATE = "attempts bigint, successes bigint, reliability double, confidence double, empty bigint, version bigint, last_yield bigint, median_yield double, yields array<bigint>"
_OUTCOME = "at timestamp, outcome_id bigint, found bigint, success boolean, technique string"


def learned(recipe: dict, found: int, success: bool) -> dict:
    """The recipe after one outcome; a success that found nothing is none."""
    good = bool(success) and found > 0
    yields = [*recipe["yields"], int(found)][-YIELDS:]
    return {
        "attempts": recipe["attempts"] + 1, "successes": recipe["successes"] + good, "reliability": round((1 - ALPHA) * recipe["reliability"] + ALPHA * good, 6),
        "confidence": round(min(1.0, recipe["confidence"] + 0.05) if good else max(0.0, recipe["confidence"] - 0.1), 6), "empty": 0 if good else recipe["empty"] + 1,
        "version": recipe["version"] + 1, "last_yield": int(found), "median_yield": float(statistics.median(yields)), "yields": yields,
    }


class _Learner(StatefulProcessor):
    """Outcomes of a source in order of time, then id, however they arrive.

    recipe is the state up to the watermark, before which nothing more arrives. waiting holds the outcomes
    behind it, so a late one takes its place; techniques counts attempts and successes of each; replaced
    lists the times at which a version was superseded, the last YIELDS of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recipe = handle.getValueState("recipe", _STATE)
        self.waiting = handle.getListState("waiting", _OUTCOME)
        self.techniques = handle.getMapState("techniques", "technique string", "attempts bigint, successes bigint")
        self.replaced = handle.getListState("replaced", "at timestamp, version bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        names = [c.split()[0] for c in _OUTCOME.split(", ")]
        mark = pd.Timestamp(max(0, timerValues.getCurrentWatermarkInMs()), unit="ms")
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        fresh = [r for batch in rows for r in batch[names].itertuples(index=False, name=None)]
        tries: dict[str, tuple[int, int]] = {}  # each call on the state is a round trip, so a technique is read and written once a batch
        for _, _, found, success, technique in fresh:
            if technique is not None:
                tried, worked = tries.get(technique, (0, 0))
                tries[technique] = (tried + 1, worked + int(bool(success) and found > 0))
        for technique, (tried, worked) in tries.items():
            before = self.techniques.getValue((technique,)) if self.techniques.containsKey((technique,)) else (0, 0)
            self.techniques.updateValue((technique,), (before[0] + tried, before[1] + worked))
        waiting = sorted(((pd.Timestamp(a).to_pydatetime(), int(i), int(f), bool(s), t) for a, i, f, s, t in [*waiting, *fresh]), key=lambda r: r[:2])
        held = self.recipe.get() if self.recipe.exists() else None
        recipe = dict(zip([c.split()[0] for c in _STATE.split(", ")], held)) if held else {**START, "yields": []}
        recipe["yields"] = [int(y) for y in recipe["yields"]]
        settled = [r for r in waiting if pd.Timestamp(r[0]) <= mark]
        gone = [tuple(r) for r in self.replaced.get()] if self.replaced.exists() else []
        for row in settled:
            if recipe["version"]:
                gone.append((row[0], recipe["version"]))
            recipe = learned(recipe, row[2], row[3])
        if settled:
            self.recipe.update(tuple(recipe[c.split()[0]] for c in _STATE.split(", ")))
            self.replaced.put(gone[-YIELDS:])
        open_ = waiting[len(settled) :]
        if open_:
            self.waiting.put(open_)
        elif self.waiting.exists():
            self.waiting.clear()
        for row in open_:
            recipe = learned(recipe, row[2], row[3])
        counts = sorted((k[0], *v) for k, v in self.techniques.iterator())
        yield pd.DataFrame([{
            "source_id": key[0], **{c: recipe[c] for c in ("attempts", "successes", "last_yield", "median_yield", "reliability", "confidence", "empty")}, "rediscover": recipe["empty"] >= EMPTIES,
            "version": recipe["version"], "replaced": max(0, recipe["version"] - 1), "techniques": ",".join(f"{t}:{b}/{a}" for t, a, b in counts),
        }])

    def close(self) -> None:
        pass


def outcome_learning(outcomes: DataFrame, late: str = "1000 days") -> DataFrame:
    """After each batch, the recipe of every source with a new outcome: `outcomes` is a stream of source_id, at, outcome_id, found, success, technique.

    Outcomes count in order of time, then id, whatever batch brings them, as long as they are no more than `late` behind the newest;
    those behind that are left to the watermark. An outcome without a technique counts for none. Needs the RocksDB state store.
    """
    keyed = outcomes.withWatermark("at", late).groupBy("source_id")
    return keyed.transformWithStateInPandas(_Learner(), RECIPE, outputMode="Update", timeMode="EventTime")
