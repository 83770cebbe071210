"""Entities folded into one another by a log that can be replayed, refused and undone."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stored
from .chains import components

STATE = "id string, aliases array<string>, sources array<string>, superseded_by string, rationale string, confidence double"
OUTCOMES = "seq bigint, outcome string"
_EITHER = f"{STATE}, {OUTCOMES}"


class _Each:
    """Values in order of first appearance, as a shared beginning and what a fold added to it.

    A version costs what was added, not what it holds. Once it has doubled it is written out without
    repetitions, so no chain of folds, undoings and folds again holds more than twice its distinct values.
    """

    __slots__ = ("before", "added", "raw", "base")

    def __init__(self, before: _Each | None, added: tuple):
        self.before, self.added = before, added
        self.raw = (before.raw if before else 0) + sum(x.raw if isinstance(x, _Each) else 1 for x in added)
        self.base = before.base if before else self.raw
        if before and self.raw > 2 * self.base + 64:
            self.added, self.before = tuple(self.values()), None
            self.raw = self.base = len(self.added)

    def values(self) -> list:
        found: dict = {}
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, _Each):
                todo.extend(reversed(x.added))
                if x.before:
                    todo.append(x.before)
            else:
                found[x] = None
        return list(found)


def replay(entities: dict[str, dict], log: Iterable[dict]) -> list[tuple[int, str]]:
    """Apply the rows of `log` (seq, op, canonical, others, rationale, confidence) in order of seq to `entities` by id, in place; what became of each row.

    A fold gives the canonical all names, aliases and sources of the others, each once, and marks these superseded. It is
    refused whole if the canonical or one of the others is unknown, if there are no others or no rationale,
    if an entity would be folded into itself, or if one of the others is superseded. An undo takes the
    canonical's last standing fold back: it and the others are what they were before it.
    """
    return _replay(entities, sorted(log, key=lambda r: r["seq"]))


def _replay(entities: dict[str, dict], log: Iterable[dict]) -> list[tuple[int, str]]:
    """`replay` of rows that come in order. What a fold has to give back is shared with what stands: memory grows with entities and rows, however many are folded into one."""
    #: of entities that some fold has touched: aliases, sources, superseded_by, rationale, confidence
    now: dict[str, tuple] = {}
    standing: dict[str, list[tuple]] = {}
    told: list[tuple[int, str]] = []

    def state(i: str) -> tuple:
        if i not in now:
            e = entities[i]
            now[i] = (_Each(None, tuple(e["aliases"])), _Each(None, tuple(e["sources"])), e["superseded_by"], e["rationale"], e["confidence"])
        return now[i]

    gone = lambda i: (now[i][2] if i in now else entities[i]["superseded_by"]) if i in entities else None
    for row in log:
        head, others = row["canonical"], row["others"] or []
        if row["op"] == "undo":
            if not standing.get(head):
                told.append((row["seq"], "refused: nothing to undo"))
                continue
            now.update(standing[head].pop())
            told.append((row["seq"], "undone"))
            continue
        refusals = [
            (head not in entities, "unknown canonical"), (not others, "nobody to fold"), (not row["rationale"], "no rationale"), (head in others, "into itself"),
            (any(o not in entities for o in others), "unknown form"), (any(gone(o) for o in others), "superseded form"),
        ]
        reason = next((text for test, text in refusals if test), None)
        if reason:
            told.append((row["seq"], f"refused: {reason}"))
            continue
        forms = tuple(dict.fromkeys(others))
        standing.setdefault(head, []).append(tuple((i, state(i)) for i in (head, *forms)))
        aliases, sources = state(head)[:2]
        aliases = _Each(aliases, tuple(x for o in forms for x in (entities[o]["name"], state(o)[0])))
        sources = _Each(sources, tuple(state(o)[1] for o in forms))
        for o in forms:
            now[o] = (*now[o][:2], head, *now[o][3:])
        now[head] = (aliases, sources, now[head][2], row["rationale"], row["confidence"])
        told.append((row["seq"], "folded"))
    for i, (aliases, sources, superseded, rationale, confidence) in now.items():
        whole = lambda x, c: x.values() if x.before or x.base != len(entities[i][c]) else entities[i][c]
        entities[i] = entities[i] | {"aliases": whole(aliases, "aliases"), "sources": whole(sources, "sources"), "superseded_by": superseded, "rationale": rationale, "confidence": confidence}
    return told


def fold_log(entities: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state of every entity (id, name, aliases, sources) after the log, and what became of each of its rows (seq unique).

    Entities that some row of the log names together are replayed together, in one task, with memory in proportion to
    these entities and rows. All others are as they were.
    """
    rows = log.select(F.col("seq").cast("bigint").alias("seq"), "op", "canonical", "others", "rationale", F.col("confidence").cast("double").alias("confidence"))
    named = rows.select(F.col("canonical").alias("src"), F.explode_outer("others").alias("dst"))
    ids = named.select(F.col("src").alias("id")).unionByName(named.select(F.col("dst").alias("id"))).where("id is not null").distinct()
    group = stored(components(named, ids))
    held = entities.select("id", "name", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("aliases", "sources")))
    moved = held.join(group, "id")
    logged = rows.join(group.select(F.col("id").alias("canonical"), F.col("component").alias("part")), "canonical")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        each = lambda table: (r for batch in table.to_batches(max_chunksize=1024) for r in batch.to_pylist())
        state = {r["id"]: {c: r[c] for c in ("name", "aliases", "sources")} | {"superseded_by": None, "rationale": None, "confidence": None} for r in each(left)}
        told = _replay(state, each(right.sort_by("seq")))
        n, m = len(state), len(told)
        kinds = [("aliases", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("superseded_by", pa.string()), ("rationale", pa.string()), ("confidence", pa.float64())]
        both = lambda rows, t: pa.chunked_array([pa.array(rows, t), pa.nulls(m, t)])
        out = {"id": both(list(state), pa.string())} | {c: both([r[c] for r in state.values()], t) for c, t in kinds}
        out |= {c: pa.chunked_array([pa.nulls(n, t), pa.array([r[k] for r in told], t)]) for k, (c, t) in enumerate((("seq", pa.int64()), ("outcome", pa.string())))}
        return pa.table(out)

    done = moved.groupBy("component").cogroup(logged.groupBy("part")).applyInArrow(run, _EITHER)
    rest = held.join(group, "id", "left_anti").select("id", "aliases", "sources", *(F.lit(None).cast(t).alias(c) for c, t in (("superseded_by", "string"), ("rationale", "string"), ("confidence", "double"))))
    state = done.where("id is not null").select("id", "aliases", "sources", "superseded_by", "rationale", "confidence").unionByName(rest)
    nobody = rows.where("canonical is null").select("seq", F.lit("refused: unknown canonical").alias("outcome"))
    return state, done.where("seq is not null").select("seq", "outcome").unionByName(nobody)
