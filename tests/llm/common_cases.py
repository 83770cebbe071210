"""Documents with every awkward case, in plain Python, for brute-force comparison."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Columns beside doc_id and text whose names clash with those that the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, n bigint, h1 string, did int, component string, kept string, piece string, score string, rid string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def documents(seed: int = 5) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = []
    for i in range(40):
        rows.append((i, " ".join(words(rng, rng.randint(55, 160))) + "."))
    for i in range(40, 60):  # near copies of the first
        w = rows[i % 7][1].split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    passage = " ".join(words(rng, 90))
    for i in range(60, 70):  # a shared passage
        rows.append((i, " ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30))))
    rows += [(70, None), (71, ""), (72, " \t\n "), (73, "one"), (74, "two words"), (75, rows[3][1]), (75, rows[3][1]), (76, rows[0][1].upper())]
    rows += [(None, rows[5][1]), (None, None), (None, "a text without an id " + " ".join(words(rng, 60)))]
    rows += [(80, " ".join(words(rng, 6000))), (81, "ab" * 30000), (82, "é ß漢字 😀 " * 40), (83, "line one here\n" * 30 + "end"), (84, "# * $ % & | < >\n" * 9)]
    return rows


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    more = ("xx", "hot", 1, 7, 8, "h", 9, "c", "k", "p", "s", "r")
    return spark.createDataFrame([(*r, *more) for r in rows], SCHEMA).repartition(3)


def by_row(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
