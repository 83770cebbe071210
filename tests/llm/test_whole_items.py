from __future__ import annotations

import random

import pytest

from common_cases import frame, words
from tessella.llm import decontaminate


def cases():
    rng = random.Random(6)
    bench = [(i, " ".join(words(rng, rng.randint(9, 30))) + ". " + " ".join(words(rng, 1 + i % 3)) + ".") for i in range(30)]
    rows = []
    for i, text in bench:
        w = text.split()
        more = lambda n: words(rng, n)
        cut = len(w) // 2
        rows.append((i, " ".join(more(50) + w[:-1] + [w[-1] + "%%%"] + more(50))))  # a symbol glued to the last word
        rows.append((100 + i, " ".join(more(50) + w[:-1] + ["otherword"] + more(50))))  # the answer's last word lost
        rows.append((200 + i, " ".join(w[: cut + 2] + more(2000) + w[cut - 2 :])))  # its halves far apart
        rows.append((300 + i, " ".join(more(20) + w[:cut] + more(20))))  # half of it
    return bench, rows


def plain_leaks(bench, rows):
    """Every pair whose item is held to 80 percent, as a whole or in both parts; a part of under five words is a run of words."""
    plain = lambda t: [w.strip(decontaminate.EDGES) or w for w in t.encode().lower().split()]
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    out = set()
    for doc, text in rows:
        w = plain(text)
        have = {tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1)}
        for item, t in bench:
            q, a = (cut([x.strip(decontaminate.EDGES) or x for x in side]) for side in decontaminate.question_and_answer(t))
            held = [100 * len(x & have) >= 80 * len(x) for x in (q, a, cut(plain(t)))]
            if held[0] and held[1] or held[2]:
                out.add((doc, item))
    return out


@pytest.mark.parametrize("max_words", (2_000_000, 200))
def test_whole_items_are_leaks(spark, max_words):
    bench, rows = cases()
    want = plain_leaks(bench, rows)
    assert {(i, i) for i in range(30)} <= want and {d // 100 for d, _ in want} == {0, 1, 2}
    docs, b = frame(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontaminate.find_leaks(docs, b, max_words=max_words, whole=True).select("doc_id", "item_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    kept = decontaminate.drop_leaks(docs, b, max_words=max_words, whole=True)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_parts_far_apart_are_retrieved(spark):
    """Verification is over the document, so retrieval must be too, whatever the rule."""
    rng = random.Random(3)
    q, a = words(rng, 12), words(rng, 12)
    doc = " ".join(q) + ". " + " ".join(words(rng, 3000)) + " " + " ".join(a) + "."
    bench = spark.createDataFrame([(1, " ".join(q) + ". " + " ".join(a) + ".")], "item_id bigint, text string")
    assert decontaminate.find_leaks(frame(spark, [(7, doc)]), bench).count() == 1
