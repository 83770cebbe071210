from __future__ import annotations

import random

from tessella.llm import minhash
from test_minhash_suffix import brute_components


def family():
    """Many documents that share a passage and aren't linked, and a few that are linked to each other and to none of the many."""
    rng = random.Random(4)
    fresh = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)]
    passage = fresh(1003)  # 1,000 shingles of four words
    many = [(i, " ".join(passage + fresh(167))) for i in range(300)]
    return many + [(1000 + i, " ".join(passage + fresh(111))) for i in range(3)]


def test_links_in_buckets_that_stay_open(spark):
    rows = family()
    want = {(d, c) for d, _, c in brute_components(rows, 4, 80)}
    assert {(1001, 1000), (1002, 1000), (5, 5)} <= want
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == want


def crowd():
    """300 linked pairs in one crowd whose members are just below the threshold to all others."""
    rng = random.Random(6)
    fresh = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)]
    base, rows = fresh(500), []
    for i in range(300):
        both = fresh(8)
        rows += [(2 * i + j, " ".join(base + both + fresh(60))) for j in range(2)]
    return rows


def test_links_within_a_crowd(spark):
    rows = crowd()
    want = {(d, c) for d, _, c in brute_components(rows, 4, 80)}
    assert want == {(d, d - d % 2) for d, _ in rows}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == want


def test_prefix_pairs_hold_every_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 3)  # salted keys too
    rng = random.Random(9)
    base = [[rng.choice("abcdefghij") * 3 + str(rng.randrange(60)) for _ in range(rng.choice((6, 20, 60)))] for _ in range(8)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            w[rng.randrange(len(w))] = "other" + str(rng.randrange(5))
        rows.append((i, " ".join(w[rng.randint(0, 2) :])))
    sets = {i: set(minhash.shingle_set([t], 4)[0].tolist()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for component in ("doc_id", "doc_id % 4", "if(doc_id < 60, 0, doc_id)"):
        members = docs.selectExpr("doc_id", f"{component} as component")
        label = dict(map(tuple, members.collect()))
        apart = {(a, b) for a, b in want if label[a] != label[b]}
        pairs = minhash.prefix_pairs(members, docs, 4, 80)
        found = {tuple(r) for r in pairs.collect()}
        assert len(apart) > 10 and apart <= found and all(label[a] != label[b] for a, b in found)
        assert {tuple(r) for r in minhash.similar_pairs(pairs, docs, 4, 80).collect()} == apart
