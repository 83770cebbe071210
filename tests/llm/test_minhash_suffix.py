from __future__ import annotations

import hashlib
import re
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from common_cases import documents, frame, words
from tessella.llm import minhash, suffix_dedup
from tessella.llm.common import table
from tessella.llm.suffix_array import suffix_array


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break  # all further ones are longer still
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    by_id = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            by_id[doc].append(i)
    for members in by_id.values():  # rows of one id are one document
        for i in members[1:]:
            parent[root(i)] = root(members[0])
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def chain(rng):
    """Each text shares over four fifths with the next and little with those further on."""
    w = words(rng, 400)
    return [(200 + i, " ".join(w[6 * i : 6 * i + 100])) for i in range(40)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    base = words(rng, 120)
    hot = [(300 + i, " ".join(base[:60] + [f"edit{i}"] + base[61:])) for i in range(60)] + [(500 + i, " ".join(base)) for i in range(50)]
    short = [(600 + i, t) for i, t in enumerate(["a b c", "A B c", "a b", "a b c d", "a b c d e", "c b a"])]
    rows = documents() + chain(rng) + hot + short
    got = minhash.near_duplicates(frame(spark, rows), 4, 80).collect()
    want = brute_components(rows, 4, 80)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)
    for r in got:
        assert r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"])


def test_pairs_that_the_signatures_refuse_are_joined_exactly(spark, monkeypatch):
    """With a filter that lets nothing through, every link comes from the exact join of open buckets."""
    monkeypatch.setattr(minhash, "plausible", lambda pairs, signed, percent: pairs.limit(0))
    rng = random.Random(10)
    rows = documents() + chain(rng)
    got = minhash.near_duplicates(frame(spark, rows), 4, 80).collect()
    assert sorted(map(str, brute_components(rows, 4, 80))) == sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)


def test_all_links_of_a_real_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted(brute_components(rows, 4, 80))


def test_keep_one_keeps_columns(spark):
    rows = [*documents(), (3, documents()[3][1])]
    df = frame(spark, rows)
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    want = {c for d, n, c in brute_components(rows, 5, 80) if d is not None and d == c}
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(want)
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.keep_one(df.limit(0)).count() == 0


def test_densified_bins_estimate_similarity():
    rng = np.random.default_rng(0)
    for size in (20, 200, 2000):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            extra = rng.integers(0, 1 << 63, size // 4, dtype=np.uint64)
            a, b = minhash.signature(both), minhash.signature(np.concatenate([both, extra]))
            errors.append((np.frombuffer(a.tobytes(), "<u2") == np.frombuffer(b.tobytes(), "<u2")).mean() - 0.8)
        assert abs(np.mean(errors)) < 0.03


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(values):
    want = sorted(range(len(values)), key=lambda i: values[i:])
    assert suffix_array(np.array(values, np.int64)).tolist() == want


@pytest.mark.parametrize("word", [b"a" * 3000, b"ab" * 1500, b"abaab" * 600])
def test_suffix_array_of_repeats(word):
    assert suffix_array(np.frombuffer(word, np.uint8).astype(np.int64)).tolist() == sorted(range(len(word)), key=lambda i: word[i:])


def brute_removed(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def repeats():
    rng = random.Random(4)
    passage = " ".join(words(rng, 150))
    rows = []
    for i in range(60):  # overlapping parts of one passage: many contexts of each key
        a = rng.randrange(0, 300)
        rows.append((1000 + i, " ".join(words(rng, 20)) + passage[a : a + rng.randrange(350, 520)] + " ".join(words(rng, 20))))
    return rows


@pytest.mark.parametrize(("length", "limit"), [(400, 500), (400, 3), (100, 500), (100, 2)])
def test_removed_bytes_equal_brute_force(spark, length, limit):
    rows = [r for r in documents() + repeats() if r[0] != 81] + [(81, "ab" * 600), (82, "x" * length), (83, "y" * (length + 1)), (84, "z" * (length - 1))]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length, limit)
    assert brute_removed(rows, length) == sorted(str(tuple(r)) for r in got.collect())


def test_kept_bytes_and_empty(spark):
    df = frame(spark, documents())
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in suffix_dedup.remove_repeats(df, with_text=True).collect())
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
