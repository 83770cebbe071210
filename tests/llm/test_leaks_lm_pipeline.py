from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from common_cases import by_row, documents, frame, words
from tessella.llm import decontaminate, lm_score, minhash, packing, quality, queries, secrets
from tessella.llm.common import table
from test_minhash_suffix import brute_components
from test_tokens_packing_store import library_ids

SF = "/root/testdata/sf0.001"


def items(rng):
    out = [(i, " ".join(words(rng, rng.randint(8, 30))).capitalize() + ". " + " ".join(words(rng, rng.randint(1, 12))) + ".") for i in range(60)]
    return out + [(60, None), (61, ""), (62, "yes. no"), (None, " ".join(words(rng, 14))), (3, out[3][1])]


def brute_leaks(docs, bench, percent=80):
    found = []
    for doc, text in docs:
        w = decontaminate.words_of(text)
        have = {b" ".join(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1)}
        for item, t in bench:
            q, a = (decontaminate.shingles(x) for x in decontaminate.question_and_answer(t))
            if not decontaminate.words_of(t):
                continue
            hits = [len(x & have) for x in (q, a)]
            if hits[0] * 100 >= percent * len(q) and hits[1] * 100 >= percent * len(a):
                found.append((doc, item, len(q), hits[0], len(a), hits[1]))
    return sorted(map(str, found))


def leaking(rng, bench):
    rows = documents()
    for k, (_, t) in enumerate(bench[:40]):
        w = (t or "").split()
        if k % 3 == 1:
            w = [x.upper() for x in w]
        if k % 3 == 2 and len(w) > 30:
            w[len(w) // 3] = "otherword"
        rows.append((2000 + k, " ".join(words(rng, rng.randint(0, 300)) + w + words(rng, rng.randint(0, 300)))))
    return [*rows, (None, bench[5][1]), (2002, bench[6][1])]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    bench = items(rng)
    rows = leaking(rng, bench)
    b = spark.createDataFrame([(*r, "x", 1) for r in bench], "item_id bigint, text string, doc_id string, score int")
    docs = frame(spark, rows)
    names = ("doc_id", "item_id", "n_question", "question_hits", "n_answer", "answer_hits")
    want = brute_leaks(rows, bench)
    assert len(want) >= 30
    for max_words in (2_000_000, 200):  # one block of the index, and several
        got = decontaminate.find_leaks(docs, b, max_words=max_words)
        assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == want
    kept = decontaminate.drop_leaks(docs, b)
    assert kept.columns == docs.columns
    bad = {text for doc, text in rows if brute_leaks([(doc, text)], bench)}
    assert by_row(kept, "doc_id", "text") == sorted([r for r in rows if r[1] not in bad], key=str)
    assert decontaminate.find_leaks(docs, b.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), b).count() == 0
    assert decontaminate.drop_leaks(docs, b.limit(0)).count() == len(rows)


def test_passages_retrieve_what_lies_together(spark):
    """WAND finds every copy and every item with a lost word; only what lies apart is left to the shingles of the whole document."""
    rng = random.Random(2)
    bench = items(rng)
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontaminate.find_leaks(frame(spark, leaking(rng, bench)), b, whole=True).collect()
    assert len(got) >= 30 and all(r["retrieved"] and r["score"] > 0 for r in got)
    item = max((t for _, t in bench if t), key=len).split()
    third = len(item) // 3
    apart = " ".join(item[: third + 2]) + " " + " ".join(words(rng, 900)) + " " + " ".join(item[third - 2 : 2 * third + 2]) + " " + " ".join(words(rng, 900)) + " " + " ".join(item[2 * third - 2 :])
    found = decontaminate.find_leaks(frame(spark, [(1, apart)]), b, whole=True).collect()
    assert [r["retrieved"] for r in found] in ([False], [True]) and found


def test_block_max_wand_retrieves_all():
    rng = random.Random(8)
    bench = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(rng.randint(3, 40)))) for i in range(200)]
    index = decontaminate.build_index(bench, 0.7)
    for _ in range(100):
        query = sorted(rng.sample(range(len(index.postings)), 6))
        scores = np.zeros(len(index.items))
        for t in query:
            at, impact, *_ = index.postings[t]
            scores[at] += impact
        want = {int(i) for i in np.flatnonzero(scores >= index.threshold - 1e-9)}
        assert {i for i, _ in decontaminate.block_max_wand(index, query)} == want


def test_losses_equal_plain_counts(spark):
    rows = documents()
    labels = [(i, i % 2, 0) for i in range(40)] + [(4, 1, 1), (None, 1, 0), (5, None, None)]
    good = {d for d, q, _ in labels if q == 1} - {4, None}
    split = lambda t: [w.decode("utf-8", "surrogatepass") for w in (t or "").encode("utf-8", "surrogatepass").lower().split()]

    def counts(texts):
        c = Counter()
        for t in texts:
            w = split(t)
            c.update(w)
            c.update(zip(["<start>", *w], w))
            if w:
                c["<start>"] += 1
        return c, sum(len(split(t)) for t in texts)

    every = counts([t for _, t in rows])[1]
    n_good = counts([t for d, t in rows if d in good])[1]
    want = []
    for i, (doc, text) in enumerate(rows):
        w, means = split(text), []
        for member in (True, False):  # the target, the background
            c, n = counts([t for k, (d, t) in enumerate(rows) if (d in good) is member and k != i])
            whole = n_good if member else every - n_good
            s = min(1.0, (every - whole) / whole)
            total = 0.0
            for v, x in zip(["<start>", *w], w):
                one = (s * c[x] + 2.0 / every) / (s * n + 2.0)
                total -= np.log((s * c[v, x] + 2.0 * one) / (s * c[v] + 2.0))
            means.append(total / len(w) if w else None)
        want.append((doc, len(w), *means))
    close = lambda x, y: x is None and y is None or abs(x - y) < 1e-9
    order = lambda d, n, b: (d is None, d or 0, n, round(b or 0, 6))
    want.sort(key=lambda r: order(r[0], r[1], r[3]))
    label_rows = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for size in (1 << 24, 1 << 14):  # one block, and several with several ranges
        got = lm_score.cross_entropy_difference(frame(spark, rows), label_rows, block_bytes=size).collect()
        got.sort(key=lambda r: order(r["doc_id"], r["n_tokens"], r["background_loss"]))
        for r, w in zip(got, want, strict=True):
            assert (r["doc_id"], r["n_tokens"]) == w[:2] and close(r["target_loss"], w[2]) and close(r["background_loss"], w[3])
            assert r["score"] is None or abs(r["score"] - (r["target_loss"] - r["background_loss"])) < 1e-9
    empty = frame(spark, rows).limit(0)
    assert lm_score.cross_entropy_difference(empty, label_rows).count() == 0
    none = lm_score.cross_entropy_difference(frame(spark, rows), label_rows.limit(0)).collect()
    assert len(none) == len(rows) and all(r["score"] is None or np.isfinite(r["score"]) for r in none)
    many = spark.range(120_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert lm_score.good_ids(many.union(many)).count() == 120_000  # every one, however many


def test_packing_of_names_and_counts():
    rng = np.random.default_rng(4)
    for n in (1, 2, 1000):
        names = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (lm_score.unpacked_names(lm_score.packed_names(names)) == names).all()
        counts = rng.choice([0, 1, 2, 254, 255, 256, 1 << 40], n)
        assert (lm_score.widen(lm_score.narrow(counts), n) == counts).all()


def test_score_tells_the_target_from_the_rest(spark):
    rng = random.Random(1)
    one, other = words(rng, 150), ["".join(rng.choice("XYZ!?#") for _ in range(6)) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(one, k=80))) for i in range(60)] + [(100 + i, " ".join(rng.choices(other, k=80))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    s = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(frame(spark, rows), labels).collect()}
    assert max(s[i] for i in range(30, 60)) < min(s[i] for i in range(130, 160))


def brute_pipeline(spark, rows, sf):
    """The five stages over lists, with the models as the operators train them."""
    labels, bench = table(spark, sf, "labels"), [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    model = quality.train(frame(spark, rows) if isinstance(rows, list) else rows, labels)
    rows = rows if isinstance(rows, list) else [tuple(r) for r in rows.select("doc_id", "text").collect()]
    kept = []
    for doc, text in rows:
        s = quality.text_stats(text)
        if s[0] >= 50 and 2 * s[4] <= s[0] and (model is None or model.score(np.array([quality.features(text, s)]))[0] >= model.cutoff):
            kept.append((doc, text))
    yield kept
    kept = [r for r, (d, _, c) in zip(kept, brute_components(kept, 5, 80)) if d is None or d == c]
    yield kept
    kept = [r for r in kept if not brute_leaks([r], bench)]
    yield kept
    net = secrets.train(spark.createDataFrame(kept, "doc_id bigint, text string"))
    out = []
    for (doc, text), spans in zip(kept, secrets.find_spans([t for _, t in kept], net)):
        gone = sorted({i for s, e, _ in spans for i in range(s, e)})
        parts = re.sub("\0+", "[secret]", "".join("\0" if i in set(gone) else c for i, c in enumerate(text))) if gone else text
        out.append((doc, parts))
    yield out


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    now = docs
    want = list(brute_pipeline(spark, docs, SF))
    for (name, step), expected in zip(corpus_pipeline.STAGES, want):
        out = step(spark, now, SF)
        assert out.columns == docs.columns, name
        assert by_row(out, "doc_id", "text") == sorted(expected, key=str), name
        now = spark.createDataFrame(out.toPandas(), docs.schema)
    packed = corpus_pipeline.run(spark, SF).collect()
    tokens = [(doc, library_ids("byte_bpe_50k.json", text, 2)) for doc, text in want[-1]]
    pieces = Counter((doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for doc, ids in tokens for i, (s, n) in enumerate(packing.cut(len(ids), 1024)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces


def test_pipeline_stages_on_awkward_documents(spark):
    df = frame(spark, documents())
    for start in (df, df.limit(0)):
        now = start
        for _, step in corpus_pipeline.STAGES[:-1]:
            now = step(spark, now, SF)
            assert now.columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, now, SF).count()


def test_registered_queries(spark):
    assert sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0])) == list(queries.QUERIES)
    for name, query in queries.QUERIES.items():
        rows = query(spark, SF).collect()
        whole = table(spark, SF, "pages" if name.startswith(("op3_", "op4_")) else "documents").count()
        if name.startswith("op10_"):
            assert rows
        elif name.startswith("op12_"):
            parts = table(spark, SF, "documents").select("lang").distinct().count()
            assert len(rows) == 600 * parts
        elif name.startswith("op6_"):
            assert len({r["doc_id"] for r in rows}) == whole
        else:
            assert len(rows) == whole, name
