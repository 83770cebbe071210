from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from common_cases import documents, frame
from tessella.llm import chunk_store, packing
from tessella.llm.common import shared_dir
from tessella.llm.tokens import Encoder, encoder

ODD = [(100, "it's I'LL don''t  x y z\x85w\x1c 12½³ ǅ İ ſ ﻿"), (101, "\r\n\t a\n\n\nb   "), (102, "[CLS] </s> <s> <pad> [UNK]"), (103, "東京 🎉 नमस्ते é"), (104, "ªº¼ ÷× ÀÉ ɏ ĲŁ _-_"),
       (105, "a <|endoftext|> b <|startoftext|>"), (106, "<|ENDOFTEXT|><|endoftext|>x")]
FILES = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")]


def library_ids(name, text, end):
    if name not in library_ids.cache:
        library_ids.cache[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return np.asarray([*library_ids.cache[name].encode(text or "", add_special_tokens=False).ids, end], "<u4")


library_ids.cache = {}


@pytest.mark.parametrize(("name", "kind"), FILES)
def test_encoder_equals_the_library(name, kind, sf):
    import pyarrow.parquet as pq

    texts = [t for _, t in documents() + ODD] + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    assert encoder(name, kind).encode(texts, 1) == [library_ids(name, t, 1).tobytes() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.text("ab' \tS1é.½\n\x0b ", max_size=30), max_size=5))
def test_encoder_on_any_text(texts):
    for name, kind in FILES:
        assert encoder(name, kind).encode(texts) == [library_ids(name, t, 0)[:-1].tobytes() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50)))
def test_plan_is_best_fit_decreasing(counts):
    rows, capacity = packing.plan_slots(counts, 64), 64
    used, placed = defaultdict(list), Counter()
    for length, first, bins, per, seq, offset in rows:
        assert first == placed[length]
        placed[length] += bins * per
        for r in range(bins * per):
            used[seq + r // per].append((offset + r % per * length, length))
    assert placed == Counter(counts)
    for spots in used.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    free: list[int] = []  # the same, one piece at a time
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [f for f in free if f >= length]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - length)
            else:
                free.append(capacity - length)
    assert len(used) == len(free)


def test_packing_covers_every_token_once(spark):
    rows = documents() + ODD[:2]
    out = packing.pack_documents(frame(spark, rows), with_ids=True)
    got = out.collect()
    tokens = [(doc, library_ids("byte_bpe_50k.json", text, 2)) for doc, text in rows]
    want = Counter((doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for doc, ids in tokens for i, (s, n) in enumerate(packing.cut(len(ids), 1024)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in by_seq.values():
        ends = [0, *(o + n for o, n in sorted(spots))]
        assert [o for o, _ in sorted(spots)] == ends[:-1] and ends[-1] <= 1024
    assert len(by_seq) <= -(-sum(len(ids) for _, ids in tokens) // 1024) + 2
    whole = packing.sequences(out).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(len(ids) for _, ids in tokens)


def test_only_long_documents_are_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(1025, 1024) == [(0, 1), (1, 1024)]
    assert packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_store_round_trip(spark):
    rows = documents() + ODD[:2]
    df, path = frame(spark, rows), f"{shared_dir(spark)}/store"
    chunk_store.write_store(df, path, "word_bpe_49k.json", "word", 1)
    want = sorted(((doc is not None, doc or 0), library_ids("word_bpe_49k.json", text, 1).tobytes()) for doc, text in rows)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), bytes(r["ids"])) for r in chunk_store.reconstruct(spark, path).collect()) == want
    index = sorted(chunk_store.read_index(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in index] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in index:
        assert r["start"] == at
        at += r["n_tokens"]
    crcs = Counter((doc, len(i := library_ids("word_bpe_49k.json", text, 1)), zlib.crc32(i.tobytes())) for doc, text in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in index) == crcs
    names = [bytes(r["name"]) for r in spark.read.parquet(f"{path}/objects").where("kind = 'chunk'").select("name").collect()]
    assert len(names) == len(set(names))  # each chunk is stored once


def test_damage_is_found(spark):
    df, path = frame(spark, documents()), f"{shared_dir(spark)}/store"
    chunk_store.write_store(df, path, "word_bpe_49k.json", "word", 1)
    objects = spark.read.parquet(f"{path}/objects")
    from pyspark.sql import functions as F

    objects.withColumn("payload", F.when(F.col("kind") == "chunk", F.concat("payload", F.lit(b"\0\0"))).otherwise(F.col("payload"))).write.partitionBy("kind").parquet(f"{path}/../bad/objects")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{path}/../bad/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}/../bad/manifest")
    with pytest.raises(Exception, match="damaged"):
        chunk_store.read_index(spark, f"{path}/../bad").collect()


def test_lost_chunks_and_recipes_are_found(spark):
    df, path = frame(spark, documents()), f"{shared_dir(spark)}/store"
    chunk_store.write_store(df, path, "word_bpe_49k.json", "word", 1)
    copy = lambda what, to, keep: spark.read.parquet(f"{path}/{what}").where(keep).write.parquet(f"{path}/../{to}/{what}")
    spark.read.parquet(f"{path}/objects").where("kind = 'recipe' or n <> 1").write.partitionBy("kind").parquet(f"{path}/../lost/objects")
    for what in ("recipes", "manifest"):
        copy(what, "lost", "true")
    for read in (chunk_store.read_index, chunk_store.reconstruct):
        with pytest.raises(Exception, match="a chunk is missing"):
            read(spark, f"{path}/../lost").collect()
    spark.read.parquet(f"{path}/objects").write.partitionBy("kind").parquet(f"{path}/../short/objects")
    copy("recipes", "short", "doc_id is null or doc_id <> 7")
    copy("manifest", "short", "true")
    for read in (chunk_store.read_index, chunk_store.reconstruct):
        with pytest.raises(ValueError, match="don't match the manifest"):
            read(spark, f"{path}/../short")


def test_ids_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="does not fit in 1 bytes"):
        chunk_store.write_store(frame(spark, documents()), f"{shared_dir(spark)}/store", "word_bpe_49k.json", "word", 1, id_bytes=1)


def test_cuts_do_not_depend_on_neighbours():
    rng = np.random.default_rng(5)
    streams = [rng.integers(0, 40000, n).astype("<u4") for n in (0, 1, 256, 257, 9000, 300, 5000)]
    together = chunk_store.cut_points(streams)
    assert together == [chunk_store.cut_points([s])[0] for s in streams]
    assert [e[-1] if e else 0 for e in together] == [len(s) for s in streams]


def test_edits_move_few_chunks():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 40000, 50000)
    edited = np.concatenate([ids[:20000], [7, 8, 9], ids[20000:]])

    def chunks(x):
        (ends,) = chunk_store.cut_points([x])
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    assert len(chunks(edited) - chunks(ids)) <= 3


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_joined_checksums(a, b):
    assert chunk_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_empty_tables(spark):
    df = frame(spark, documents()).limit(0)
    assert packing.pack_documents(df).count() == 0
    assert chunk_store.store_documents(df).count() == 0


@pytest.mark.parametrize("file, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_pieces_are_encoded_by_the_model_alone(file, kind):
    rng, whole = random.Random(4), Tokenizer.from_file(public_tokenizers.path(file))
    chars = [chr(c) for c in (9, 10, 13, *range(32, 127))]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for i in range(3000)]
    texts = [t for t in texts if "<" not in t and "[" not in t] + ["don't stop  at\n\n  \x7f x"]
    enc = Encoder(public_tokenizers.path(file), kind)

    class NoPipeline:
        def encode(self, text, **kw):
            assert isinstance(text, str) or not text, "pieces went through the whole pipeline"
            return whole.encode(text, **kw)

    enc.tokenizer = NoPipeline()
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_whose_lower_case_lies_elsewhere_have_the_librarys_ids():
    whole = Tokenizer.from_file(public_tokenizers.path(FILES[1][0]))
    texts = [a + chr(c) + "b/" + chr(c) for c in range(0xA1, 0x250) for a in ("", "x", "¼7")]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(*FILES[1]).encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("file", "kind"), FILES)
def test_a_word_is_cut_once_and_its_pieces_go_to_the_model_alone(file, kind):
    rng, whole = random.Random(5), Tokenizer.from_file(public_tokenizers.path(file))
    words = ["".join(rng.choice("abÉñœß'1½.*÷") for _ in range(rng.randrange(1, 9))) for _ in range(200)] + ["don't", "'save", '"\'s', "it's", "\xa1\xad\xb5"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(100)]
    for most in (7, 10_000):  # with few entries all are forgotten again and again
        enc, seen = Encoder(public_tokenizers.path(file), kind, most), Counter()
        enc.tokenizer = None  # what the model alone can't do fails
        if kind == "word":
            cut = enc.cache.cut

            def counted(word, cut=cut, seen=seen):
                seen[word] += 1
                return cut(word)

            enc.cache.cut = enc.cut = counted
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.cache) <= max(20, most * 2)
        assert most == 7 or set(seen.values()) <= {1}
    long = ["x1" * 5000, "a" * 5000, "x1" * 5000 + " b"]
    enc = Encoder(public_tokenizers.path(file), kind)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(long)] == [whole.encode(t, add_special_tokens=False).ids for t in long]
    assert max(map(len, enc.cache)) <= 64
