"""Periodic runs, the audit of filter orders and SentencePiece against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from common_cases import by_row, documents, frame

from tessella.llm.filter_audit import audit_filters, standard_filters
from tessella.llm.periodic_runs import find_runs, maximal_runs, runs_of_texts
from tessella.llm.pieces import CharacterMap, PieceEncoder, encode_pieces, message_fields, piece_encoder

MODEL = "piece_bpe_32k.model"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# periodic runs -----------------------------------------------------------------


def all_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of two periods or more, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            piece = words[i : j + q]
            if j - i >= q and not any(all(piece[x] == piece[x + p] for x in range(len(piece) - p)) for p in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [r for r in all_runs(words) if r[1] >= max(6, 4 * r[2])]
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (
        doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_of_random_words_equal_the_definition():
    rng = random.Random(2)
    for _ in range(400):
        texts = [[rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(1, 4))]
        for words, found in zip(texts, runs_of_texts(texts)):
            assert [tuple(r) for r in found.tolist()] == all_runs(words)


def test_runs_of_words_built_by_rule():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    ends = [10_000]
    for words in (fib[-1], [0] * 257, [0, 1] * 99, [0, 0, 1] * 40 + [0, 0, 2] * 40):
        assert [tuple(r) for r in maximal_runs(np.array(words + ends)).tolist()] == all_runs(words)
    assert maximal_runs(np.empty(0, np.int64)).shape == maximal_runs(np.arange(5)).shape == (0, 3)


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def awkward() -> list[tuple[int | None, str | None]]:
    rng = random.Random(8)
    rows = [r for r in documents() if len(r[1] or "") < 3000]
    rows += [(i, " ".join(rng.choice(["la", "da", "dum"]) for _ in range(rng.randint(0, 60)))) for i in range(200, 320)]
    rows += [(400, "no " * 500), (401, "a b c d " * 30 + "x\x0by\x0cz"), (402, "a b " * 7), (402, "a b " * 7), (None, "na " * 12), (403, "one two " * 4)]
    return rows


def test_run_query_equals_brute_force(spark):
    rows = awkward()
    got = by_row(find_runs(frame(spark, rows), planted=True), *RUN_COLUMNS)
    assert got == sorted((runs_row(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 20
    assert find_runs(frame(spark, [])).count() == 0


def test_runs_and_collapsed_text_are_given(spark):
    row = find_runs(frame(spark, [(1, "x a b a b a b a b y")]), with_text=True).collect()[0]
    assert (row.collapsed, [tuple(r) for r in row.runs]) == ("x a b y", [(1, 8, 2)])
    assert find_runs(frame(spark, [(1, "x a b a b a b y")]), with_text=True).collect()[0].runs == []


def test_a_long_text_is_taken_whole(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    words += ["tick", "tock"] * 40_000
    row = find_runs(frame(spark, [(5, " ".join(words)), (6, "short")])).where("doc_id = 5").collect()[0]
    assert (row.n_runs, row.start, row.length, row.period) == (1, 150_000, 80_000, 2)


# filter orders -----------------------------------------------------------------


def audit_rows(rows, labels):
    """Every order applied to the documents one by one."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least: dict[str, int] = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        bad = "".join(c for c, b in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i)) if b)
        docs.append((lang or "", bad, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        sums = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                failing = [d for d in mine if c in d[1]]
                sums[c] += len(gone)
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(d[1] == c for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), c)
        for key, v in out.items():
            if key[0] == part:
                out[key] = (*v[:6], sums[v[6]])
    return sorted(((*k, *v) for k, v in out.items()), key=str)


AUDIT_COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = [rng.choice(["tree", "Bird", "river", "STONE", "ash", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([5, 150, 199, 200, 201, 400]))]
        rows.append((i, " ".join(words) + rng.choice(["", "", " 5%", " a|b"]), rng.choice(["en", "de", None, "", "xx"])))
    rows += [(i, rows[i % 4][1], "en") for i in range(150, 190)] + [(7, rows[7][1], "en"), (7, rows[7][1], "en")]
    rows += [(200, None, "fr"), (201, "", "fr"), (202, " \t", None), (None, rows[3][1], "en"), (None, None, None), (203, "é" * 300 + " A", "fr")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, lang string, fails string, part int, state int").repartition(3)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = by_row(audit_filters(docs, table, standard_filters(), copies="E"), *AUDIT_COLUMNS)
    assert got == audit_rows(rows, labels)
    assert audit_filters(docs.limit(0), table, standard_filters(), copies="E").count() == 0
    two = audit_filters(docs, table.limit(0), dict(list(standard_filters().items())[:2]))
    assert {r.filter_order for r in two.collect()} == {"AB", "BA"} and two.where("good_lost + toxic_lost > 0").count() == 0


def test_each_unordered_state_is_counted_once(spark, monkeypatch):
    from tessella.llm import filter_audit

    seen = []
    monkeypatch.setattr(filter_audit._Audit, "count_edges", lambda self, state, survivors: seen.append(state))
    flags = spark.createDataFrame([("p", 3, False, False)], "part string, fails int, good boolean, toxic boolean")
    filter_audit._Audit(flags, "ABCDE")
    assert sorted(seen) == list(range(31))


# SentencePiece -----------------------------------------------------------------


def library(**more):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def test_ids_and_decoded_texts_are_the_librarys(spark):
    lib = library()
    rows = documents() + [(500, "<s> ▁▁ x</s>\0 \r\n\t <0x41> ﬁ"), (501, "  ｶﾞ 👩‍👩‍👧 \U0010ffff"), (502, "ab" * 100_000)]
    got = by_row(encode_pieces(frame(spark, rows)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, text in rows:
        ids = lib.encode(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((lib.decode(ids) if ids else "").encode())))
    assert got == sorted(want, key=str)
    assert encode_pieces(frame(spark, [])).count() == 0


def test_pieces_cover_the_source_bytes(spark):
    lib = library()
    rows = [(k, r[1]) for k, r in enumerate(documents()) if len(r[1] or "") < 3000]
    for row in encode_pieces(frame(spark, rows), with_pieces=True).collect():
        data, at = (dict(rows)[row.doc_id] or "").encode(), 0
        for p in row.pieces:
            assert p.start == at  # no map in this model: spans lie side by side
            at = p.end
            piece = lib.id_to_piece(p.id)
            if not lib.is_byte(p.id) and p.start:
                assert data[p.start : p.end].decode() == piece.replace("▁", " ")
        assert at == len(data)
        assert row.spans_sha256 == sha(b"".join(x.to_bytes(8, "little") for p in row.pieces for x in (p.start, p.end)))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("trims", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
def test_normalised_text_and_its_source(rule, trims, dummy):
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=trims, escape_whitespaces=True)
    spec = {2: b""} | dict(message_fields(dict(message_fields(lib.serialized_model_proto()))[3]))
    own = PieceEncoder.__new__(PieceEncoder)
    own.map, own.dummy_prefix, own.trims, own.space, own.suffix, own.fixed = CharacterMap(spec[2]), dummy, trims, "▁".encode(), False, re.compile(b"(?!)")
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab  \t　Ａﬁ①½é́​ßİ漢ｶﾞ😀▁ẛ̣­") for _ in range(rng.randint(0, 16)))
        norm, start, end = own.normalise(text)
        want, chars = lib.normalize(text, with_offsets=True)
        assert norm.decode() == want
        # the library counts characters, this one bytes; both name where the source of each character begins
        places = np.cumsum([0] + [len(c.encode()) for c in text])
        firsts = np.cumsum([0] + [len(c.encode()) for c in want])[:-1]
        assert [int(np.searchsorted(places, start[k], "right")) - 1 for k in firsts] == list(chars)[:-1]
        assert (start <= end).all()


def test_model_with_a_character_map_projects_pieces_to_source_bytes():
    """The public model with another normaliser put in front of its pieces."""
    import public_tokenizers
    import sentencepiece

    from tessella.llm.pieces import _field

    with open(public_tokenizers.path(MODEL), "rb") as f:
        fields = [x for x in message_fields(f.read()) if x[0] != 3]
    spec = dict(message_fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    model = b"".join(_field(n, v) for n, v in [*fields, (3, spec)])
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=model), PieceEncoder(model)
    for text in ("  ＨＥＬＬＯ   ﬁne ①  ", "ガ ｶﾞ ½ é", "plain words here", "​", "a­b"):
        ids, spans = own.encode(text)
        assert ids == lib.encode(text)
        data = text.encode()
        for i, (a, b) in zip(ids, spans.tolist()):
            piece = lib.id_to_piece(i).strip("▁")
            if piece and not lib.is_byte(i):
                assert own.normalise(data[a:b].decode())[0].decode().strip("▁").startswith(piece) or piece in own.normalise(data[a:b].decode())[0].decode()
    ids, spans = own.encode("ﬁne")
    assert spans[0].tolist()[0] == 0 and spans[-1].tolist()[1] == len("ﬁne".encode())


def test_a_file_path_names_a_model():
    import public_tokenizers

    assert piece_encoder(public_tokenizers.path(MODEL)).encode("a b")[0] == library().encode("a b")
