"""Secret scans: base patterns, and a character convolutional network over further candidates.

A candidate is what base spans leave of a run of key characters, whatever its
length. The network slides over it in windows and sees each with the characters
before and behind the candidate; the most likely window decides. It is trained in
numpy on labelled findings: secrets and harmless runs of usual shapes from a fixed
seed, and values that the base patterns find in a bounded sample of the corpus
against slugs of its words, all in surroundings taken from the corpus. It is
calibrated on held-out ones, and its threshold is the highest that keeps a stated
recall there.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter one never hides a longer
#: Further candidates: runs of key characters, of NAMED characters where their surroundings name a key, else of LEAST.
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
_NAMES_KEY = re.compile(r"(?i)key|secret|token|pass|pwd|auth|bearer|cred|hook")
LEAST, NAMED = 20, 12
_KEYWORDS = ("passw", "secret", "token", "api")
BEFORE, BODY, AFTER = 24, 48, 8
STRIDE = 24
_PART = re.compile(r"(?<=[/.=_-])[A-Za-z0-9+]{16,}")
_CLASSES = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=.-:\"' \n@"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind: code points, end exclusive, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of runs outside base spans that may be secrets: of digits and letters, or of both cases."""
    out = []
    for m in _RUN.finditer(text):
        at, parts = m.start(), []
        for s, e, _ in base:
            if s < m.end() and at < e:
                parts.append((at, s))
                at = max(at, e)
        for s, e in [*parts, (at, m.end())]:
            if e - s >= NAMED and (e - s >= LEAST or _NAMES_KEY.search(text, max(0, s - BEFORE), s)):
                run = text[s:e]
                letters = run.lower() != run.upper()
                if letters and (run.lower() != run != run.upper() or any(c.isdigit() for c in run)):
                    out.append((s, e))
    return out


def windows(text: str, start: int, end: int) -> list[int]:
    """Where the network's windows over a candidate begin: every STRIDE, the last that fits, and behind separators."""
    last = max(start, end - BODY)
    return sorted({*range(start, last, STRIDE), last, *(m.start() for m in _PART.finditer(text, start, end) if m.start() > start)})


_CODE = np.full(0x110000, len(_CLASSES) + 1, np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CODE[ord(_c)] = _i + 1
N_CODES = len(_CLASSES) + 2


def encode(text: str, start: int, end: int, at: int | None = None) -> np.ndarray:
    """Codes of a window of a candidate (from `at`) between the characters before and behind the candidate, at fixed places; 0 fills up."""
    at = start if at is None else at
    out = np.zeros(BEFORE + BODY + AFTER, np.uint8)
    before, body, after = text[max(0, start - BEFORE) : start], text[at : min(end, at + BODY)], text[end : end + AFTER]
    for place, part in ((BEFORE - len(before), before), (BEFORE, body), (BEFORE + BODY, after)):
        out[place : place + len(part)] = _CODE[[ord(c) for c in part]] if part else 0
    return out


@dataclass
class CharNet:
    """Embedding, one convolution, rectifier, maximum over places, logistic output, then a calibrated scale."""

    embed: np.ndarray
    filters: np.ndarray  # width * dim, count
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        width = len(self.filters) // self.embed.shape[1]
        e = self.embed[x]
        seen = np.concatenate([e[:, i : e.shape[1] - width + 1 + i] for i in range(width)], 2)
        conv = seen @ self.filters + self.bias
        at = conv.argmax(1)
        top = np.maximum(np.take_along_axis(conv, at[:, None], 1)[:, 0], 0)
        return top @ self.out + self.out_bias, top, at, seen

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.forward(x)[0] + b, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, recall: float = 0.95, filters: int = 24, width: int = 5, dim: int = 8, epochs: int = 12, seed: int = 7) -> CharNet:
    """Adam on three quarters; the rest calibrates (Platt) and sets the highest threshold that keeps `recall`."""
    rng = np.random.default_rng(seed)
    net = CharNet(rng.normal(0, 0.5, (N_CODES, dim)), rng.normal(0, 0.2, (width * dim, filters)), np.zeros(filters), rng.normal(0, 0.2, filters), 0.0)
    held = np.arange(len(y)) % 4 == 3
    tx, ty = x[~held], y[~held]
    state = {k: [0.0, 0.0] for k in ("embed", "filters", "bias", "out", "out_bias")}
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(ty)), max(1, len(ty) // 64)):
            logit, top, at, seen = net.forward(tx[rows])
            d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - ty[rows]) / len(rows)
            dtop = d[:, None] * net.out * (top > 0)
            chosen = np.take_along_axis(seen, at[:, :, None], 1)
            grads = {"out": top.T @ d, "out_bias": d.sum(), "bias": dtop.sum(0), "filters": np.einsum("nfw,nf->wf", chosen, dtop)}
            dwin = (dtop[:, :, None] * net.filters.T[None]).reshape(len(rows), -1, width, dim)
            places = tx[rows][np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(width)]
            grads["embed"] = np.zeros_like(net.embed)
            np.add.at(grads["embed"], places, dwin)
            step += 1
            for k, g in grads.items():
                m, v = state[k]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                state[k] = [m, v]
                setattr(net, k, getattr(net, k) - 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    logit, target = net.forward(x[held])[0], y[held]
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        a, b = a - 0.05 * float(((p - target) * logit).mean()), b - 0.05 * float((p - target).mean())
    net.scale = (max(a, 1e-3), b)
    good = np.sort(net.probability(x[held][target == 1]))
    net.threshold = float(good[int(np.floor((1 - recall) * len(good)))]) if len(good) else 1.0
    net.threshold = max(net.threshold, 0.5) if (net.probability(x[held][target == 1]) >= 0.5).mean() >= recall else net.threshold
    return net


Finding = tuple[str, int, int, int, int]


def _shapes(rng: random.Random) -> tuple[list, list]:
    """Makers of secrets and of harmless runs of usual shapes."""
    alnum, letters = string.ascii_letters + string.digits, string.ascii_lowercase
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: pick(letters, rng.randint(3, 9))
    secret = [
        lambda: pick(alnum, rng.randint(24, 64)), lambda: pick(alnum + "+/", rng.randint(28, 60)) + rng.choice(["", "=", "=="]),
        lambda: pick("0123456789ABCDEF", rng.choice([32, 40, 64])), lambda: rng.choice(["sk_live_", "sk-", "pk_", "key-"]) + pick(alnum, rng.randint(24, 40)),
        lambda: rng.choice(["ghp_", "gho_", "glpat-", "xoxb-"]) + pick(alnum, 36), lambda: "eyJ" + pick(alnum + "_-", 20) + ".eyJ" + pick(alnum + "_-", 30) + "." + pick(alnum + "_-", 30),
        lambda: pick(alnum + "_-", rng.randint(32, 44)), lambda: pick(alnum, rng.randint(14, 20)), lambda: pick(alnum, rng.randint(80, 160)),
        lambda: "AIza" + pick(alnum + "_-", 35), lambda: "-".join(pick("0123456789ABCDEF", k) for k in (8, 4, 4, 4, 12)),
    ]
    harmless = [
        lambda: "/".join(word() for _ in range(rng.randint(4, 14))) + f"/{rng.randint(1, 9999)}", lambda: "-".join(word() for _ in range(rng.randint(4, 14))) + f"-{rng.randint(1, 2030)}",
        lambda: "_".join(word() for _ in range(4)) + f"_v{rng.randint(1, 9)}", lambda: f"www.{word()}{word()}.com/{word()}{rng.randint(1, 99)}",
        lambda: pick(letters, rng.randint(20, 40)) + str(rng.randint(0, 99)), lambda: f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-00-00.000Z",
        lambda: word() + "".join(w.capitalize() for w in (word(), word(), word())) + str(rng.randint(1, 9)), lambda: "=" * rng.randint(20, 40) + word() + "1",
        lambda: f"{word()}.{word()}{rng.randint(1, 99)}.{word()}.example.org", lambda: ".".join(str(rng.randint(0, 99999)) for _ in range(5)) + "v" + str(rng.randint(1, 9)),
        lambda: pick(letters, 3) + f"-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}-" + word() + word(), lambda: "".join(w.capitalize() for w in (word(), word(), word(), word())),
        lambda: rng.choice(["token", "key", "secret"]) + "_" + "_".join(word() for _ in range(3)), lambda: word().upper() + "-" + word().upper() + f"-{rng.randint(10, 999)}" + word(),
    ]
    return secret, harmless


def labelled_findings(surroundings: list[str], n: int = 3000, seed: int = 11, without: tuple[int, ...] = (), only: tuple[int, ...] = ()) -> list[Finding]:
    """(text, start, end, window, label) of secrets (1) and harmless runs that look like them (0) of usual shapes, half each.

    `without` leaves out secrets of the shapes so numbered, `only` makes no others. A third of the secrets stand late in a longer run.
    """
    rng = random.Random(seed)
    secret, harmless = _shapes(rng)
    secret = [f for i, f in enumerate(secret) if i not in without and (not only or i in only)]
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9)))
    out = []
    for i in range(n):
        near = surroundings[i % len(surroundings)] if surroundings else "the value is here for all to see and "
        cut = rng.randint(0, max(0, len(near) - 40))
        before, after = near[cut : cut + 30], near[cut + 30 : cut + 40]
        label = i % 2
        run, late = rng.choice(secret if label else harmless)(), 0
        lead = rng.choice([" ", " ", "\n", '"', ": ", "= ", " key ", " bearer "] if label else [" ", " ", "\n", '"', ": ", " see ", " key "])
        if label and rng.random() < 1 / 3:
            path = "/".join(word() for _ in range(rng.randint(2, 8))) + "/"
            run, late = path + run, len(path) - rng.choice([0, 0, rng.randint(0, min(24, len(path)))])
        start = len(before) + len(lead)
        end = start + len(run)
        if not label:
            late = rng.choice([0, rng.randint(0, max(0, len(run) - BODY))])
        out.append((before + lead + run + rng.choice([" ", "\n", '"', ". "]) + after, start, end, start + late, label))
    return out


def corpus_findings(near: list[str], seed: int = 13) -> list[Finding]:
    """(text, start, end, window, label) of the values in base spans of the texts (1), and of as many slugs of their words (0)."""
    rng, out = random.Random(seed), []
    vocabulary = sorted({w for text in near for w in re.findall(r"[a-z]{3,12}", text)})
    for text in near:
        for s, e, kind in base_spans(text):
            value = _ASSIGN.match(text, s) if kind == "assign" else None
            s = value.start(2) if value else s
            if e - s >= NAMED and re.search(r"\d", text[s:e]):
                out.append((text, s, e, s, 1))
                if vocabulary:
                    slug = rng.choice("-_/.").join(rng.choice(vocabulary) for _ in range(rng.randint(3, 8))) + rng.choice(["", str(rng.randint(1, 999))])
                    out.append((text[:s] + slug + text[e:], s, s + len(slug), s, 0))
    return out


def train(docs: DataFrame, sample: int = 200, recall: float = 0.95, chars: int = 400) -> CharNet:
    """Fit the network; about `sample` documents of low hashed id lend `chars` characters each, from a hashed place, to the findings.

    Ids are cut by a range of the hash first, so about four times `sample` rows reach the driver however large the corpus is.
    """
    named = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"))
    share = min(1.0, 4 * sample / max(1, docs.count()))
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - F.lit(chars), F.lit(1))) + 1
    rows = named.where((F.col("h") <= int((1 << 40) * share)) & (F.length("text") >= 40)).select("h", "doc_id", F.col("text").substr(place.cast("int"), F.lit(chars)).alias("near"))
    near = [r["near"] for r in rows.distinct().orderBy("h", "doc_id", "near").limit(sample).collect()]
    found = labelled_findings(near) + corpus_findings(near)
    return fit(np.stack([encode(t, s, e, at) for t, s, e, at, _ in found]), np.array([label for *_, label in found], float), recall)


def find_spans(texts: list[str | None], net: CharNet | None) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, base and model, by start, then kind; a candidate is a span as a whole if any of its windows is likely."""
    out, places, rows = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        out.append(base)
        for s, e in candidates(text, base) if net else ():
            for at in windows(text, s, e):
                places.append((i, s, e))
                rows.append((text, s, e, at))
    hits = set()
    for lo in range(0, len(rows), 2048):
        p = net.probability(np.stack([encode(*row) for row in rows[lo : lo + 2048]]))
        hits.update(place for place, hit in zip(places[lo : lo + 2048], p >= net.threshold) if hit)
    for i, s, e in hits:
        out[i].append((s, e, "model"))
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in out]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and n_model of every row of `docs` (doc_id, text).

    A null text is empty; a text without secrets has the digest of the empty
    string. Spans cover whole matches. Repeated rows are scanned alike and a null
    doc_id is kept. Other columns are ignored.
    """
    net = net or train(docs)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans(batch.column(1).to_pylist(), net)
            count = lambda kind: pa.array([sum(s[2] == kind for s in spans) for spans in found], pa.int64())
            digest = [hashlib.sha256(written([s for s in spans if s[2] != "model"]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count("assign"), count("access"), count("hex"), pa.array(digest, pa.string()), pa.array(map(written, found), pa.string()), count("model")], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint")


def redact_secrets(docs: DataFrame, net: CharNet | None = None, mark: str = "[secret]") -> DataFrame:
    """`docs` with each run of overlapping spans in text replaced by `mark`; all columns and rows stay, n_chars (if there) follows the text.

    A null or empty text stays as it is; repeated rows are treated alike and all stay, as do rows with a null doc_id.
    """
    net = net or train(docs)

    at, sized = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(find_spans(texts, net)):
                if spans:
                    text, parts, end = texts[i], [], 0
                    for s, e, _ in spans:
                        if s >= end:
                            parts += [text[end:s], mark]
                        end = max(end, e)
                    texts[i] = "".join(parts) + text[end:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if sized is not None:
                columns[sized] = pa.array([None if t is None else len(t) for t in texts], columns[sized].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
