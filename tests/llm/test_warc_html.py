from __future__ import annotations

import base64
import hashlib
import random

from tessella.llm import html_text, warc
from tessella.llm.common import shared_dir

PAGES = [
    (1, "http://a.example/1", "<p>same"), (2, "http://a.example/2", "<p>same"), (3, "http://a.example/3", "<p>same"), (4, None, None), (5, "http://b.example/5", ""),
    (6, "http://b\r\nInjected: x", "é😀\r\n\r\nWARC/1.1\r\n" * 10), (None, "u", "<p>same"), (None, "u", "alone"), (7, "x", "y" * 3_000_000), (8, "dup", "twice"), (8, "dup", "twice"), (9, "z", "\x00\x1f\x8b"),
]
SCHEMA = "page_id bigint, url string, html string, keep bigint, sha1 string, shard int, text string, host string, row int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, "t", "h", 3) for r in rows], SCHEMA).repartition(3)


def test_archives_round_trip(spark):
    path = f"{shared_dir(spark)}/warc"
    warc.write_warc(pages(spark, PAGES), path, shard_bytes=1 << 20, roll_bytes=2000)
    got = warc.read_warc(spark, path, with_payload=True).collect()
    want, body = [], {}
    for page, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        keep = max(ids) if ids else None
        revisit = keep is not None and page != keep
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, len(data), digest, "revisit" if revisit else "response", keep if revisit else None))
        body[digest] = data
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert all(bytes(r["payload"]) == body[r["payload_digest"]] for r in got if r["record_type"] == "response")
    files = spark.read.parquet(f"{path}/manifest").collect()
    assert len(files) > 3
    for name, rolled in (("again", 2000), ("once_more", 2000)):  # the same bytes on every run
        other = f"{shared_dir(spark)}/{name}"
        warc.write_warc(pages(spark, PAGES[::-1]), other, shard_bytes=1 << 20, roll_bytes=rolled)
        assert sorted((r["file"], r["sha256"]) for r in spark.read.parquet(f"{other}/manifest").collect()) == sorted((r["file"], r["sha256"]) for r in files)


def test_small_payloads_are_responses(spark):
    path = f"{shared_dir(spark)}/warc"
    warc.write_warc(pages(spark, PAGES), path, revisit_from=100)
    assert {r["page_id"] for r in warc.read_warc(spark, path).where("record_type = 'revisit'").collect()} == set()


def test_empty_table(spark):
    assert warc.archive_pages(pages(spark, PAGES).limit(0)).count() == 0
    assert html_text.extract_text(pages(spark, PAGES).limit(0)).count() == 0


MENU = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav>'
END = "<footer>© 2024 All rights reserved</footer>"
HTML = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body>{MENU}<article><h1>Head &amp; tail</h1><p>One <b>bold</b>\n\n text.<p>Two&nbsp;2 &#233;<br>more</p></article>{END}", "Head & tail\n\nOne bold text.\n\nTwo 2 é more"),
    ("<body><script>var x='</p><article>no</article>';</script><main><p>a &lt;tag&gt; 1 < 2</p><aside>side</aside><form><p>f</p></form><div class='ad'>buy</div><!-- <p>c</p> --></main>", "a <tag> 1 < 2"),
    ("<article><p>said <a href='x>y'>a link</a>.</p><section class='comments'><p>first!</p></section><div id=cookie-notice>ok?</div><p>end", "said a link.\n\nend"),
    ("<article><ul><li>x</li><li>y</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre>p  q\n r</pre></article>", "x\n\ny\n\n1\n\n2\n\np q r"),
    ("<div class='adventure'><article class='admin'><p class='addition'>kept</p></article></div>", "kept"),
    ("<article><p>open <i>tags <p>everywhere", "open tags\n\neverywhere"),
    ("<article><div class='section-header'><h2>Part one</h2></div><p class='share-price'>up</p><table class='social-history'><tr><td>t</td></tr></table><section id='related-work'>see</section></article>", "Part one\n\nup\n\nt\n\nsee"),
    ("<article><p>a</p><div class='related-posts'>x</div><div class='box ad-slot'>y</div><p class='adsl'>b</p><div id='comment_list'>z</div></article>", "a\n\nb"),
    ("", ""), (None, ""), ("<nav>only a menu</nav>", ""), ("<article></article>", ""),
]


def test_article_text(spark):
    rows = [(i, f"http://h.example/{i}", h) for i, (h, _) in enumerate(HTML)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(HTML)}


def test_repeated_text_of_a_host_goes_and_articles_stay(spark):
    bar = "<div>" + " ".join(f"menu{i}" for i in range(12)) + "</div>"
    story = lambda i: " ".join(f"word{i}x{k}" for k in range(15))
    rows = [(i, "http://www.h.example/x", f"<body>{bar}<div>{story(i)}</div>{bar}") for i in range(3)]
    rows += [(10 + i, "http://h.example/y", "<article><p>an article that stands here twice with the very same long words in it</p></article>") for i in range(2)]
    rows += [(20, "http://other.example/", f"<body>{bar}"), (None, None, "<p>alone")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages(spark, rows)).collect()}
    for i in range(3):
        assert got[i] == story(i)
    assert got[10] == got[11] == "an article that stands here twice with the very same long words in it"
    assert got[20].startswith("menu0 menu1") and got[None] == "alone"


def brute_texts(rows, least=8):
    """Every 8 tokens of the judged blocks of a page are looked up in all other pages of its host."""
    parsed = []
    for page_id, url, page in rows:
        found = html_text.blocks(page)
        role = html_text.DOUBTFUL if any(r in (html_text.ARTICLE, html_text.DOUBTFUL) for r, _ in found) else html_text.UNDECIDED
        judged = [t for r, t in found if r == role]
        other = [t for r, t in found if r not in (role, html_text.ARTICLE, html_text.DROPPED)] + [t for r, t in found if r == html_text.DROPPED]
        host = (url or "").split("//")[-1].split("/")[0].removeprefix("www.")
        main = [(r == role, t) for r, t in found if r in (role, html_text.ARTICLE)]
        open_ = bool(judged) or role == html_text.UNDECIDED
        parsed.append((page_id, host, (main, None) if open_ else (None, " ".join(other)), " ".join(judged + other).split(), main))
    out = []
    for page_id, host, content, stream, main in parsed:
        have = set()
        for _, other, its, tokens, _ in parsed:
            if other == host and its != content:
                have |= {tuple(tokens[i : i + least]) for i in range(len(tokens) - least + 1)}
        gone = {j for i in range(len(stream) - least + 1) if tuple(stream[i : i + least]) in have for j in range(i, i + least)}
        kept, at = [], 0
        half = sum(len(t.split()) for _, t in main) / 2 if all(j for j, _ in main) else 10**9
        for judged, block in main:
            words = block.split()
            if not judged:
                kept.append(block)
                continue
            left = words if len(words) > half else [w for k, w in enumerate(words, at) if k not in gone]
            at += len(words)
            kept += [" ".join(left)] if left else []
        out.append((page_id, "\n\n".join(kept)))
    return sorted(out, key=str)


def test_repeats_of_a_host_equal_brute_force(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(3, 20)))
    shared = [sentence() for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(shared) if rng.random() < 0.5 else sentence() for _ in range(rng.randint(1, 7))]
        body = "".join(f"<div>{p}</div>" if rng.random() < 0.8 else f"<nav>{p}</nav>" for p in parts)
        if rng.random() < 0.2:
            body = f"<article><p>{sentence()}</p></article>" + body
        if rng.random() < 0.3:
            body += f"<article><p>{sentence()}</p><div class='news-banner-story'>{rng.choice(shared)}</div><p>{sentence()}</p><div class='share-price'>{sentence()}</div></article>"
        rows.append((i, f"https://{rng.choice(['www.', ''])}h{rng.choice((0, 0, 0, 1, 2))}.example/{i}", body))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]  # copies count once
    rows += [(300, rows[0][1], None), (None, rows[1][1], ""), (5, rows[5][1], rows[5][2]), (301, rows[2][1], "<div>" + "very long page of words " * 4000 + "</div><div>" + shared[0] + "</div>")]
    got = html_text.extract_text(pages(spark, rows)).collect()
    assert sorted(((r["page_id"], r["text"]) for r in got), key=str) == brute_texts(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_doubtful_blocks_of_articles_are_judged_by_their_host(spark):
    bar = " ".join(f"word{i}" for i in range(12))
    rows = [(i, "http://h.example/x", f"<article><p>story {i}</p><div class='promo-line'>{bar}</div><div class='share-price'>{i} only here</div></article>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert got == {i: f"story {i}\n\n{i} only here" for i in range(3)}


def test_copies_keep_their_text(spark):
    body = "<div>one main text that stands on two addresses of this host and is equal there</div>"
    rows = [(i, f"http://h.example/{i}", body) for i in range(2)]
    got = html_text.extract_text(pages(spark, rows)).collect()
    assert {r["text"] for r in got} == {body[5:-6]}
