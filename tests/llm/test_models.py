"""Toxicity, language-model scores, HTML extraction, license scans and archives."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import licenses, main_text, neural_lm, toxicity, warc
from lakeloom.llm.common import table
from lakeloom.llm.queries import QUERIES

from .helpers import SF, ascii_lower, awkward, empty, space_words


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    rows = QUERIES["op1_toxicity"](spark, sf).collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9
    assert np.mean([s >= 0.5 for s in clean]) < 0.05 and np.mean([s >= 0.5 for s in toxic]) > 0.6


def test_toxicity_on_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(awkward(spark), labels).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows)
    scores = defaultdict(set)
    for r, t in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), [None] * 15):
        scores[r["doc_id"]].add(r["score"])
    assert scores[1] == scores[2]
    flat = toxicity.toxicity(awkward(spark), labels.where("toxic = 0")).collect()
    assert len({r["score"] for r in flat}) == 1 and flat[0]["score"] < 0.5
    assert len(toxicity.toxicity(awkward(spark), labels.limit(0)).collect()) == 15
    assert toxicity.toxicity(empty(spark), labels).collect() == []


def test_toxicity_buckets_follow_characters():
    def of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return next(toxicity.buckets(data, np.array([len(data)])))

    assert set(of("Straße IDIOT")) == set(of("straße idiot")) and len(of("été")) == 1 and len(of("")) == 0
    assert set(of("abcdef")) < set(of("xx abcdef yy"))
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice("abcé ß\n") for _ in range(rng.randrange(60)))
        plain = text.replace("\n", " ")
        assert len(of(text)) == len(set(of(text))) == len({plain[i : i + n] for n in toxicity.ORDERS for i in range(len(plain) - n + 1)})


def test_toxicity_fit_equals_plain_descent():
    """Sums, loss and weights of the sparse fit against dense matrices."""
    rng = np.random.default_rng(1)
    x = rng.random((60, 12)) < 0.3
    x[5] = False
    y = (x[:, 0] | (rng.random(60) < 0.1)).astype(float)
    index, size, scale = np.nonzero(x)[1], x.sum(axis=1), rng.normal(0, 1, 12)
    assert toxicity.sums(index, size, scale) == pytest.approx(x @ scale)
    w, bias = toxicity.fit_logistic(y, index, size, scale, 0.1, steps=3000)
    dense, b = np.zeros(12), 0.0
    for _ in range(20_000):
        error = (1 / (1 + np.exp(-(b + (x * scale) @ dense))) - y) / 60
        dense, b = dense - 0.3 * ((x * scale).T @ error + 0.1 * dense), b - 0.3 * error.sum()
    assert w == pytest.approx(dense * scale, abs=0.01) and bias == pytest.approx(b, abs=0.01)
    z = rng.normal(0, 1, 400)
    t = (rng.random(400) < 1 / (1 + np.exp(-(3 * z - 1)))).astype(float)
    a, b, loss = toxicity.calibrate(z, t)
    losses = [-np.mean(np.where(t > 0, np.log(p), np.log1p(-p))) for p in (1 / (1 + np.exp(-(i * z + j))) for i in np.arange(1, 6, 0.05) for j in np.arange(-3, 2, 0.05))]
    assert loss == pytest.approx(min(losses), abs=1e-3) and 2 < a < 4.5 and -2 < b < 0


def test_lm_base_scores_equal_brute_force(spark):
    texts = {r["doc_id"]: space_words(ascii_lower(r["text"])) for r in table(spark, SF, "documents").collect()}
    counts, ends = Counter(), 0
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    rows = QUERIES["op7_lm_scoring"](spark, SF).collect()
    for r in rows:
        w = texts[r["doc_id"]]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in w) + math.log10((ends + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(counts[t] > 0 for t in w) + 1, n)
        assert r["score"] < 0
    own = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_lm_scores_equal_a_plain_softmax(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    train = docs.where("doc_id % 2 = 0")
    vocab, words = neural_lm.vocabulary(train)
    p = neural_lm.fit(train, vocab)
    assert len(vocab.unigram) == len(p.bias) == 1 + vocab.listed + neural_lm.CLASSES
    texts = {r["doc_id"]: space_words(ascii_lower(r["text"])) for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if i % 2 == 0 for w in t)
    every = sorted(set(w for t in texts.values() for w in t))
    data = " ".join(every).encode()
    read = neural_lm.Words(np.frombuffer(data, np.uint8), np.array([len(data)]))
    hashed, cls = dict(zip(every, read.hash.tolist())), dict(zip(every, neural_lm.classes_of(read).tolist()))
    assert all(cls[a] == cls[b] for a, b in zip(every, every[1:]) if a.encode()[-3:] == b.encode()[-3:])
    listed = sorted(counts, key=lambda w: (-counts[w], hashed[w]))[: neural_lm.LISTED]
    number = {w: i + 1 for i, w in enumerate(listed)}
    mass = Counter({k: 1 for k in range(neural_lm.CLASSES)})
    for w, c in counts.items():
        if w not in number:
            mass[cls[w]] += c + 1
    assert [mass[k] for k in range(neural_lm.CLASSES)] == vocab.mass.tolist()
    got = {r["doc_id"]: r["score"] for r in neural_lm.scored(docs.where("doc_id < 12"), vocab, words, p).collect()}
    for i, score in got.items():
        one = two = 0
        total = 0.0
        for w in [*texts[i], None]:
            out = 0 if w is None else number.get(w, 1 + vocab.listed + cls[w])
            q = p.context[one] * p.c1 + p.context[two] * p.c2
            logits = p.target @ q + p.bias
            total += (logits[out] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            if w is not None and w not in number:
                total += math.log10((counts[w] + 1) / mass[cls[w]])
            one, two = out, one
        assert score == pytest.approx(total, rel=1e-4)


def test_lm_learns(spark):
    rows = [r for r in QUERIES["op7_lm_scoring"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.2 * tokens


def test_lm_on_awkward_rows(spark):
    rows = neural_lm.language_scores(awkward(spark)).collect()
    assert len(rows) == 15 and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert neural_lm.language_scores(empty(spark)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p><p>no";</script></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and more, and more, and more.</div><div id="wrap"><div class="sidebar"><p>Side, side, side, and a rather long text about nothing.</p></div>
<article><header><h1>Head &amp; title</h1></header><p>First  paragraph,\nwith commas, and &lt;b&gt; text &eacute;.<p><b>Second <i>para</i>graph<br>with a break, unclosed
<blockquote>Quoted text.</blockquote><ul><li>Item one<li>Item two</ul><form><p>Subscribe now</p></form>
<div class="ad">Buy, buy, buy this thing now, it is good.</div><p style="display: none">hidden</p><!-- <p>comment</p> --></article>
<section class="comments"><p>Reader says, well, this is a long comment, with many, many commas, indeed, and more.</p></section></div><footer><p>&copy; Owner</p></footer></body></html>"""


def test_main_text():
    assert main_text.main_text(PAGE).split("\n") == ["Head & title", "First paragraph, with commas, and <b> text é.", "Second paragraph with a break, unclosed", "Quoted text.", "Item one", "Item two"]
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<nav><a>x</a></nav>") == ""
    assert main_text.main_text("just text, no tags") == "just text, no tags"
    flat = "<body><div id=menu><a href=x>One</a> <a href=y>Two</a></div><div id=c><p>Long enough text, with commas, here.</p><p>More text, as well, here.</p></div></body>"
    assert main_text.main_text(flat) == "Long enough text, with commas, here.\nMore text, as well, here."
    for broken in ("<", "<p", "<p a='", "</", "<!--", "<script>", "&#", "<p><p></div></p>" * 50, "<div>" * 3000 + "x"):
        main_text.main_text(broken)


@pytest.mark.parametrize("mark", ['class="content has-sidebar"', 'id="social-policy"', 'data-id="ad"', 'title="the hidden gem"', "class='x' data-class=menu", 'id=main-comment-free'])
def test_names_above_the_article_hide_nothing(mark):
    page = f"<body><nav><p>Menu, menu, menu</p></nav><div {mark}><p>First text, with commas, here.</p><p>Second text, as well, here.</p></div></body>"
    assert main_text.main_text(page) == "First text, with commas, here.\nSecond text, as well, here."
    inner = page.replace("<p>Second", '<div class="ad">Buy, buy, buy.</div><div class="post-related"><p>More, more</p></div><p>Second')
    assert main_text.main_text(inner) == main_text.main_text(page)
    assert main_text.main_text(f"<body><p {mark}>First text, with commas, here.</p><p>Second text, as well, here.</p></body>") == main_text.main_text(page)


def test_deep_pages_take_linear_time():
    began = time.perf_counter()
    n = 100_000
    assert main_text.main_text("<div>" * n + "text, at last") == "text, at last"
    assert main_text.main_text("".join(f"<div>x{i}" for i in range(n))).count("x") > 0
    main_text.main_text("<div>" * n + "<dd>a</dd><li>b</li><td>c</td>" * n)
    main_text.main_text("<header><p>x</p></header>" * n)
    assert time.perf_counter() - began < 30


def plain_choice(tree):
    """Blocks kept of a tree of (name, class, children or text), by the definitions, without any care for time."""
    nodes = []

    def walk(node, parent):
        nodes.append((node, parent))
        me = len(nodes) - 1
        for c in node[2] if isinstance(node[2], list) else []:
            walk(c, me)

    walk(("html", "", [tree]), -1)
    chain = lambda e: [e] + chain(nodes[e][1]) if e >= 0 else []
    whole = lambda e: main_text.WHOLE if nodes[e][0][1] in main_text.MARKS and nodes[e][0][0] != "article" else 1.0
    blocks = [(e, x[2]) for e, (x, _) in enumerate(nodes) if isinstance(x[2], str)]
    points = Counter()
    for e, text in blocks:
        ups = chain(nodes[e][1] if nodes[e][0][0] == "p" else e)
        for share, up in zip((1, 2, 3), ups):
            points[up] += (1 + text.count(",") + min(len(text) / 100, 3)) * math.prod(map(whole, chain(e))) / share
    best = max(points, key=lambda e: (round(points[e], 9), -e))
    spared = chain(best)
    best = ([e for e in spared if nodes[e][0][0] == "article"] or [best])[-1]
    size = lambda e: sum(len(t) for b, t in blocks if e in chain(b))
    keep = {best} | {e for e, (x, p) in enumerate(nodes) if p == nodes[best][1] and size(e) and best and (points[e] >= 0.2 * points[best] > 0 or (x[0] == "p" and size(e) > 80))}
    return [t for e, t in blocks if keep & set(chain(e)) and all(whole(a) == 1 or a in spared for a in chain(e))]


def test_scores_equal_plain_ones():
    rng = random.Random(8)

    def grow(depth):
        if depth == 0 or rng.random() < 0.35:
            return ("p", rng.choice(["", "", "", "ad", "lead"]), " ".join(rng.choice(["some", "words,", "of", "text,", "which", "goes", "on"]) for _ in range(rng.randrange(1, 40))))
        return (rng.choice(["div"] * 6 + ["section", "article"]), rng.choice(["", "", "", "", "sidebar", "comments", "body"]), [grow(depth - 1) for _ in range(rng.randrange(1, 5))])

    show = lambda x: f'<{x[0]} class="{x[1]}">' + (x[2] if isinstance(x[2], str) else "".join(map(show, x[2]))) + f"</{x[0]}>"
    for _ in range(400):
        tree = ("body", "", [grow(4) for _ in range(rng.randrange(1, 4))])
        assert main_text.main_text(show(tree)).split("\n") == (plain_choice(tree) or [""]), show(tree)


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long, text " * 50_000 + "</p>")], "page_id long, url string, html string")
    rows = main_text.extract_main_text(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == 5 and rows[0]["text"] == rows[1]["text"] and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert rows[4]["n_chars"] == 50_000 * len("long, text ") - 1 and rows[2]["text"] == ""
    assert main_text.extract_main_text(pages.limit(0)).collect() == []


def test_patience_alignment():
    assert licenses.longest_increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]
    a, b = "x the cat sat on the mat y".split(), "the cat lay on the mat".split()
    pairs = licenses.align(a, b)
    assert [b[j] for _, j in pairs] == ["the", "cat", "on", "the", "mat"] and all(a[i] == b[j] for i, j in pairs)
    assert licenses.align([], b) == licenses.align(a, []) == []


@pytest.mark.parametrize("tag", ["<embed src='x'>", "<EMBED/>", "<iframe/>", "<iframe src='x' />", "<canvas hidden/>", "<math/>", "<svg/>", "<select><option>", "<noscript>", "<audio controls>", "<video>"])
def test_tags_without_an_end_hide_no_text(tag):
    page = "<body><p>Before it, a text.</p>{}<p>After it, a text.</p></body>"
    assert main_text.main_text(page.format(tag)) == "Before it, a text.\nAfter it, a text."
    assert main_text.main_text(page.format("<iframe src=a/>hidden</iframe>")) == "Before it, a text.\nAfter it, a text."
    assert main_text.main_text(page.format("<script/>var a;")) == "Before it, a text."


def test_license_places():
    names = lambda text: [x[0] for x in licenses.scan(text)]
    for name, _, text in licenses.NOTICES:
        assert names(f"some words {text} more words") == [name] and names(f"{text} {text}") == [name, name]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("Released under the MIT License, or licensed under CC0 1.0 Universal. Prose. Released under the MIT License.") == ["CC0-1.0", "MIT", "MIT"]
    for i, (name, _, text) in enumerate(licenses.NOTICES):
        words = licenses.WORD.findall(text.lower())
        if len(words) >= 20:  # every sixth word misspelt, key words too, but for those that tell versions apart
            for first in range(6):
                assert names(" ".join(w if j % 6 != first or w.isdigit() or w in ("lesser", "affero") else w + "x" for j, w in enumerate(words))) == [name], (i, first)


def test_license_scan(spark):
    mit = next(t for n, k, t in licenses.NOTICES if k == "sublicense")
    changed = mit.replace("free of charge", "without any charge").replace("merge, ", "")
    cases = {
        1: ("Prose. Released under the MIT License. Prose. Released under the MIT License.", "MIT"),
        2: ("Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "Apache-2.0,CC-BY-NC-4.0"),
        3: ("das ist mit dem und mit der Lizenz", ""), 4: (None, ""), 5: ("", ""), 6: ("word " * 5000 + changed + " word" * 5000, "MIT"),
        7: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), 8: ("the apache license is mentioned here under version", ""),
    }
    docs = spark.createDataFrame([(i, t, "clash") for i, (t, _) in cases.items()], "doc_id long, text string, licenses string")
    for r in licenses.scan_licenses(docs).collect():
        assert r["licenses"] == cases[r["doc_id"]][1], r
        assert r["n_licenses"] == len(r["spans"]) and (r["coverage"] >= 0.8) == (r["n_licenses"] > 0)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []
    assert len(licenses.scan_licenses(awkward(spark)).collect()) == 15


def test_archive_round_trip(spark):
    rows = [(1, "http://b.example.com/x?q=1", "same"), (5, "http://a.example.com/", "same"), (3, "http://a.example.com/", "é\r\n\r\nbody"), (7, None, None), (8, "not a url\r\nX: y", ""), (9, "http://[bad", "z" * 300_000), (9, "http://[bad", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_round_trip(pages).collect()
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        last[b] = max(last.get(b, -1), i)
    assert sorted(r["page_id"] for r in got) == sorted(i for i, _, _ in rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        b = html[r["page_id"]]
        top = last[b]
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == top else ("revisit", top))
        assert r["payload"] == (b if r["record_type"] == "response" else None)
    alone = spark.createDataFrame([(None, "http://n/", "same"), (4, "http://n/", "same"), (None, None, "other")], "page_id long, url string, html string")
    assert sorted((r["page_id"] is None, r["record_type"], r["refers_to"] or 0) for r in warc.archive_round_trip(alone).collect()) == [(False, "response", 0), (True, "response", 0), (True, "revisit", 4)]
    assert {r["record_type"] for r in warc.archive_round_trip(pages, min_bytes=10).where("page_id IN (1, 5)").collect()} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_index_blocks_and_look_up(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    pages = spark.createDataFrame([(i, f"http://h{i % 9}.example.org/p/{i // 2}", f"body {i}") for i in range(100)], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    assert archive.captures == 100 and archive.directory.count() >= 25
    keys = spark.createDataFrame([(warc.url_key("http://h3.example.org/p/6"),), ("zz,none)/",)], "key string")
    assert sorted(r["page_id"] for r in warc.look_up(archive, keys).collect()) == [12]
    assert sorted(r["page_id"] for r in warc.look_up(archive, warc.url_keys(pages)).collect()) == list(range(100))
    assert warc.url_key("HTTP://User@Www.Example.com:80/a?b#c") == "com,example,www)/a?b"


def test_captures_of_one_key_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    monkeypatch.setattr(warc, "READS_PER_TASK", 10)
    pages = spark.createDataFrame([(i, None if i % 3 else f"http://h.org/{i}", f"<p>{i}") for i in range(90)], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    got = warc.look_up(archive, spark.createDataFrame([(warc.url_key(None),)], "key string")).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["page_id"] for r in got) == [i for i in range(90) if i % 3]
    assert max(Counter(r["task"] for r in got).values()) <= 10
    assert sorted(r["page_id"] for r in warc.look_up(archive, warc.url_keys(pages)).collect()) == list(range(90))
