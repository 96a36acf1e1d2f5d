"""Near copies, repeated passages, toxicity and main texts against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import components, html_text, minhash, suffix_dedup, toxicity


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, texts, n):
    sets = {i: shingles(t, n) for i, t in enumerate(texts)}
    want = groups(sets)
    got = minhash.near_duplicates(docs, minhash.Plan(words=n)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_in_small_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    want = groups({i: shingles(t, 4) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, minhash.Plan(words=4)).collect()} == want


def test_near_duplicates_when_links_are_refused(spark):
    """Prints of three bits take nearly all pairs for similar; the full sets refuse them, and nothing is lost by it."""
    rnd = random.Random(12)
    base = [str(rnd.randrange(10**6)) for _ in range(150)]
    rows = []
    for i in range(60):
        w, step = list(base), rnd.choice([1, 2, 3, 5, 8])
        for _ in range(step):
            w[rnd.randrange(150)] = str(rnd.randrange(10**6))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = groups({i: shingles(t, 4) for i, t in rows})
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, minhash.Plan(words=4, print_bits=3)).collect()} == want
    assert 3 < len(set(want.values())) < 60


def test_near_duplicates_null_ids_and_repeated_rows(spark, no_docs):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 0, 3, True), (5, 26, 5, True), (5, 26, 5, True), (9, 26, 5, False), (None, 26, None, False)], key=str)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 4)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def spans_by_force(texts, size):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if counts[t[i : i + size]] > 1:
                cover[i : i + size] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        edges = np.diff(np.concatenate([[0], cover.astype(int)]))
        out.append((len(t), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"hot": 2}, {"hot": 1}])
def test_removal(docs, texts, how):
    rows = suffix_dedup.removal_digests(docs, **how).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == dict(enumerate(spans_by_force(texts, 400)))
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in rows)


def test_removal_in_long_documents(spark):
    """Longer than the segments in which windows are looked at; passages at their edges and in the same document."""
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefghijklmnop") for _ in range(900))
    filler = np.random.default_rng(1).integers(97, 123, 2 * suffix_dedup.SEGMENT + 3000).astype(np.uint8).tobytes().decode()
    edge = suffix_dedup.SEGMENT
    long = filler[: edge - 450] + "<" + passage + "1" + filler[edge - 450 : 2 * edge] + ">" + passage + "2" + filler[2 * edge :]
    df = spark.createDataFrame([(1, long), (2, passage[100:700] + "!"), (3, "q" * 300)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:4] for r in suffix_dedup.removal_digests(df).collect()}
    assert got == {1: (len(long), 1800, 2), 2: (601, 600, 1), 3: (300, 0, 0)}


def test_segments_hold_every_window_once():
    n = suffix_dedup.SEGMENT * 2 + 77
    parts = list(suffix_dedup._segments(np.array([0, 10, 10, 10 + n, 10 + n + 500]), 400))
    assert (np.concatenate([np.arange(b, e - 399) for first, last, b, e in parts if first == 2 and last == 3]) == np.arange(10, 10 + n - 399)).all()
    assert {d for first, last, _, _ in parts for d in range(first, last)} == {0, 1, 2, 3}


def test_removal_of_repeated_rows_and_none(spark, no_docs):
    t = "".join(map(chr, range(97, 120))) * 20
    df = spark.createDataFrame([(1, t), (1, t), (None, "z" * 10)], "doc_id long, text string")
    assert sorted((tuple(r)[:4] for r in suffix_dedup.removal_digests(df).collect()), key=str) == [(1, 460, 460, 1), (1, 460, 460, 1), (None, 10, 0, 0)]
    assert suffix_dedup.removal_digests(no_docs).count() == 0 and suffix_dedup.deduplicated(no_docs).columns == no_docs.columns


def test_deduplicated_keeps_columns(docs, texts):
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text is None and rows[3].text == "one" and rows[3].key == "k" and rows[7].text == "" and len(rows) == len(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00", max_size=90), min_size=1, max_size=6))
def test_equal_windows(parts):
    raw = [p.encode() for p in parts]
    at = np.concatenate([[0], np.cumsum([len(p) for p in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return
    counts = Counter(p[i : i + 20] for p in raw for i in range(len(p) - 19))
    want = np.zeros(len(data), bool)
    for a, p in zip(at, raw):
        for i in range(len(p) - 19):
            want[a + i] = counts[p[i : i + 20]] > 1
    assert (suffix_dedup.equal_windows(data, at, 20) == want).all()


def test_corpus_order_is_lexicographic():
    rnd = random.Random(1)
    raw = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 300))) for _ in range(4)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    suffix, parse = suffix_dedup.corpus_order(data, at, suffix_dedup.Rolling(data))
    ends = np.repeat(at[1:], np.diff(at))
    order = np.lexsort((parse, suffix))
    sorted_suffixes = [bytes(data[i : ends[i]]) for i in order]
    assert sorted_suffixes == sorted(sorted_suffixes)


def toxic_docs(spark):
    rnd = random.Random(9)
    plain = ["river", "stone", "walk", "green", "table", "under", "light", "mellow", "garden", "window"]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = [rnd.choice(plain) for _ in range(60)]
        if bad:
            for _ in range(4):
                w[rnd.randrange(60)] = rnd.choice(["zaxquo", "zaxquil", "zaxpem"]) + rnd.choice(["", "s", "ed"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, no_docs):
    docs, labels = toxic_docs(spark)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == 1502 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [r for i, r in got.items() if r.held_out and i < 5000]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97
    assert got[5000].predicted == got[5001].predicted == 0
    left = toxicity.without_toxic(docs.selectExpr("doc_id", "text", "1.0D as score", "'x' as mean"), labels)
    assert left.columns == ["doc_id", "text", "score", "mean"] and left.count() == sum(1 - r.predicted for r in got.values())
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in got.items())
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {r for r in [1 / (1 + np.exp(50))]}


def test_toxicity_counts_every_training_row(spark, monkeypatch):
    """Expressions only in the fifth from which the curve's sample is taken, sampled or not."""
    docs, labels = toxic_docs(spark)
    fifth = [r.doc_id for r in labels.where("pmod(xxhash64(doc_id), 5) = 0 and toxic = 1 and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").collect()]
    changed = docs.where("doc_id < 5000").selectExpr("doc_id", f"case when doc_id in ({', '.join(map(str, fifth))}) then replace(text, 'zaxqu', 'vybkrj') else text end as text")
    asked = spark.createDataFrame([(9000, "river vybkrjo stone vybkrjil"), (9001, "river window stone garden")], "doc_id long, text string")
    for rows in (20, 20_000):
        monkeypatch.setattr(toxicity, "CURVE_ROWS", rows)
        nodes, _ = toxicity.train(changed, labels)
        rows, found = toxicity.with_evidence(asked, nodes, ["doc_id"])
        excess = {r.doc_id: r.excess for r in rows.join(found, F.col("row_number") == F.col("row")).collect()}
        assert excess[9000] > 10 * max(excess.get(9001, 0), 0.01)


def kneser_ney(words, beginning, goes_on, c):
    """P(next beginning | beginning) of class c by the words of the method; words: unit -> (ordinary, toxic)."""
    size = next(n for n in toxicity.STEPS if n > len(beginning))
    below: dict = {}
    for unit, counts in words.items():
        if unit.startswith(beginning) and len(unit) > len(beginning):
            below.setdefault(unit[:size], []).append(counts)
    back = len(below[goes_on]) / sum(map(len, below.values()))
    total = sum(x[c] for xs in below.values() for x in xs)
    if not total:
        return back
    kinds = sum(any(x[c] for x in xs) for xs in below.values())
    return (max(sum(x[c] for x in below[goes_on]) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds * back) / total


def test_kneser_ney_by_hand(spark):
    rnd = random.Random(1)
    words = {}
    for _ in range(120):
        word = "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 14)))
        words[toxicity.units_of(word)[0]] = (rnd.choice([0, 0, 1, 5]), rnd.choice([0, 1, 2]))
    words = {w: c for w, c in words.items() if sum(c)}
    got = {r.node: r.ratio for r in toxicity.log_ratios(spark.createDataFrame([(w, *c) for w, c in words.items()], "unit string, ordinary long, toxic long")).collect()}
    want = {}
    for unit in words:
        ratio, beginning = 0.0, ""
        for size in toxicity.STEPS:
            if len(unit) > len(beginning):
                node = unit[:size]
                ratio += np.log(kneser_ney(words, beginning, node, 1)) - np.log(kneser_ney(words, beginning, node, 0))
                want[node], beginning = ratio, node
    assert got.keys() == want.keys() and all(abs(got[n] - r) < 1e-9 for n, r in want.items())


def test_every_word_is_scored(spark, monkeypatch):
    """Evidence by a plain loop over all words, those of little difference too, in one block and in many."""
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 14))): (rnd.randint(0, 9), rnd.randint(1, 9)) for _ in range(80)}
    nodes = toxicity.log_ratios(spark.createDataFrame([(toxicity.units_of(w)[0], *c) for w, c in words.items()], "unit string, ordinary long, toxic long"))
    ratios = {r.node: r.ratio for r in nodes.collect()}

    def ratio(unit):
        known = [unit[:size] for low, size in zip((0, *toxicity.STEPS), toxicity.STEPS) if len(unit) > low and unit[:size] in ratios]
        return ratios[known[-1]] if known else 0.0

    texts = [" ".join(rnd.choices([*words, "abbab", "zz"], k=rnd.randint(1, 30))) for _ in range(60)] + ["", "zz zz", "?"]
    assert sum(0 < abs(ratio(u)) < 1 for t in texts for u in toxicity.units_of(t)) > 50
    want = {i: [np.mean([f(ratio(u)) for u in toxicity.units_of(t)]) for f in (lambda r: r, lambda r: max(r - toxicity.MARGIN, 0))] for i, t in enumerate(texts) if toxicity.units_of(t)}
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(2)
    for units, rows in ((400_000, 50_000), (5, 2)):
        monkeypatch.setattr(toxicity, "BLOCK_UNITS", units)
        monkeypatch.setattr(toxicity, "UNITS_A_ROW", rows)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        held, found = toxicity.with_evidence(docs, nodes, ["row"])
        got = {r.id: (r.mean, r.excess) for r in held.withColumnRenamed("row", "id").join(found, F.col("row_number") == F.col("row")).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in want)


def test_filter_is_read_alike(spark):
    units = [u for t in ("naïve Ünïcode 日本 mixed42 \ud7ff", "a b c") for u in toxicity.units_of(t)]
    bits = toxicity._filter(spark.createDataFrame([(u,) for u in units], "unit string"))
    assert all(bits[toxicity._place(u) >> 3] >> (toxicity._place(u) & 7) & 1 for u in units) and int(np.unpackbits(bits).sum()) == len(set(units))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the test tables are not here")
def test_toxicity_by_language(spark):
    """Held-out recall and false alarms of each language; the bounds are what the labelled words allow at this size."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = read("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.toxicity_scores(read("documents"), read("labels")).where("held_out").join(labels, "doc_id").join(read("documents").select("doc_id", "lang"), "doc_id").collect()
    share = {g: np.mean([r.predicted for r in rows if r.lang == g and r.toxic == 1]) for g in ("en", "fr", "de", "es")}
    assert share["en"] > 0.9 and min(share["fr"], share["de"]) > 0.5 and share["es"] > 0.3, share
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.005


def test_toxicity_of_odd_rows(spark):
    docs, labels = toxic_docs(spark)
    more = docs.unionByName(spark.createDataFrame([(None, "river stone"), (7, "river stone"), (7, "river stone")], "doc_id long, text string"))
    several = labels.unionByName(labels.withColumn("toxic", F.lit(0))).unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 9)], "doc_id long, toxic int"))
    got = toxicity.toxicity_scores(more, several).collect()
    assert len(got) == 1505 and sum(r.doc_id is None and not r.held_out for r in got) == 1
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000 and r.doc_id != 7]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home page</a><li><a href=/x>Other page</a></ul></nav><div class="ad">Buy this thing now for little money.</div>
<div id="content" class="has-sidebar"><article><h2>The &amp; title</h2><p>First   paragraph with
 <b>bold</b> words, a <a href=x>link</a> and more words to count.<p>Second paragraph, x &lt; y, caf&eacute; &#8212; done<br>and on.
<ul><li>one</li><li>two</li></ul></article><aside>aside text here</aside><div class="sidebar"><p>Latest news of the site and others</p></div></div>
<form><p>Sign in here please</p><input></form><div class="cookie-notice"><p>We use cookies on this site</p></div>
<section id="comments"><p>I have a comment on this long article, which is a comment.</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    want = "The & title\nFirst paragraph with bold words, a link and more words to count.\nSecond paragraph, x < y, café — done and on.\none\ntwo"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.split("</article>")[0]) == want
    assert [html_text.main_text(h) for h in (None, "", "<p>", "<script>x", "just text", "<p>a<p>b")] == ["", "", "", "", "just text", "a\nb"]


def test_main_text_without_article_tag():
    page = PAGE.replace("<article>", "<div class=post>").replace("</article>", "</div>")
    assert html_text.main_text(page).startswith("The & title\nFirst paragraph") and html_text.main_text(page).endswith("two")


SOUP = """<body><div><div><a href=1>Home of all</a> <a href=2>World and more</a> <a href=3>Sports, every day</a></div>
<div><h2>A title</h2><div>By someone</div><div><p>The first paragraph is long enough to be read as one, and goes on for a while.</p><p>Short.</p>
<p>Another paragraph of the text, which also goes on, with <a href=4>one link</a> in its words.</p><ul><li><a href=5>A reference</a></li><li><a href=6>Another one</a></li></ul></div></div>
<div><ul><li><a href=7>Most read story today</a></li><li><a href=8>Second most read story</a></li><li><a href=9>Third of them</a> 3</li></ul></div><div>{}</div></div></body>""".format("<span></span>" * 40 + "5 <b>2</b>")
SOUP_TEXT = "A title\nBy someone\nThe first paragraph is long enough to be read as one, and goes on for a while.\nShort.\nAnother paragraph of the text, which also goes on, with one link in its words.\nA reference\nAnother one"


def test_densities_decide_without_names(monkeypatch):
    """No article element, no class: the densities alone find the text, and constant ones do not."""
    assert html_text.main_text(SOUP) == SOUP_TEXT

    def constant(root):
        measured(root)
        for node in html_text._bottom_up(root):
            node.density = 1.0
            node.total = float(sum(isinstance(c, html_text.Node) for c in node.children))

    measured = html_text.measure
    monkeypatch.setattr(html_text, "measure", constant)
    assert html_text.main_text(SOUP) != SOUP_TEXT


@pytest.mark.parametrize("page", [PAGE, SOUP])
def test_densities_by_hand(page):
    root = html_text.parse(page)
    html_text._parents(root)
    html_text.measure(root)

    def text(node, link=None):
        found = "".join(c if isinstance(c, str) else "" if c.outside or link is False and c.tag == "a" else text(c, link) for c in node.children)
        return "".join(found.split())

    def tags(node, only=None):
        own = int(only is None or node.tag == only)
        return own + sum(tags(c, only) for c in node.children if not isinstance(c, str) and not (only and c.outside))

    share = (len(text(root)) - len(text(root, False))) / len(text(root))
    for node in html_text._bottom_up(root):
        if node.tag == "a" or not text(node):
            continue
        chars, plain = len(text(node)), len(text(node, False))
        links, n, a = chars - plain, tags(node), tags(node, "a")
        base = np.log(chars / max(1, plain) * links + share * chars + np.e)
        want = chars / n * (max(0, np.log(max(1, chars / max(1, links) * n / max(1, a))) / base) if links else max(1, np.log(chars * n) / base))
        assert node.density == pytest.approx(want), node.tag
        assert node.total == pytest.approx(sum(c.density for c in node.children if not isinstance(c, str) and not c.outside))


@pytest.mark.parametrize("inside, want", [
    ("<article><p>Part one of two, long enough.</p></article><article><p>Part two of two.</p></article>", "Part one of two, long enough.\nPart two of two."),
    ("<article><p>Some words that make up a text.</p><ul><li><a href=1>Reference one</a><li><a href=2>Reference two</a></ul></article>", "Some words that make up a text.\nReference one\nReference two"),
    ('<article><p>Some words that make up a text.</p><div class="warning">Mind the gap.</div><p class="search-results-discussion">Found it.</p></article>', "Some words that make up a text.\nMind the gap.\nFound it."),
    ("<header><p>Site</p></header><article><header><h1>Title</h1><p>The standfirst.</p></header><p>Some words that make up a text.</p></article>", "Title\nThe standfirst.\nSome words that make up a text."),
    ('<article><p>Some words that make up a text.</p></article><div class="ad">A long advert, longer than all the words of the article taken together, and then some.</div>', "Some words that make up a text."),
    ('<article><p>Text.</p><div class="post-comments"><p>A comment that is far longer than the text itself.</p></div></article>', "Text."),
])
def test_what_belongs_to_an_article(inside, want):
    links = "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(8))
    for page in (f"<body>{inside}</body>", f"<html><body><nav><ul>{links}</ul></nav>{inside}<footer>Foot</footer></body></html>", f"<body><div><ul>{links}</ul></div><div id=x>{inside}</div></body>"):
        assert html_text.main_text(page) == want


def test_main_texts(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (2, "v", "<div>" * 5000 + "deep", "z")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.main_texts(df).collect()}
    assert got[None].text == "" and got[2].text == "deep" and got[1].n_chars == len(got[1].text)
    assert html_text.main_texts(df.limit(0)).count() == 0
    twice = html_text.main_texts(df.where("page_id = 1").unionByName(df.where("page_id = 1"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


@settings(max_examples=150, deadline=None)
@given(st.text("<>/pdivabc =\"'&;!- \n", max_size=80))
def test_any_markup(html):
    assert isinstance(html_text.main_text(html), str)
