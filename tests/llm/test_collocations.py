"""Counts, scores and ranks against plain loops; sketches that are narrow, folded and met by chance."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import collocations as C

LOWER = {i: i + 32 for i in range(65, 91)}


def grams_of(rows, longest=4):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return counts, n


def expected(rows, least, top):
    counts, n = grams_of(rows)
    found = {g: f for g, f in counts.items() if f >= least and len(g[1]) > 1}
    out = []
    for lang in n:
        ranked = []
        for (of, w), a in found.items():
            if of != lang or any(o == lang and len(v) > len(w) and 100 * f >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (o, v), f in found.items()):
                continue
            cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def made(rnd, n):
    words = ["the", "The", "of", "É", "é", "new", "york", "x-1", "日本", " ", "a" * 300]
    joins = [" ", "\t", "  ", ". ", "!", "\n", " , ", "\x0b"]
    rows = [(rnd.choice(["en", "en", "und", None, ""]), "".join(rnd.choice(words) + rnd.choice(joins[:2] * 4 + joins) for _ in range(rnd.randint(0, 60)))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), (None, " . "), *[("de", "zu viel des guten, zu viel")] * 9, ("en", "over and over " * 700)]


@pytest.mark.parametrize("block,filter_bits,step", [(16, 28, 1 << 21), (4, 5, 37), (3, 8, 50)])
def test_collocations(spark, monkeypatch, block, filter_bits, step):
    for name, value in (("BLOCK_BITS", block), ("FILTER_BITS", filter_bits), ("STEP", step)):
        monkeypatch.setattr(C, name, value)
    rows = made(random.Random(block), 90)
    docs = spark.createDataFrame([(i, t, g, "p", 1, 2) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f long, n long").repartition(4)
    # functions are pickled by reference, so a worker has the module's own values; what the driver builds must agree with them
    if (block, filter_bits) == (16, 28):
        assert sorted(map(tuple, C.collocations(docs, least=4, top=25).collect())) == expected(rows, 4, 25)
        assert C.collocations(docs.where("false")).count() == 0
    # the same steps in this process, with narrow blocks and a folded filter
    texts, langs = pa.array([t or "" for _, t in rows]), pa.array([g if g is not None else "und" for g, _ in rows])
    words, bits = C.words_of(langs, texts), max(block, 12)
    total = np.zeros((C.ROWS, 1 << bits), np.int64)
    hashes = np.concatenate([many[begins] for low in range(0, len(words.word), step) for begins, many in C.phrase_hashes(words, 4, low, min(low + step, len(words.word)))])
    counts, _ = grams_of(rows)
    assert len(hashes) == sum(counts.values()) and len(np.unique(hashes)) == len(counts)
    for row in range(C.ROWS):
        np.add.at(total[row], C.cells_of(hashes, row, bits).astype(np.int64), 1)
    fold = 1 << max(0, bits - filter_bits)
    rows_of_bits = [np.packbits((total[row] >= 4).reshape(-1, fold).any(axis=1)) for row in range(C.ROWS)]
    got = Counter()
    for low in range(0, len(words.word), step):
        for batch in C.counted(words, bits, rows_of_bits, 4, low, min(low + step, len(words.word))):
            got.update({(g, tuple(p.split(" "))): f for g, p, f in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), batch["f"].to_pylist(), strict=True)})
    assert all(counts[g] == f for g, f in got.items()) and {g for g, f in counts.items() if f >= 4} <= set(got)


def test_merged_sketches(spark):
    docs = spark.createDataFrame([("en", f"the cat {i % 7} sat. on") for i in range(200)], "lang string, text string").repartition(5)
    rows = C.heavy_filter(docs, 16, 30, 2)
    one = C.words_of(pa.array(["en"]), pa.array(["the cat 1 sat 9"]))
    kept = {n: C.kept(many[begins], 16, rows).tolist() for n, (begins, many) in enumerate(C.phrase_hashes(one, 2, 0, 5), 1)}
    assert kept == {1: [True, True, False, True, False], 2: [True, False, False, False]}
