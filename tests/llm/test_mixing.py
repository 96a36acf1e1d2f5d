"""The schedule, the targets and the spans against plain loops."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from loomspark.llm import mixing


def test_points_before():
    for m in range(7):
        n = 1 << m
        reverse = [int(format(k, f"0{m}b")[::-1], 2) if m else 0 for k in range(n)]
        assert mixing.reversed_bits(np.arange(n), m).tolist() == reverse
        for x in range(n + 1):
            want = [sum(reverse[k] < t for k in range(x)) for t in range(n)]
            assert mixing.points_before(np.full(n, x), np.arange(n), m).tolist() == want


def targets(words, weights=(5, 2, 1), most=3):
    """Share, stop, share anew, in exact fractions."""
    open_, target, left = [i for i, w in enumerate(words)], [Fraction(0)] * len(words), Fraction(sum(words))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if left * weights[i % len(weights)] / total > most * words[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i % len(weights)] / total
            break
        for i in over:
            target[i] = Fraction(most * words[i])
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return target


def rows_of(rnd, names, n):
    out = []
    for i in range(n):
        source = rnd.choice(names)
        size = rnd.choice([0, 1, 3, 40, 200]) if source != "b" else 2
        out.append((rnd.choice([None, 7, i, i]), rnd.choice([" ", "\t\n"]).join(["w x"] * size) + " " if size or rnd.random() < 0.7 else None, source))
    return out + [out[0], out[0], out[1]]


@pytest.mark.parametrize("names", [["a", "b", "", None, "é", "Z", "zz"], ["one"], [None, "x" * 50, "y"]])
def test_mix(spark, names):
    rnd = random.Random(len(names))
    rows = rows_of(rnd, names, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS copies", "3 AS idx", "4 AS bucket").repartition(3)
    mix = mixing.Mix(docs, block_words=16)
    spans = mix.spans().collect()
    every = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets([sum(size(t) for _, t, s in rows if s == name) for name in every])
    for name, target in zip(every, want, strict=True):
        mine = [s for s in spans if s.source == name]
        assert sum(s.n_words for s in mine) == int(target)
        # the stream, read round and round, in the order of the slots
        order = sorted((hashlib.md5((str(d) if d is not None else "null").encode()).hexdigest(), d is not None, d or 0, size(t)) for d, t, s in rows if s == name)
        stream = [(d if known else None, n, k) for _, known, d, n in order for k in range(n)]
        read = [(s.doc_id, s.size, s.first + k) for s in sorted(mine, key=lambda s: (s.slot, s.at)) for k in range(s.n_words)]
        assert read == [stream[k % len(stream)] for k in range(int(target))]
    slots = {s.slot: s.source for s in spans}
    assert len({(s.slot, s.source) for s in spans}) == len(slots) and max(slots) < 1 << mix.m
    total = sum(map(int, want))
    for cut in range(1, 1 << mix.m, 7):  # any beginning holds the sources close to their shares
        for name, target in zip(every, want, strict=True):
            assert abs(sum(source == name and slot < cut for slot, source in slots.items()) - cut * int(target) / total) <= mix.m + len(every) + 1
    got = sorted((repr(tuple(r)) for r in mixing.mix_digests(docs).collect()))
    again = sorted((repr(tuple(r)) for r in mixing.mix_digests(docs.repartition(7)).collect()))
    assert got == again and len(got) == len(rows)
    assert all(r.taken <= 3 * r.size for r in mixing.mix_digests(docs).collect())


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " \n", None), (None, "", "a")], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.mix_digests(docs).collect()), key=repr) == sorted([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)], key=repr)
    assert mixing.mix_digests(docs.where("false")).count() == 0
    assert mixing.Mix(docs).spans().count() == 0
