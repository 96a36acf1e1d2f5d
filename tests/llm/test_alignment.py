"""Tokens, groups and links against loops over the libraries' own tokens."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import alignment as A
from loomspark.llm.pretokens import ALPHABET

MIXED = st.lists(st.sampled_from(list("aaBbÉé ß  \n\t's're!?.,<|>=12²́ \x1c\x85\x00ΓΣж中😀_-İ ▁") + [" the", "'s", " ", "  ", "<|endoftext|>", "<s>", "<0x0A>", "<unk>"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def looped(libraries, text):
    """(n_a, n_b, groups, links) by the contract's words."""
    a, b = libraries
    want = (" " + (text or "")).encode()
    byte = {c: i for i, c in enumerate(ALPHABET)}
    ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
    ids_b = b.encode(text or "")
    tokens_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    tokens_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
    if not text or b"".join(tokens_a) != want or b"".join(tokens_b) != want:
        return 0, 0, None, []
    ends = []
    for tokens in (tokens_a, tokens_b):
        at, out = 0, []
        for t in tokens:
            at += len(t)
            out.append(at)
        ends.append(out)
    both, groups = sorted(set(ends[0]) & set(ends[1])), []
    for low, high in zip([0, *both], both):
        groups.append(",".join(str(i) for i, e in zip(ids_a, ends[0], strict=True) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends[1], strict=True) if low < e <= high))
    links = [(i, j) for i, e in zip(ids_a, ends[0], strict=True) for j, f in zip(ids_b, ends[1], strict=True) if e == f]
    return len(ids_a), len(ids_b), ";".join(groups), links


@settings(max_examples=60, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=4))
def test_alignment_of_texts(libraries, texts):
    import public_tokenizers as P

    aligner = A.aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    wide = aligner.pairs.wide
    counts, strings, pairs, offsets = aligner.batch(pa.array(["lead", *texts], pa.string()).slice(1))
    for i, (text, (n_a, n_b, n_groups), groups) in enumerate(zip(texts, counts.tolist(), strings.to_pylist(), strict=True)):
        want = looped(libraries, text)
        codes = aligner.pairs.codes[pairs[offsets[i] : offsets[i + 1]]].tolist()
        assert (n_a, n_b, groups) == want[:3] and sorted((c // wide, c % wide) for c in codes) == sorted(want[3])
        assert n_groups == (groups.count(";") + 1 if groups else 0)


def test_link_digests(spark, docs, texts, libraries, no_docs):
    every = [*texts, "▁ no", "tie tie"]
    extra = spark.createDataFrame([(len(texts), "▁ no"), (None, "tie tie")], "doc_id long, text string")
    got = sorted((tuple(r) for r in A.link_digests(docs.select("doc_id", "text").unionByName(extra).selectExpr("*", "1 AS n_a", "'x' AS pairs", "'y' AS groups")).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    found = [looped(libraries, t) for t in every]
    counts = Counter(link for f in found for link in f[3])
    best: dict = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    for i, (f, row) in enumerate(zip(found, got, strict=True)):
        sha = hashlib.sha256(f[2].encode()).hexdigest() if f[2] is not None else ""
        n_groups = f[2].count(";") + 1 if f[2] else 0
        assert row == (i if i < len(every) - 1 else None, f[0], f[1], n_groups, len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), sha)
    assert A.link_digests(no_docs).count() == 0


def test_groups_in_full(spark, libraries):
    row = A.aligned(spark.createDataFrame([(3, "naïve 日本 x")], "doc_id long, text string")).first()
    assert row.groups == looped(libraries, "naïve 日本 x")[2] and row.n_groups == row.groups.count(";") + 1
