"""Tokenizer alignment against whole texts, one by one."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import pytest

from loomgraph.llm import alignment as al
from loomgraph.llm.registry import op13_alignment, tokenizer_path

A, B = (tokenizer_path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string"


def whole(text):
    """Groups [(a ids, b ids)] of one text, None without tokens."""
    both, want = al.tokenizers(A, B), f" {text}".encode()
    a, b = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)
    if not text or b"".join(both.a_bytes[i] for i in a) != want or b"".join(both.b_bytes[i] for i in b) != want:
        return None
    ends = [[], []]
    for found, ids, table in zip(ends, (a, b), (both.a_bytes, both.b_bytes)):
        at = 0
        for i in ids:
            at += len(table[i])
            found.append(at)
    common = sorted(set(ends[0]) & set(ends[1]))
    cut = [[[] for _ in common] for _ in range(2)]
    for groups, ids, found in zip(cut, (a, b), ends):
        for i, e in zip(ids, found):
            groups[bisect_left(common, e)].append(i)
    return list(zip(*cut))


def plain(rows):
    groups = [(d, whole(t or "")) for d, t in rows]
    count = Counter((a[-1], b[-1]) for _, g in groups for a, b in g or ())
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for d, g in groups:
        g = g or []
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        ns = [count[a[-1], b[-1]] for a, b in g]
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(n == best[b[-1]] for n, (_, b) in zip(ns, g)), sum(ns), text))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", *al.COUNTS, "groups").collect()), key=str)


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a   ", "\n", "\n\n a\n b \n", "a  b  c", "▁x", "a ▁ b", "plain text beside ▁", "<|endoftext|> <s> </s> <unk> <0x41>", "don't  we'll", "x\x1c y\x85 z\x00 w", "日本語 テキスト é🙂 ①", " " * 3000, "\t " * 500, "ab" * 3000, "1234 5678   90", "​ ﻿ a　 b"]


def test_segments_are_the_whole(spark):
    """Encodings of segments, side by side, are those of the whole text."""
    both, rng = al.tokenizers(A, B), random.Random(3)
    assert both.separable
    letters = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "é", "▁", "'s", "'", ".", "1", "日", " ", "\x1f", "🙂", " ", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 30)))
        parts = both.segments(text)
        assert "".join(f" {x}" for x in parts) == f" {text}"
        assert [i for x in parts for i in both.a.encode(f" {x}", add_special_tokens=False).ids] == both.a.encode(f" {text}", add_special_tokens=False).ids
        assert [i for x in parts for i in both.b.encode(x)] == both.b.encode(text), repr(text)


@pytest.mark.parametrize(("block_bytes", "piece", "shares"), [(16 << 20, 1 << 20, None), (300, 50, 3), (1, 7, 50)])
def test_documents_equal_whole_texts(spark, block_bytes, piece, shares):
    rng = random.Random(4)
    words = ["alpha", "Beta,", "gamma.", "delta\n", "▁", "naïve", "x1", "'s", "(the", " ", ""]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(words, [9, 9, 9, 3, 0.1, 5, 5, 3, 5, 1, 1], k=rng.randrange(60)))) for i in range(60)]
    rows += [(7, "again"), (7, "again"), (None, "none"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", row long, block int").repartition(3)
    assert found(al.align_tokenizers(docs, A, B, block_bytes=block_bytes, piece=piece, shares=shares)) == plain(rows)


def test_unverified_vocabularies_are_not_split(spark, monkeypatch):
    both = al.tokenizers(A, B)
    monkeypatch.setattr(both, "separable", False)
    assert both.segments("a b c") == ["a b c"] and both.cuts("a b c" * 100, 5) == [0]


def test_long_text_empty_table_and_digest(spark, tmp_path):
    rows = [(1, "word and more " * 90_000), (2, "x" * 200_000), (3, " " * 400_000 + "a"), (4, "short one")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = {r[0]: (*r[1:7], hashlib.sha256(r[7].encode()).hexdigest()) for r in plain(rows)}
    assert {r.doc_id: tuple(r)[1:] for r in op13_alignment(spark, str(tmp_path)).collect()} == want
    assert al.align_tokenizers(spark.createDataFrame([], SCHEMA), A, B).count() == 0
