import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.intervals import equal_windows
from loomgraph.llm.passages import remove_repeats, repeated
from loomgraph.llm.registry import op4_remove_repeats


def brute(rows, size):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for w in {b[i : i + size] for i in range(len(b) - size + 1)}:
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if d is not None and first[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        n = sum(gone)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), n, spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op4_remove_repeats(spark, sf_dir)) == brute(rows, 50)


@pytest.mark.parametrize("group_bytes", [4000, 10**9])
def test_planted_passages(spark, group_bytes):
    rng = random.Random(8)

    def word():
        return rng.choice(["é", "ab", "the", "of ", "x" * 9]) + str(rng.randrange(30))

    shared = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    rows = []
    for d in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            parts += [s[rng.randrange(20) :], word()]
        rows.append((d, "".join(parts)))
    rows += [(200 + d, rows[d][1]) for d in range(40)] + [(300, "ab" * 200), (301, "b" + "ab" * 90), (302, "z" * 500), (299, "z" * 60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(remove_repeats(docs, size=50, group_bytes=group_bytes)) == brute(rows, 50)


@pytest.mark.parametrize("most_strings", [1, 40])
def test_common_minimizers_window_by_window(spark, most_strings):
    """A passage in most documents, with other text around it in each: its strings are not compared in one task."""
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passage = noise(300)
    rows = [(d, noise(rng.randrange(80)) + (passage[rng.randrange(40) :] if d % 3 else noise(90)) + noise(rng.randrange(80))) for d in range(240)]
    rows += [(500, "z" * 300), (501, "z" * 90), (500, "z" * 99 + passage), (7, passage + noise(9)), (502, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(remove_repeats(docs, group_bytes=6000, most_strings=most_strings).drop("spans")) == brute(rows, 50)


def test_odd_rows(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(80))
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, text), (5, text[:49]), (6, text[10:60]), (None, text), (7, "q" + text[:60] + "q"), (8, "ñ" * 30 + text), (9, "ñ" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit(1)).withColumn("g", F.lit(None).cast("int"))
    assert got(remove_repeats(docs)) == brute(rows, 50)
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in remove_repeats(docs).collect() if r.doc_id}
    assert spans[7] == [(1, 61)] and spans[4] == [(0, 80)] and spans[3] == []


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_any_doc_ids(spark, partitions):
    """Ids below 0 and at the ends of their range, whatever the partitions."""
    passage = "".join(chr(97 + i * i * i % 26) for i in range(80))
    ids = [-(2**63), -9, -8, -7, -1, 0, 1, 2**63 - 1]
    rows = [(d, f"{i}" * (i % 3) + passage + "~" * i) for i, d in enumerate(ids)] + [(-8, passage[::-1]), (5, "x" + passage[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert got(remove_repeats(docs)) == brute(rows, 50)


def test_very_long_text(spark):
    """A text of some MB, all in one row, with a passage of its end in another document."""
    rng = random.Random(1)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long_), (2, "q" * 60 + long_[-200:]), (3, long_[1_000_000:1_000_300])]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (0, 0), 2: (200, 1), 3: (300, 1)}


def test_doc_ids_with_several_texts(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(80))
    other = "".join(chr(65 + i * i * i % 26) for i in range(300))
    rows = [(1, text), (2, other), (2, "x" + text[:70]), (3, text), (3, "z" * 90 + text[5:] + other[:60]), (3, "short"), (4, "y" + other), (4, "y" + other), (4, text[:60]), (5, "z" * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(remove_repeats(docs)) == brute(rows, 50)


def test_repeated_strings():
    rng = random.Random(4)
    strings = [(rng.randrange(6), rng.randrange(3), bytes(rng.choices(b"ab", k=rng.randrange(1, 5)))) for _ in range(300)]
    doc, key = (np.array(x) for x in list(zip(*strings))[:2])
    length = np.array([len(x) for _, _, x in strings])
    found = repeated(doc, key.astype(np.uint64), np.frombuffer(b"".join(x for _, _, x in strings), np.uint8), np.cumsum(length) - length, length)
    assert found.tolist() == [any(e < d and (j, y) == (k, x) for e, j, y in strings) for d, k, x in strings]
    assert not len(repeated(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint8, np.int64, np.int64))))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_against_slices():
    rng = np.random.default_rng(1)
    for trial in range(90):
        size = int(rng.integers(1, 12))
        strings = [bytes(rng.integers(0, [2, 3, 256][trial % 3], rng.integers(0, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        offsets, want, found = np.concatenate([[0], np.cumsum([len(x) for x in strings])]), {}, {}
        for i, x in enumerate(strings):
            for j in range(len(x) - size + 1):
                want.setdefault(x[j : j + size], []).append(offsets[i] + j)
        for a, b in zip(*equal_windows(np.frombuffer(b"".join(strings), np.uint8), offsets, size)):
            found.setdefault(b, []).append(a)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
