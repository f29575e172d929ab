import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.quality import FEATURES, GatedAttention, classify_quality, passages
from loomgraph.llm.registry import op6_toxicity, op7_quality
from loomgraph.llm.toxicity import FactorizationMachine, Pairs, classify_toxicity, terms

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(("query", "label", "least"), [(op7_quality, "quality", 0.97), (op6_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    sf_dir = "/root/testdata/sf0.01"
    rows = query(spark, sf_dir).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert sum(held) >= least * len(held)


@pytest.mark.parametrize("classify", [classify_quality, classify_toxicity])
def test_edge_rows(spark, classify):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["idiot", "scum"] if i % 4 == 0 else ["the", "of"]) for _ in range(30))) for i in range(80)]
    odd = [(100, None), (101, ""), (101, ""), (None, "x"), (102, " \n"), (103, "é" * 5000), (104, "w " * 40_000)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("quality_score", F.lit("s"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i, _ in rows] + [(5, 0, 1), (None, 1, 1), (7, None, None)], LABELS)
    got = classify(docs, labels).collect()
    assert len(got) == 87 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [None]
    good = [r for r in got if r.doc_id is not None and r.doc_id < 80 and r.doc_id not in (5, 7)]
    assert sum(r.predicted == (r.doc_id % 4 == 0 if classify is classify_toxicity else r.doc_id % 4 != 0) for r in good) >= 0.95 * len(good)


@pytest.mark.parametrize("classify", [classify_quality, classify_toxicity])
def test_empty_tables(spark, classify):
    labels = spark.createDataFrame([], LABELS)
    assert classify(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0
    assert [r.score for r in classify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), labels).collect()] == [0.5]


def test_pairs_count_beyond_single_terms(spark):
    """Toxic is what has both of two words, or neither: neither word means anything alone. All settings as in production."""
    rng, rows = np.random.default_rng(0), []
    for i in range(3000):
        a, b = rng.integers(0, 2, 2)
        words = [f"w{k}" for k in rng.zipf(1.4, 30) % 3000] + ["insult"] * a + ["group"] * b
        rows.append((i, " ".join(rng.permutation(words)), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"), F.col("y").alias("toxic"))
    got = {r.doc_id: r for r in classify_toxicity(docs, labels).collect()}
    held = [got[d].predicted == y for d, _, y in rows if got[d].held_out]
    assert len(held) > 400 and sum(held) > 0.97 * len(held)


def test_machine_equals_its_formula():
    """Scores against weights and vectors summed over all pairs, one by one."""
    rng = np.random.default_rng(3)
    bags = [rng.choice(40, n, replace=False).astype(np.int32) for n in (0, 1, 2, 7)]
    model = FactorizationMachine(factors=3)
    model.bias, model.weight[:40], model.vector[:40] = 0.3, rng.normal(size=40), rng.normal(size=(40, 3))
    got = model.logits(np.concatenate([[0], np.cumsum([len(b) for b in bags])]), np.concatenate(bags))
    want = [0.3 + sum(model.weight[i] for i in b) + sum(model.vector[i] @ model.vector[j] for k, i in enumerate(b) for j in b[k + 1 :]) for b in bags]
    assert np.allclose(got, want, atol=1e-4)


def test_attention_equals_its_formula():
    """Gated attention of each bag, passage by passage."""
    rng = np.random.default_rng(4)
    x, bag = rng.normal(size=(6, 5)), np.array([0, 0, 0, 1, 2, 2])
    model = GatedAttention(5)
    p = model.p
    for k in range(3):
        h = [np.tanh(r @ p["W"] + p["b"]) for r in x[bag == k]]
        e = np.exp([np.sum(p["w"] * np.tanh(r @ p["V"]) / (1 + np.exp(-(r @ p["U"])))) for r in h])
        z = sum(a * r for a, r in zip(e / e.sum(), h))
        assert model.score(x, bag)[k] == pytest.approx(1 / (1 + np.exp(-(z @ p["o"] + p["c"][0]))))


@pytest.mark.parametrize("classify", [classify_quality, classify_toxicity])
def test_repeated_ids_count_once_in_the_fit(spark, classify):
    rows = [(i % 60, f"good clean text number {i % 60}" if i % 2 else "BAD!! bad BAD!! idiot") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 2 == 0)) for i in range(60)], LABELS)
    once, often = (spark.createDataFrame(rows * n, "doc_id long, text string") for n in (1, 3))
    scores = {r.doc_id: r.score for r in classify(once, labels).collect()}
    again = classify(often, labels).collect()
    assert len(again) == 180 and all(r.score == pytest.approx(scores[r.doc_id]) for r in again)


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x, bag, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    fitted = GatedAttention(5).fit(x, bag, y, steps=300)
    assert np.abs(fitted.score(x, bag) - y).max() < 0.1


def test_slices_do_not_matter():
    texts = ["one two two", "", "A!! B!! " * 500, None, "é"]
    whole = [x.shape for _, _, x in passages(pa.array(texts), 64)]
    assert sum(n for n, _ in whole) == 1 + 1 + 16 + 1 + 1 and all(k == FEATURES for _, k in whole)
    first, offsets, at = next(terms(pa.array(texts)))
    assert first == 0 and list(np.diff(offsets)) == [2, 0, 2, 0, 1]
    assert all((np.diff(at[a:b]) > 0).all() for a, b in zip(offsets, offsets[1:]))


def test_pairs_of_rare_terms_count(spark):
    """Toxic is what has both of two words; neither tells anything alone, and 1,500 other words are commoner. All settings as in production."""
    rng, rows = np.random.default_rng(7), []
    for i in range(4000):
        a, b = (bool(x) for x in rng.random(2) < 0.28)
        y = 1 if a and b else int(rng.random() < (0.0278 if a or b else 0.406))
        words = [f"c{k}" for k in np.flatnonzero(rng.random(1500) < 0.35)] + ["insult"] * a + ["group"] * b
        rows.append((i, " ".join(words), y, bool(a or b)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, y int").repartition(8)
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"), F.col("y").alias("toxic"))
    got = {r.doc_id: r for r in classify_toxicity(docs, labels).collect()}
    held = [got[d].predicted == y for d, _, y, either in rows if either and got[d].held_out]
    assert len(held) > 300 and sum(held) > 0.95 * len(held)


def test_pair_screen_equals_its_formula():
    """All pairs of all terms against dense sums over documents."""
    rng = np.random.default_rng(8)
    bags = [np.flatnonzero(rng.random(30) < 0.3).astype(np.int32) * 7 for _ in range(200)]
    r = rng.normal(size=200)
    r -= r.mean()
    r += 2.0 * np.array([7 in b and 14 in b for b in bags])
    r -= r.mean()
    terms_ = np.arange(30) * 7
    x = np.array([[t in b for t in terms_] for b in bags]) - np.array([[t in b for t in terms_] for b in bags]).mean(axis=0)
    together, spread = (x * r[:, None]).T @ x, (x * x * (r * r)[:, None]).T @ (x * x)
    for least in (2.0, 3.0, 4.0):
        strong = np.abs(together) >= least * (np.sqrt(spread) + 1e-6)
        np.fill_diagonal(strong, False)
        pairs = pickle.loads(pickle.dumps(Pairs(bags, r, terms_, least)))
        assert sorted({*pairs.strong(0, 10), *pairs.strong(10, 30)}) == list(np.flatnonzero(strong.any(axis=1)))
