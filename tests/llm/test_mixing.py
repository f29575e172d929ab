import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.mixing import fit_domains, mix_domains
from loomgraph.llm.registry import MIX_TARGETS, op5_mixing
from loomgraph.llm.toxicity import terms


def shares(rows, weigh):
    total = sum(weigh(r) * r.n_tokens for r in rows)
    return {d: sum(weigh(r) * r.n_tokens for r in rows if r.domain == d) / total for d in {r.domain for r in rows}}


def test_query_meets_targets_and_knows_domains(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_mixing(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    assert all(r.n_tokens == len((docs[r.doc_id][1] or "").split()) for r in rows)
    assert sum(r.domain == docs[r.doc_id][0] for r in rows) >= 0.97 * len(rows)
    got = shares(rows, lambda r: r.rate)
    assert all(abs(got[d] - w) < 0.03 for d, w in MIX_TARGETS.items())


def test_projection_at_zero(spark):
    """A domain with weight 0 is left out, and the others still match."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{rng.randrange(20)}" for _ in range(40)), "abc"[i % 3]) for i in range(300)]
    got = mix_domains(spark.createDataFrame(rows, "doc_id long, text string, lang string"), {"a": 1.0, "b": 3.0, "c": 0.0}).collect()
    share = shares(got, lambda r: r.rate)
    assert share["c"] < 0.01 and abs(share["a"] - 0.25) < 0.01 and abs(share["b"] - 0.75) < 0.01


def test_rates_equal_a_plain_fit(spark):
    """The same posteriors, and projected gradient steps in numpy over all rows at once."""
    rng, targets = random.Random(9), {"a": 0.2, "b": 0.5, "c": 0.3}
    rows = [(i, " ".join(f"{rng.choice('abc'[i % 3] * 3 + 'abc')}{rng.randrange(40)}" for _ in range(rng.randrange(60))), "abc"[i % 3]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_domains(docs, "lang", sorted(targets), 4000)
    ((_, offsets, at),) = terms(pa.array([t for _, t, _ in rows]))
    p, n, w = model.posteriors(offsets, at), np.array([len(t.split()) for _, t, _ in rows], float), np.ones(len(rows))
    goal = np.array([targets[d] for d in sorted(targets)])
    metric = np.linalg.inv((p * n[:, None]).T @ p / n.sum() + 1e-9 * np.eye(3))
    for _ in range(41):
        reached = (w * n) @ p / n.sum()
        if np.abs(reached - goal).sum() < 1e-4:
            break
        w = np.maximum(0, w - p @ (metric @ (reached - goal)))
    w[n == 0] = 1
    got = {r.doc_id: r for r in mix_domains(docs, targets).collect()}
    assert np.allclose([got[i].rate for i in range(400)], w, atol=1e-6) and (w >= 0).all()
    assert all(got[i].domain == sorted(targets)[p[i].argmax()] and got[i].posterior == pytest.approx(p[i].max()) for i in range(400))
    assert np.allclose((w * n) @ p / n.sum(), goal, atol=2e-4)


def test_targets_out_of_reach_are_told(spark):
    docs = spark.createDataFrame([(i, "a b c", "x") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="not reached"):
        mix_domains(docs, {"x": 1, "nowhere": 1}).count()


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "c", "y"), (4, "c " * 30_000, "y"), (5, "c d", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rate", F.lit("r")).withColumn("_mix_n", F.lit("r"))
    got = mix_domains(docs, {"x": 1, "y": 1}).collect()
    assert len(got) == 7 and all(r.rate == 1 for r in got if r.n_tokens == 0)


def test_empty_and_bad_targets(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mix_domains(docs, {"x": 1}).count() == 0
    with pytest.raises(ValueError):
        mix_domains(docs, {})
