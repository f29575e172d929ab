import numpy as np
import pytest
from plain import roots
from pyspark.sql import functions as F

from loomgraph.llm.embeddings import near_embeddings, shared_points
from loomgraph.llm.registry import op2_near_embeddings, op10_top_k
from loomgraph.llm.topk import reach, top_k


def usable(x):
    return x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x)


def near(rows, least=0.98):
    good = [(i, np.array(x, float), l) for i, x, l in rows if i is not None and l is not None and usable(x) and any(x)]
    links, n = [], {i: 0 for i, *_ in rows}
    for a, (i, x, l) in enumerate(good):
        for j, y, m in good[a + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    top = roots([i for i, *_ in rows if i is not None], links)
    return {i: (n[i], top.get(i), top.get(i) == i) for i, *_ in rows}


def best(rows, k=5, every=50):
    good = [(i, np.floor(256 * np.array(x, float))) for i, x, *_ in rows if i is not None and usable(x)]
    out = []
    for i, q in good:
        if i % every == 0:
            scores = sorted((-int(q @ c), j) for j, c in good if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def read(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]


def test_near_query_equals_brute_force(spark, sf_dir):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op2_near_embeddings(spark, sf_dir).collect()}
    assert got == near(read(spark, sf_dir))


def test_recall_against_brute_force(spark):
    """Pairs close to the threshold, many to a label: at least 0.9 are found, none is wrong."""
    rng, rows = np.random.default_rng(4), []
    for i in range(600):
        x = rng.normal(size=24)
        rows.append((2 * i, x.tolist(), i % 2))
        y = x + rng.normal(size=24) * np.linalg.norm(x) / np.sqrt(24) * 0.17
        rows.append((2 * i + 1, y.tolist(), i % 2))
    want = near(rows)
    got = {r.vec_id: r.n_links for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=100).collect()}
    assert all(got[i] <= want[i][0] for i in want)
    assert sum(got.values()) >= 0.9 * sum(n for n, *_ in want.values()) > 0


def test_thousands_of_links_around_the_threshold(spark):
    """Clusters of many radii in 32 dimensions, three labels, repeated ids with other vectors, repeated rows."""
    rng, rows = np.random.default_rng(11), []
    for c in range(60):
        base = rng.normal(size=32)
        for k in range(rng.integers(1, 40)):
            x = base + rng.normal(size=32) * np.linalg.norm(base) / np.sqrt(32) * rng.uniform(0.05, 0.25)
            rows.append((len(rows), x.tolist(), c % 3))
    rows += [(7, rows[100][1], rows[100][2]), (9, rows[200][1], rows[200][2]), (9, rng.normal(size=32).tolist(), 0)]
    vectors = spark.createDataFrame([*rows, rows[3], rows[3]], "vec_id long, embedding array<double>, label int").repartition(6)
    want = vectors_of(rows)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_embeddings(vectors, block=64).collect())
    assert got == sorted([*want, want[3], want[3]])
    assert sum(w[1] for w in want) > 10_000


def vectors_of(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of distinct rows, each counted as a vector of its own."""
    x, ids, labels = np.array([r[1] for r in rows]), [r[0] for r in rows], np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    top = roots(range(len(rows)), list(zip(*(k.tolist() for k in np.nonzero(link)))))
    low = {}
    for i, t in top.items():
        low[t] = min(low.get(t, ids[i]), ids[i])
    return [(ids[i], int(link[i].sum()), low[top[i]], low[top[i]] == ids[i]) for i in range(len(rows))]


@pytest.mark.parametrize("width", [1, 300])
def test_shared_points_both_ways(width):
    """Counted by products or by lists, the same."""
    rng = np.random.default_rng(2)
    order = np.stack([rng.permutation(900)[:8] if width > 1 else rng.permutation(9)[:8] for _ in range(2 * width + 5)])
    a, b = np.arange(width), np.arange(width, 2 * width + 5)
    count, before = shared_points(order, a, b, 6, 400)
    for i in range(0, len(a), 37):
        for j in range(len(b)):
            both = set(order[a[i], :6]) & set(order[b[j], :6])
            assert count[i, j] == len(set(order[a[i]]) & set(order[b[j]])) and before[i, j] == any(p < 400 for p in both)


@pytest.mark.parametrize("cosine", [0.985, 0.975])
def test_recall_in_a_dense_cluster(spark, cosine):
    """One label's cluster of different vectors holds a third of the rows: at least 0.9 of its links are found, none is wrong."""
    rng, size, n = np.random.default_rng(9), 48, 600
    base = rng.normal(size=size)
    dense = base + rng.normal(size=(n, size)) * np.linalg.norm(base) * np.sqrt((1 / cosine - 1) / size)
    x = np.vstack([dense, rng.normal(size=(2 * n, size))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=256).collect()}
    assert all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.9 * want.sum() > 0


ODD = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (50, [1.0, 0.0], 1), (100, [-0.5, 0.3], 1), (150, [1.0, 2.0, 3.0], 1), (200, [9.0], 1)]


def test_odd_rows(spark):
    vectors = spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("dim", F.lit("x")).withColumn("score", F.lit(1))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_embeddings(vectors).collect()} == near(ODD)
    assert sorted(tuple(r) for r in top_k(vectors).collect()) == best(ODD)


def test_top_query_equals_brute_force(spark, sf_dir):
    assert sorted(tuple(r) for r in op10_top_k(spark, sf_dir).collect()) == best(read(spark, sf_dir))


def test_top_in_small_blocks_with_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for lists, gather in ((3, 4), (1, 1), (9, 1000)):
        got = top_k(vectors.repartition(3), every=10, query_block=7, lists=lists, gather=gather).collect()
        assert sorted(tuple(r) for r in got) == best(rows, every=10)


def test_cutoffs_save_products():
    """With the cutoffs of a gathered share, fewer products are made than all, and no pair is lost."""
    rng = np.random.default_rng(8)
    for energy, most in ((np.ones(64), 1.0), (np.linspace(2, 0.2, 64), 0.85), (0.9 ** np.arange(64), 0.5)):
        c = np.floor(256 * rng.normal(size=(4000, 64)) * energy / 8).astype(np.int64)
        q, q_ids, c_ids = c[::50], np.arange(0, 4000, 50), np.arange(4000)
        score = q @ c.T
        score[q_ids[:, None] == c_ids] = -(2**60)
        cutoff = np.sort(score[:, ::8], axis=1)[:, -5]
        tally = []
        row, col, found = reach(q, q_ids, c, c_ids, cutoff, 4, tally)
        assert sorted(zip(row.tolist(), col.tolist(), found.tolist())) == [(i, j, score[i, j]) for i, j in zip(*(x.tolist() for x in np.nonzero(score >= cutoff[:, None])))]
        assert len(tally) == 4 and sum(tally) <= most * q.shape[0] * c.size


def test_repeated_rows_are_one(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.5, 1.0]), (50, [9.0, 9.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == best([rows[0], rows[2], rows[4]])


def test_large_components(spark):
    rows = [(i * 50, [float(10**12 + i), -3e9]) for i in range(8)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, scale=1).collect()
    want = {q: sorted((-(int(x[0]) * int(y[0]) + int(x[1]) * int(y[1]) + 2**63 & 2**64 - 1) + 2**63, j) for j, y in rows if j != q)[:2] for q, x in rows}
    assert {(r.query_id, r.rank): (-r.score, r.vec_id) for r in got} == {(q, k + 1): x for q, best_ in want.items() for k, x in enumerate(best_)}


@pytest.mark.parametrize("operator", [near_embeddings, top_k])
def test_empty(spark, operator):
    assert operator(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
