import random

import numpy as np
import pytest
from plain import near
from pyspark.sql import functions as F

from loomgraph.llm.minhash import drop_near_duplicates, large_buckets, near_duplicates
from loomgraph.llm.registry import op9_near_duplicates


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op9_near_duplicates(spark, sf_dir)) == near(rows, 3, 85)


def test_families_of_copies(spark):
    rng, rows = random.Random(3), []
    for family in range(4):
        base = [f"w{rng.randrange(900)}" for _ in range(150)]
        for i in range(60):
            own = list(base)
            for _ in range(family * 2):
                own[rng.randrange(150)] = f"x{rng.randrange(900)}"
            rows.append((family * 100 + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, size=5, percent=80)) == near(rows, 5, 80)
    assert result(near_duplicates(docs, size=5, percent=80, stars=0, small=3)) == near(rows, 5, 80)
    assert result(near_duplicates(docs, size=5, percent=80, stars=1, small=3, block=7)) == near(rows, 5, 80)


def test_a_lane_is_not_held_against_itself(spark):
    """A component of 300 members and 5 others in one bucket: blocks of the others meet all, those of the component only others."""
    base = np.arange(400, dtype=np.uint64)
    found = [np.delete(base, i) for i in range(300)] + [np.concatenate([base[: 60 * k], 10_000 * k + base]) for k in range(1, 6)]
    rows = [(i, len(x), 7, 0 if i < 300 else i, [7] * 25, x.tobytes()) for i, x in enumerate(found)]
    table = spark.createDataFrame([(*r[:4], r[4], bytearray(r[5])) for r in rows], "id long, n_shingles long, band long, c long, bands array<long>, found binary")
    links = large_buckets(table.select("band", "id", "n_shingles", "c"), table.select("band").distinct(), table.select("id", "bands"), table.select("id", "found"), 80, most_rows=30)
    assert links.count() == 0
    near_ = [np.concatenate([base[:390], [np.uint64(77_777)]]), *found]
    rows = [(i, len(x), 7, 0 if 0 < i <= 300 else 1000 + i, [7] * 25, bytearray(x.tobytes())) for i, x in enumerate(near_)]
    table = spark.createDataFrame(rows, "id long, n_shingles long, band long, c long, bands array<long>, found binary")
    links = large_buckets(table.select("band", "id", "n_shingles", "c"), table.select("band").distinct(), table.select("id", "bands"), table.select("id", "found"), 80, most_rows=30)
    got = links.collect()
    assert got and {frozenset((r.a, r.b)) & {0} for r in got} and all(r.b != 0 and r.b <= 300 and r.a <= 300 for r in got)


def test_unlike_texts_of_one_id(spark):
    """Rows are placed and dropped by their own texts; other columns stay, whatever their names."""
    words = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(words), " ".join(words[:39] + ["x"]), " ".join(reversed(words))
    rows = [(1, a), (1, c), (2, b), (3, c), (3, a.upper()), (4, "z y"), (4, "z y"), (5, None), (5, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, component long").withColumn("_near_id", F.lit("k")).withColumn("digest", F.lit("k"))
    placed = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert placed == {(1, 36, 1, True), (2, 36, 1, False), (3, 36, 1, False), (4, 1, 4, True), (5, 0, 5, True), (None, 36, None, True)}
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = sorted(r.component for r in left.collect())
    assert kept in ([0, 1, 5, 7, 8, 9, 10], [0, 1, 6, 7, 8, 9, 10])


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  b"), (8, "a b c d"), (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (10, "é b c"), (11, "É b c"), (12, "z " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(0)).withColumn("bands", F.lit("x")).withColumn("hi", F.lit(None).cast("string"))
    got = sorted((tuple(r) for r in near_duplicates(docs, size=3, percent=85).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 2, 8, True), (9, 2, 8, False), (9, 2, 8, False), (None, 2, None, True), (10, 1, 10, True), (11, 1, 11, True), (12, 1, 12, True)], key=str)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    assert near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
