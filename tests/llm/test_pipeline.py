import re
from collections import Counter

import pytest
from plain import near
from test_packing import check

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) rows of each stage over one small corpus."""
    sf_dir = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        out[name] = docs.collect(), result.collect()
        if name != "packing":
            assert result.columns == docs.columns and dict(result.dtypes) == dict(docs.dtypes)
        docs = result
    return out


def test_quality(spark, stages):
    before, after = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert kept < {r.doc_id for r in before}
    known = [(labels[r.doc_id], r.doc_id in kept) for r in before if r.doc_id in labels]
    assert all(k for y, k in known if y == 1) and sum(not k for y, k in known if y == 0) >= 0.97 * sum(y == 0 for y, _ in known)


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    want = near([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, _, kept) in want.items() if kept)


def test_secrets(stages):
    before, after = stages["secrets"]
    old = {r.doc_id: r for r in before}
    assert sorted(old) == sorted(r.doc_id for r in after)
    secret = re.compile(r"AKIA[A-Z0-9]{12}|(?i:(?:password|token) *= *\"?)[0-9a-f]{8}|[0-9a-f]{32}")
    assert any(secret.search(r.text) for r in before) and not any(secret.search(r.text) for r in after)
    assert all(r == old[r.doc_id] for r in after if not secret.search(old[r.doc_id].text))


def test_mixing(stages):
    before, after = stages["mixing"]
    old, tokens = {r.doc_id: r for r in before}, Counter()
    for r in after:
        assert r == old[r.doc_id]
        tokens[r.lang] += len(r.text.split())
    assert all(abs(tokens[d] / sum(tokens.values()) - w) < 0.08 for d, w in corpus_pipeline.MIX_TARGETS.items())


def test_packing(stages):
    before, after = stages["packing"]
    one = {r.doc_id: r.text for r in before}
    times = Counter(r.doc_id for r in before)
    assert Counter(r.doc_id for r in after if r.start == 0) == times
    once = {d for d, n in times.items() if n == 1}
    assert {r.doc_id for r in after} == set(one)
    if len(once) == len(one):
        check(after, list(one.items()))


ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "a b c d e f g h", "en", "s", 1),
    (3, "a b c d e f g h", "en", "s", 1),
    (3, "password = abcdefgh12 of another text", "en", "s", 1),
    (None, "x y", "xx", None, 3),
    (4, "wort " * 9000, "de", "s", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("copies", "copy", "n_tokens", "quality_score", "component", "rate", "_mix_w", "_near_id", "domain")


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty texts, repeated rows, unlike texts of one doc_id, users' columns of all internal names."""
    docs = spark.createDataFrame([(*r, *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(ROWS)], ", ".join([SCHEMA, *(f"{c} string" for c in CLASHING)]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def stage(name, rows):
        found = corpus_pipeline.materialize(dict(corpus_pipeline.STAGES)[name](spark, rows, str(tmp_path)), name)
        assert name == "packing" or found.dtypes == docs.dtypes
        return found, Counter(found.collect())

    before = Counter(docs.collect())
    now, after = stage("quality", docs)  # no labels: all score 0.5 and stay
    assert after == before
    now, after = stage("near_dedup", now)
    assert after <= before and sorted((r.doc_id or 0, len(r.text or "")) for r in after.elements()) == [(0, 3), (1, 0), (2, 0), (3, 15), (3, 37), (4, 45_000)]
    before = after
    now, after = stage("secrets", now)
    assert sum(after.values()) == 6 and [r.text for r in after if "SECRET" in (r.text or "")] == ["[SECRET] of another text"]
    assert {r.copies for r in after} == {r.copies for r in before}
    before = after
    now, after = stage("mixing", now)
    assert set(after) <= set(before) and {r for r in before if not (r.text or "").split()} <= set(after)
    found, pieces = stage("packing", now)
    assert sum(r.start == 0 for r in pieces.elements()) == sum(after.values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == found.columns and Counter(r.doc_id for r in whole.collect() if r.start == 0) == Counter(r.doc_id for r in after.elements())


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
