"""Tree merge of digest runs against plain Python."""

import hashlib
from collections import defaultdict

import pytest

from loomgraph.llm.exact import drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string"


def plain(rows, best=max):
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        group = ids[text or ""]
        known = [x for x in group if x is not None]
        keep = best(known) if known else None
        out.append((doc_id, keep, len(group), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("fan", "run_rows"), [(2, 3), (8, 5), (8, 65_536)])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_classes_equal_plain_grouping(spark, fan, run_rows, keep):
    """A third of the rows is one text; others come once, twice or often, in upper and lower case, with blanks at the ends."""
    rows = [(i * 7 % 1009 - 300, "hot" if i % 3 == 0 else f"text {i % 90} {'é' * (i % 5)}") for i in range(600)]
    rows += [(5000, "Hot"), (5001, "hot "), (5002, ""), (5003, None), (-(1 << 63), "edge"), ((1 << 63) - 1, "edge"), (5004, "x" * 3_000_000), (5005, "x" * 3_000_000)]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(7), keep=keep, fan=fan, run_rows=run_rows)
    assert found(got) == plain(rows, max if keep == "largest" else min)
    kept = [(r.doc_id, r.keep_id) for r in got.filter("kept").collect()]
    assert all(a == b for a, b in kept) and len(kept) == len({t or "" for _, t in rows})


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", run long, digest string")
    got = exact_duplicates(docs)
    assert found(got) == plain(rows)
    assert sorted((r.text_sha256[:4], r.doc_id) for r in got.filter("kept").collect()) == sorted([(hashlib.sha256(t.encode()).hexdigest()[:4], i) for t, i in (("a", 1), ("b", None), ("", 2))], key=str)
    assert exact_duplicates(docs.limit(0)).count() == 0
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(1, "a"), (None, "b"), (2, None)]))
    with pytest.raises(ValueError, match="power"):
        exact_duplicates(docs, fan=6)


def test_no_python_in_the_plan(spark):
    plan = exact_duplicates(spark.createDataFrame([(1, "a")], SCHEMA))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
