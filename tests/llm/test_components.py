import random

from pyspark.sql import DataFrame

from loomgraph.llm import components, minhash
from loomgraph.llm.components import connected_components


def parts(spark, rows, **more):
    edges = spark.createDataFrame(rows, "a long, b long")
    return sorted(tuple(r) for r in connected_components(edges, "a", "b", **more).collect())


def test_settled_edges_take_no_round(spark):
    """Stars are seen to be stars without a round that changes nothing; edges may lead either way, repeat, loop or be null."""
    rows = [(1, 2), (3, 1), (1, 3), (5, 5), (None, 7), (8, None), (10, 12), (10, 11)]
    assert parts(spark, rows, most_rounds=0) == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (12, 10)]
    assert parts(spark, [], most_rounds=0) == []


def test_components_of_any_shape(spark):
    rng = random.Random(5)
    rows = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in rng.sample(range(100, 300), 90) if x != 200] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {x: x for r in rows for x in r if r[0] != r[1]}
    for _ in range(len(root)):
        for a, b in rows:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert parts(spark, rows) == sorted(root.items())


def test_later_turns_join_components_only(spark, monkeypatch):
    """A chain of near copies: after the first turn no edge is between documents that are already one component."""
    seen = []

    def watched(edges: DataFrame, a: str, b: str):
        seen.append([tuple(r) for r in edges.select(a, b).collect()])
        return components.connected_components(edges, a, b)

    monkeypatch.setattr(minhash, "connected_components", watched)
    words = [f"w{i}" for i in range(160)]
    docs = spark.createDataFrame([(i, " ".join(words[2 * i : 2 * i + 80])) for i in range(40)], "doc_id long, text string")
    got = minhash.near_duplicates(docs, size=3, percent=85).collect()
    assert {r.component_id for r in got} == {0}
    assert len(seen) == 4
    whole: dict[int, int] = {}
    for edges in seen:
        assert all(whole.get(a, a) == a and whole.get(b, b) == b for a, b in edges)
        for a, b in connected_pairs(edges):
            whole[b] = a


def connected_pairs(edges):
    """(smallest, other) of each component."""
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return [(r, x) for x, r in root.items() if r != x]
