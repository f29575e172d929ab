"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and an equi-join, so no task holds a component
and the driver sees one number a round. A hub is a minimum after the first
step; partial aggregation keeps its group small, and AQE may split its join.
The rounds end when every edge leads from a node to the smallest of its
component, which one count over the nodes tells without another round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, materialize, temporary


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, and so is the result. Point each neighbour (larger ones if ``large``, else smaller ones and u) at the smallest."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        out = edges.join(least, "u").select(F.inline(ends))
    return out.filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` has one edge down and none up, or only edges up."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.agg(F.count(F.when(F.col("down") + F.least("down", "up") > 1, 1))).first()[0] == 0


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable.

    Rows with a null end are ignored. Raises if ``most_rounds`` do not suffice (a bound on
    rounds that grow with the logarithm of the longest path, not on the result).
    """
    spark = edges.sparkSession
    with temporary(spark):
        now = materialize(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
        rounds = 0
        while not _settled(now):
            if rounds == most_rounds:
                raise RuntimeError("components did not settle")
            before, now, rounds = now, materialize(_stars(_stars(now, True), False), "edges"), rounds + 1
            drop(before)
        stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return materialize(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components", keep=True)
