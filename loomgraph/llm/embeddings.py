"""Near-duplicate embeddings by a pivot-permutation index (operator 2).

A vector is described by its nearest reference points, in order of nearness. The
first of them, its posts, have inverted lists that hold it. Vectors of one list
are compared by the number of points that their descriptions share; those that
share enough are candidates, and their cosine decides. A pair is taken up in the
first list that it shares, so links are counted once and never given as rows.

Reference points are fitted on a bounded sample, about four times the square root
of the number of vectors, so lists grow with that root too; no two of them lie
within twice the link angle, so a dense group has few and its members share them.
Every vector is indexed. Equal vectors of one label are one class, which counts
as often as it has members. Long lists are cut into blocks that meet pairwise.

Recall, measured: random pairs at a cosine of 0.98 exactly, in 16 to 768
dimensions with 64 to 4,096 points, are found with a probability of 0.998 or more
(see the README); the tests hold it at 0.9 or more on harder tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import arrow_rows, materialize
from .topk import matrix


def apart(x: np.ndarray, most: float, count: int, block: int = 256) -> np.ndarray:
    """The first ``count`` rows of x (unit vectors), taken in order, whose cosine to each row taken before is under ``most``."""
    taken: list[np.ndarray] = []
    for start in range(0, len(x), block):
        rows = x[start : start + block]
        free = np.ones(len(rows), bool)
        for before in taken:
            free &= (rows @ before.T).max(axis=1) < most
        own = rows @ rows.T
        for i in range(len(rows)):
            free[i] = free[i] and not (own[i, :i][free[:i]] >= most).any()
        taken.append(rows[free])
        taken = [t for t in taken if len(t)]
        if sum(map(len, taken)) >= count:
            break
    return np.concatenate(taken)[:count] if taken else x[:0]


def shared_points(order: np.ndarray, a: np.ndarray, b: np.ndarray, posts: int, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of rows of ``a`` and ``b``: how many points their descriptions share, and whether a list before that of ``pivot`` has both."""
    points, at = np.unique(order, return_inverse=True)
    at = at.reshape(order.shape)
    if len(a) * len(b) * len(points) < 20_000_000:
        has = np.zeros((len(order), len(points)), np.float32)
        has[np.arange(len(order))[:, None], at] = 1
        early = np.zeros_like(has)
        early[np.arange(len(order))[:, None], at[:, :posts]] = 1
        early[:, points >= pivot] = 0
        return (has[a] @ has[b].T).astype(np.uint8), early[a] @ early[b].T > 0
    count, before = np.zeros((len(a), len(b)), np.uint8), np.zeros((len(a), len(b)), bool)
    sides = []
    for rows in (a, b):
        flat = at[rows].ravel()
        by = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by], np.arange(len(points) + 1))
        sides.append((by // order.shape[1], by % order.shape[1] < posts, cuts))
    for k, point in enumerate(points):
        (p, p_post, p_cut), (q, q_post, q_cut) = sides
        p, p_post, q, q_post = p[p_cut[k] : p_cut[k + 1]], p_post[p_cut[k] : p_cut[k + 1]], q[q_cut[k] : q_cut[k + 1]], q_post[q_cut[k] : q_cut[k + 1]]
        count[np.ix_(p, q)] += 1
        if point < pivot:
            before[np.ix_(p[p_post], q[q_post])] = True
    return count, before


def near_embeddings(vectors: DataFrame, *, least: float = 0.98, most_pivots: int = 32_768, nearest: int = 8, posts: int = 6, shared: int = 2, block: int = 2048) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding, label; other columns are not read. Vectors of one label and length link at a cosine of
    ``least`` or more, in double precision. Rows with null vec_id or label, or an embedding that is null, empty, zero,
    or holds null or non-finite components, link with nothing; their component is their own vec_id. A row that repeats as
    it stands is one vector, returned as often; different vectors of one vec_id (or label) count as several, each with its
    own links. ``most_pivots`` bounds the reference points, and four times as many vectors (128 MB at most), picked by a
    hash, are looked at to find them; the points, not the lists, are sent to every task. Vectors of any length are compared
    whole; a task holds those of two blocks at a time. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    classes = rows.filter("fit").distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("dim", F.size("embedding")).withColumn("id", F.monotonically_increasing_id()), "classes")

    total, longest = classes.agg(F.count("*"), F.max("dim")).first()
    pivots = min(most_pivots, max(64, math.ceil(4 * math.sqrt(total))))
    wanted = min(4 * pivots, (1 << 27) // (8 * (longest or 1)))
    place = F.pmod(F.xxhash64("low", "id"), F.lit(1 << 30))
    sample = classes.filter(place < math.ceil(min(1.0, wanted / max(total, 1)) * (1 << 30))).select("dim", "embedding", place.alias("place")).toArrow().sort_by("place").combine_chunks()
    dims, points = sample["dim"].to_numpy(), {}
    for dim in np.unique(dims).tolist():
        x = matrix(sample["embedding"].take(pa.array(np.flatnonzero(dims == dim))), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        points[dim] = apart(x, max(math.cos(2 * math.acos(min(1.0, max(0.5, least)))), 0.5), pivots)

    def describe(batches):
        for batch in batches:
            dims, out = batch.column(1).to_numpy(), [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in points:  # a length that the sample lacks: one list
                    for i in at:
                        out[i] = [-1]
                    continue
                each = max(16, min(1024, (1 << 22) // len(points[dim])))  # rows times points held at once
                for part in np.array_split(at, -(-len(at) // each)):
                    x = matrix(batch.column(0).take(pa.array(part)), np.float64)
                    near = -(x @ points[dim].T) / np.linalg.norm(x, axis=1, keepdims=True)
                    if near.shape[1] > nearest:
                        first = np.argpartition(near, nearest, axis=1)[:, :nearest]
                        near = np.take_along_axis(first, np.argsort(np.take_along_axis(near, first, axis=1), axis=1, kind="stable"), axis=1)
                    else:
                        near = np.argsort(near, axis=1, kind="stable")
                    for i, found in zip(part, near, strict=True):
                        out[i] = found.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(out, pa.list_(pa.int32()))], names=["embedding", "dim", "label", "id", "copies", "order"])

    kinds = dict(classes.dtypes)
    described = classes.select("embedding", "dim", "label", "id", "copies").mapInArrow(describe, f"embedding {kinds['embedding']}, dim int, label {kinds['label']}, id long, copies long, order array<int>")
    described = materialize(described, "described")
    lists = described.withColumn("pivot", F.explode(F.slice("order", 1, posts)))
    lengths = lists.groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")).filter("n > 1").withColumn("n", F.ceil(F.col("n") / block).cast("int"))
    salted = lists.join(lengths, ["label", "dim", "pivot"]).withColumn("side", F.pmod(F.xxhash64("id", F.lit("side")), F.col("n")).cast("int"))
    salted = salted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("label", "dim", "pivot", "id", "copies", "embedding", "order", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))

    def links(table: pa.Table) -> pa.Table:
        ids, copies, side = (table[k].to_numpy() for k in ("id", "copies", "side"))
        order, pivot, n, i, j = matrix(table["order"]), table["pivot"][0].as_py(), table.num_rows, table["i"][0].as_py(), table["j"][0].as_py()
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        count, before = shared_points(order, a, b, posts, pivot)
        may = (count >= min(shared, order.shape[1])) & ~before
        if i == j:
            may = np.triu(may, 1)
        x = matrix(table["embedding"], np.float64)
        norm = np.linalg.norm(x, axis=1)
        n_links, label = np.zeros(n, np.int64), np.arange(n)
        for s in range(0, len(a), 512):
            p, q = np.nonzero(may[s : s + 512])
            p, q = a[s + p], b[q]
            if 20 * len(p) > 512 * len(b):  # dense: all cosines at once
                cosines = (x[a[s : s + 512]] @ x[b].T) / (norm[a[s : s + 512], None] * norm[None, b])
                linked = cosines[may[s : s + 512]] >= least
            else:
                linked = np.concatenate([np.zeros(0, bool), *((x[p[k : k + 8192]] * x[q[k : k + 8192]]).sum(axis=1) / (norm[p[k : k + 8192]] * norm[q[k : k + 8192]]) >= least for k in range(0, len(p), 8192))])
            p, q = p[linked], q[linked]
            n_links += np.bincount(p, copies[q], n).astype(np.int64) + np.bincount(q, copies[p], n).astype(np.int64)
            while len(p):
                low = label.copy()
                np.minimum.at(low, p, label[q])
                np.minimum.at(low, q, label[p])
                np.minimum.at(low, label, low.copy())
                low = low[low]
                if (low == label).all():
                    break
                label = low
        some = n_links > 0
        return pa.table({"id": ids[some], "n": n_links[some], "root": ids[label[some]]})

    with arrow_rows(spark, 5000):
        found = materialize(salted.groupBy("label", "dim", "pivot", "i", "j").applyInArrow(links, "id long, n long, root long"), "links")
    parts = connected_components(found, "id", "root").withColumnRenamed("node", "id").join(classes.select("id", "low"), "id")
    parts = parts.join(parts.groupBy("component").agg(F.min("low").alias("least")), "component").select("id", "least")
    counted = classes.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(parts, "id", "left")
    counted = counted.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "low").alias("component"))
    out = rows.join(counted, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("fit"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
