"""Exact top-k inner-product search by three-phase uniform thresholds (operator 10).

Each vector is quantised; its components are dealt into ``lists`` segments, and
a segment's partial inner products are one local score list of a query. Queries
come in bounded blocks that are sent to all tasks; candidates stay in place.

Phase 1 gathers: a share of the candidates, picked by a hash, gives its best exact
scores, and the k-th best of all is a safe cutoff: the true k-th score can't be
below it. Phase 2: with the cutoffs sent back, all candidates are read list by
list. A score of the cutoff needs cutoff / lists in some list, so what can't reach
the cutoff any more (what its lists have so far, plus the most that the norms of
its other segments allow) is left out. Phase 3: for the entries that remain, the
remaining lists are read too, so their scores are exact. A task keeps the k best
of each query, and its k-th best raises the cutoff while it goes on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

FLOOR = np.iinfo(np.int64).min


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def exact_kind(q: np.ndarray, c: np.ndarray):
    """A number type in which the inner products and all their parts are exact; 64-bit integers wrap around."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


class Best:
    """The ``k`` best (score, then smaller id) of each of ``n`` queries, from pairs in any order."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.cutoff = n, k, np.full(n, FLOOR)
        self.found = [np.zeros(0, np.int64)] * 3

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(self.found, (query, ids, score), strict=True))
        order = np.lexsort((ids, -score, query))  # no score is the least integer: it would be a wrapped sum
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.cutoff[query[last]] = np.maximum(self.cutoff[query[last]], score[last])
        keep = place < self.k
        self.found = [query[keep], ids[keep], score[keep]]


def reach(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, cutoff: np.ndarray, lists: int, tally: list[int] | None = None):
    """(query row, candidate row, exact score) of all pairs, but of a query with itself, that reach their query's cutoff.

    ``tally`` counts the products of components that were made.
    """
    kind = exact_kind(q, c)
    own = q_ids[:, None] == c_ids[None, :]
    if kind is np.int64:  # sums may wrap around, so norms say nothing
        score = q @ c.T
        row, col = np.nonzero(~own & (score >= cutoff[:, None]))
        return row, col, score[row, col]
    parts = np.array_split(np.arange(q.shape[1]), min(lists, max(q.shape[1], 1)))
    rest_q = np.stack([np.sqrt((q[:, s].astype(np.float64) ** 2).sum(axis=1)) for s in parts])
    rest_c = np.stack([np.sqrt((c[:, s].astype(np.float64) ** 2).sum(axis=1)) for s in parts])
    floor = np.maximum(cutoff, -(2**60)).astype(np.float64)
    known, row = np.zeros((len(q), len(c)), kind), None
    for i, s in enumerate(parts):
        if row is None:
            known += q[:, s].astype(kind) @ c[:, s].astype(kind).T
            made = known.size * len(s)
            bound = (rest_q[i + 1 :].T @ rest_c[i + 1 :]) * (1 + 1e-9) + 0.5 if i + 1 < len(parts) else 0
            may = (known + bound >= floor[:, None]) & ~own
            if i + 1 == len(parts) or np.count_nonzero(may) * 8 < may.size:
                row, col = np.nonzero(may)
                score = known[row, col].astype(np.float64)
        else:
            made = len(row) * len(s)
            for at in range(0, len(row), 16384):
                here = slice(at, at + 16384)
                score[here] += (q[row[here]][:, s].astype(np.float64) * c[col[here]][:, s]).sum(axis=1)
            bound = sum((rest_q[k, row] * rest_c[k, col] for k in range(i + 1, len(parts))), np.zeros(len(row))) * (1 + 1e-9)
            may = score + bound + 0.5 * (i + 1 < len(parts)) >= floor[row]
            row, col, score = row[may], col[may], score[may]
        if tally is not None:
            tally.append(made)
    return row, col, score.astype(np.int64)


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, lists: int = 8, gather: int = 32, query_block: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest scores, ties to the smaller vec_id.

    vectors: vec_id and embedding; other columns are not read. Queries are the rows whose vec_id is divisible by
    ``every``. A query meets the vectors of its own length but its own row. Rows with null vec_id, or with an embedding
    that is null or holds null or non-finite components, take no part; of rows that repeat a vec_id the least
    embedding counts, so repeated rows are one. A query without candidates gives no row. Sums beyond 64 bits wrap around.
    One in ``gather`` candidates takes part in phase 1; all take part in phases 2 and 3. A block of queries has about
    ``query_block`` rows, and 64 MB at most; there is a round of both phases for each block.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null").filter(finite)
    valid = valid.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    quantised = materialize(valid.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(x * scale)).alias("v")), "quantised")
    queries = quantised.filter(F.col("vec_id") % every == 0)
    n_queries, longest = queries.agg(F.count("*"), F.max("dim")).first()
    blocks = max(1, -(-(n_queries or 0) // max(1, min(query_block, (1 << 26) // (8 * max(longest or 1, 1))))))
    share = F.pmod(F.xxhash64("vec_id", F.lit("gather")), F.lit(gather)) == 0
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def search(candidates: DataFrame, asked: dict, cutoffs: dict) -> DataFrame:
        """The k best of each task, for each query of ``asked``: dim -> (ids, vectors, order of the components, the heaviest
        first, so that early lists tell most); cutoffs by dim in the order of the ids."""

        def run(batches):
            best = {dim: Best(len(ids), k) for dim, (ids, *_) in asked.items()}
            for dim, x in best.items():
                x.cutoff = cutoffs[dim].copy()
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim not in asked:
                        continue
                    at = np.flatnonzero(dims == dim)
                    ids, v = batch.column(0).to_numpy()[at], matrix(batch.column(2).take(pa.array(at)))
                    q_ids, q, order = asked[dim]
                    v = v[:, order]
                    step = max(1, 4_000_000 // max(len(ids), 1))
                    for i in range(0, len(q), step):
                        row, col, score = reach(q[i : i + step], q_ids[i : i + step], v, ids, best[dim].cutoff[i : i + step], lists)
                        if len(row):
                            best[dim].add(i + row, ids[col], score)
            for dim, x in best.items():
                row, ids, score = x.found
                yield pa.RecordBatch.from_arrays([pa.array(asked[dim][0][row]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

        return candidates.select("vec_id", "dim", "v").mapInArrow(run, "query_id long, vec_id long, score long")

    results = []
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks)) == block).toArrow().combine_chunks()
        dims, asked = rows["dim"].to_numpy(), {}
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            q = matrix(rows["v"].take(pa.array(at)))
            order = np.argsort(-(q.astype(np.float64) ** 2).sum(axis=0), kind="stable")
            asked[dim] = rows["vec_id"].to_numpy()[at], q[:, order], order
        none = {dim: np.full(len(ids), FLOOR) for dim, (ids, *_) in asked.items()}
        gathered = search(quantised.filter(share), asked, none).withColumn("rank", rank).filter(F.col("rank") == k)
        safe = {r.query_id: r.score for r in gathered.collect()}  # a row for each query of the block at most
        cutoffs = {dim: np.array([safe.get(i, FLOOR) for i in ids.tolist()], np.int64) for dim, (ids, *_) in asked.items()}
        found = search(quantised, asked, cutoffs).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(found if blocks == 1 else materialize(found, "found"))
    if blocks == 1:
        return results[0]
    return vectors.sparkSession.read.schema(results[0].schema).parquet(*(x.written_to for x in results))
