"""Mixing sources to target weights by soft memberships (operator 5).

A classifier fitted on a bounded sample of rows that name their domain gives
every document posteriors over the domains. Nonnegative rates for the documents
are then fitted by projected-gradient least squares, so that the expected tokens
of each domain, summed over rate x tokens x posterior, match the targets. A step
needs one sum per domain over all rows; the driver sees these few numbers only.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .labelled import ROW_BYTES, with_texts
from .store import lean, materialize
from .textkit import count_words, slices
from .toxicity import BITS, terms


class DomainModel:
    """Naive Bayes over hashed terms, with a temperature that makes its posteriors soft."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.table = np.zeros((1 << BITS, len(domains)), np.float32)
        self.prior = np.full(len(domains), -np.log(len(domains)))
        self.scale = 0.0

    def means(self, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.domains)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(self.table[at], offsets[full], axis=0) / np.diff(offsets)[full, None]
        return out

    def posteriors(self, offsets: np.ndarray, at: np.ndarray, scale: float | None = None) -> np.ndarray:
        x = self.prior + (self.scale if scale is None else scale) * self.means(offsets, at)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> "DomainModel":
        """Tables from three quarters of the rows; the temperature from the rest, by likelihood."""
        own = np.arange(len(bags)) % 4 != 3 if len(bags) >= 40 else np.ones(len(bags), bool)
        counts = np.stack([np.bincount(np.concatenate([np.zeros(0, np.int32), *(b for b, k, t in zip(bags, y, own, strict=True) if k == d and t)]).astype(np.int64), minlength=1 << BITS) for d in range(len(self.domains))], axis=1) + 0.5
        table = np.log(counts / counts.sum(axis=0))
        self.table = (table - table.mean(axis=1, keepdims=True)).astype(np.float32)
        self.prior = np.log((np.bincount(y, minlength=len(self.domains)) + 1) / (len(y) + len(self.domains)))
        rest = [(b, k) for b, k, t in zip(bags, y, own, strict=True) if not t] or list(zip(bags, y, strict=True))
        offsets, at = np.concatenate([[0], np.cumsum([len(b) for b, _ in rest])]), np.concatenate([b for b, _ in rest])
        truth = np.array([k for _, k in rest])
        self.scale = max((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=lambda s: np.log(self.posteriors(offsets, at, s)[np.arange(len(truth)), truth] + 1e-9).sum())
        return self


def fit_domains(docs: DataFrame, domain: str, domains: list[str], most_rows: int) -> DomainModel:
    """Fit on at most ``most_rows`` documents whose ``domain`` is one of ``domains``, picked by a hash of doc_id: one row of
    each doc_id, the least domain and text; those of over ROW_BYTES of terms are left out of the fit."""

    def run(batches):
        for batch in batches:
            ids, ys, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for first, offsets, at in terms(batch.column(1)):
                out += [(ids[first + i], ys[first + i], at[offsets[i] : offsets[i + 1]].tobytes()) for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.binary())], names=["doc_id", "y", "x"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(domains))
    picked = named.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    found = with_texts(docs, picked).mapInArrow(lean(run), "doc_id long, y string, x binary").filter(F.octet_length("x") <= ROW_BYTES)
    rows = sorted(found.collect(), key=lambda r: (r.doc_id, r.x))
    model = DomainModel(domains)
    return model.fit([np.frombuffer(r.x, np.int32) for r in rows], np.array([domains.index(r.y) for r in rows])) if rows else model


def fit_rates(docs: DataFrame, keep: list[str], targets: Mapping[str, float], domain: str, most_rows: int, rounds: int, tolerance: float) -> DataFrame:
    """The columns ``keep`` of ``docs`` by place (_mix_0, _mix_1, ...), then _mix_n, _mix_p (posteriors), _mix_w (rate), _mix_c (copies)."""
    domains = sorted(targets)
    weights = np.array([float(targets[d]) for d in domains])
    if not domains or weights.min() < 0 or weights.sum() <= 0:
        raise ValueError("targets must be nonnegative, and not all zero")
    weights /= weights.sum()
    model = fit_domains(docs, domain, domains, most_rows)
    at, at_id, width = {c: f"_mix_{k}" for k, c in enumerate(docs.columns)}, keep.index("doc_id"), len(keep)
    own = docs.toDF(*at.values()).select(*(F.col(at[c]).alias(f"_mix_{k}") for k, c in enumerate(keep)), F.col(at["text"]).cast("string").alias("_mix_text"))
    names = [*own.columns[:width], "_mix_n", "_mix_p"]

    def run(batches):
        for batch in batches:
            column, n = batch.column(width), batch.num_rows
            tokens, p = np.zeros(n, np.int64), np.zeros((n, len(domains)))
            for first, last, data, offsets in slices(column):
                tokens[first:last] = count_words(data, offsets)
            for first, offsets, at in terms(column):
                p[first : first + len(offsets) - 1] = model.posteriors(offsets, at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(tokens), pa.array(list(p), pa.list_(pa.float64()))], names=names)

    schema = StructType([*own.schema.fields[:width], StructField("_mix_n", LongType()), StructField("_mix_p", ArrayType(DoubleType()))])
    measured = materialize(own.mapInArrow(lean(run), schema), "measured")

    p = [F.col("_mix_p")[d] for d in range(len(domains))]
    n = F.col("_mix_n")
    gram = measured.agg(*(F.sum(n * p[a] * p[b]) for a in range(len(domains)) for b in range(a, len(domains))), F.sum(n)).first()
    total = float(gram[-1] or 0)
    steps: list[np.ndarray] = []
    if total > 0:
        square, it = np.zeros((len(domains), len(domains))), iter(gram)
        for a in range(len(domains)):
            for b in range(a, len(domains)):
                square[a, b] = square[b, a] = next(it) / total
        scaled = np.linalg.inv(square + 1e-9 * np.eye(len(domains)))  # the gradient in the metric of the memberships

    def rate():
        w = F.lit(1.0)
        for step in steps:
            w = F.greatest(F.lit(0.0), w - sum(p[d] * float(step[d]) for d in range(len(domains))))
        return F.when(n > 0, w).otherwise(1.0)

    far = 0.0
    for turn in range(rounds + 1 if total > 0 else 0):
        reached = np.array([float(x or 0) for x in measured.agg(*(F.sum(rate() * n * p[d]) for d in range(len(domains)))).first()]) / total
        far = float(np.abs(reached - weights).sum())
        if far < tolerance or turn == rounds:
            break
        steps.append(scaled @ (reached - weights))
    if far >= tolerance:
        shares = {d: round(float(x), 4) for d, x in zip(domains, reached, strict=True)}
        warnings.warn(f"domain targets not reached in {rounds} rounds: {shares} of the tokens, {far:.4f} from the targets in sum", stacklevel=3)
    unit = F.pmod(F.xxhash64(f"_mix_{at_id}", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    return measured.withColumn("_mix_w", rate()).withColumn("_mix_c", F.floor(F.col("_mix_w") + unit).cast("int"))


def mix_domains(docs: DataFrame, targets: Mapping[str, float], *, domain: str = "lang", most_rows: int = 4000, rounds: int = 40, tolerance: float = 1e-4) -> DataFrame:
    """One row per row: doc_id, n_tokens, domain, posterior, rate, copies.

    docs: doc_id, text and ``domain``; other columns are not read. targets: nonnegative weights of the domains; their
    shares of all tokens (words) are matched in expectation. ``copies`` is the rate rounded up or down by a hash of doc_id,
    so that totals are kept on average; rows that repeat a doc_id are rounded alike. A text without words has no tokens and
    keeps rate 1. A row without a domain is placed by its text; without any labelled rows the posteriors are the targets'
    number's share. Of equal posteriors the domain first by name is told. Raises for empty or zero targets; warns with the
    shares that are reached where ``rounds`` do not bring them within ``tolerance`` (a domain without texts).
    """
    fitted = fit_rates(docs.select("doc_id", "text", domain), ["doc_id"], targets, domain, most_rows, rounds, tolerance)
    best = F.array_position("_mix_p", F.array_max("_mix_p")).cast("int")
    return fitted.select(F.col("_mix_0").alias("doc_id"), F.col("_mix_n").alias("n_tokens"), F.element_at(F.array(*map(F.lit, sorted(targets))), best).alias("domain"), F.array_max("_mix_p").alias("posterior"), F.col("_mix_w").alias("rate"), F.col("_mix_c").alias("copies"))


def resample_domains(docs: DataFrame, targets: Mapping[str, float], *, domain: str = "lang", most_rows: int = 4000, rounds: int = 40, tolerance: float = 1e-4) -> DataFrame:
    """``docs`` with each row as often as ``mix_domains`` gives it copies (none for 0); columns of any names stay as they are."""
    fitted = fit_rates(docs, docs.columns, targets, domain, most_rows, rounds, tolerance).filter("_mix_c > 0")
    own = [f"_mix_{k}" for k in range(len(docs.columns))]
    return fitted.withColumn("_mix_k", F.explode(F.sequence(F.lit(1), F.col("_mix_c")))).select(*own).toDF(*docs.columns)
