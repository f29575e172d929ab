"""Toxicity by a factorization machine over hashed terms (operator 6).

Terms are words and their openings of four, five and six bytes (stems of
inflected insults), hashed into a fixed number of buckets and counted as present
or not. Each bucket has a weight and a short vector; a document's score adds
the weights and the inner products of all pairs of its terms' vectors, so an
insult beside a mention of a group can weigh more than the two apart.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import ROW_BYTES, folds, sample_labels, with_texts
from .quality import sigmoid
from .textkit import LOWER, U, hash_spans, mix, parts, slices, words

BITS = 18
_APART = ~np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row and bucket of each term in one number, sorted and distinct."""
    data = LOWER[data]
    starts, stops, of = words(data, offsets, _APART)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(of)).astype(U)
    h = hash_spans(data, starts, stops)
    _, kept = np.unique(mix(h ^ mix(doc + U(1))), return_index=True)  # one of each word and row
    starts, stops, doc, h = starts[kept], stops[kept], doc[kept], h[kept]
    keys = [doc << U(BITS) | h >> U(64 - BITS)]
    for size in (4, 5, 6):
        long_ = stops - starts > size
        opening = mix(hash_spans(data, starts[long_], starts[long_] + size) + U(size))
        keys.append(doc[long_] << U(BITS) | opening >> U(64 - BITS))
    return np.unique(np.concatenate(keys))


def terms(column: pa.Array, most: int = 1 << 20):
    """(first row, offsets by row, distinct sorted buckets of each row) for runs of rows; long texts are read part by part."""
    for first, last, data, offsets in slices(column, most):
        if len(data) > 2 * most and last == first + 1:
            keys = np.zeros(0, U)
            for a, b in parts(data, most, _APART):
                keys = np.union1d(keys, _keys(data[a:b], np.array([0, b - a])))
        else:
            keys = _keys(data, offsets)
        yield first, np.searchsorted(keys, np.arange(last - first + 1, dtype=U) << U(BITS)), (keys & U((1 << BITS) - 1)).astype(np.int32)


class Pairs:
    """Which of ``terms`` are part of a pair whose joint presence goes with the residuals of the documents.

    For terms i and j the sum of r (x_i - p_i)(x_j - p_j) over documents is held against its standard deviation. Both follow
    from sums over documents that hold both or either, so only these are read: for each term the terms before it in its documents.
    With the commonest terms first, a pair is so met from its rarer side.
    """

    def __init__(self, bags: list[np.ndarray], residual: np.ndarray, terms: np.ndarray, least: float):
        slot = np.full(1 << BITS, -1, np.int32)
        slot[terms] = np.arange(len(terms), dtype=np.int32)
        own = [np.sort(x[x >= 0]) for x in (slot[b] for b in bags)]
        self.index(np.concatenate([*own, np.zeros(0, np.int32)]), np.array([len(x) for x in own], np.int32), residual, len(terms), least)

    def index(self, slots: np.ndarray, sizes: np.ndarray, residual: np.ndarray, n: int, least: float) -> None:
        self.slots, self.r, self.least = slots, residual, least
        self.ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.at = np.argsort(slots, kind="stable")
        self.docs, self.starts = doc[self.at], np.searchsorted(slots[self.at], np.arange(n + 1))
        self.p = np.diff(self.starts) / max(len(sizes), 1)
        self.s, self.q = (np.bincount(slots, w[doc], n) for w in (residual, residual**2))

    def __getstate__(self) -> tuple:
        """What a task needs to build the rest: some two bytes for each term of a document."""
        steps = zlib.compress(np.diff(self.slots, prepend=np.int32(0)).astype("<i4").tobytes(), 1)
        return steps, np.diff(self.ends).astype(np.int32), self.r, len(self.p), self.least

    def __setstate__(self, state: tuple) -> None:
        steps, *rest = state
        self.index(np.cumsum(np.frombuffer(zlib.decompress(steps), "<i4"), dtype=np.int32), *rest)

    def strong(self, first: int, last: int) -> list[int]:
        """The terms of all strong pairs whose later term is one from ``first`` to ``last``."""
        found, total, squares = set(), float((self.r**2).sum()), self.r**2
        a, b = 1 - 2 * self.p, self.p**2
        for i in range(max(first, 1), last):
            docs = self.docs[self.starts[i] : self.starts[i + 1]]
            begin = self.ends[docs]
            size = self.at[self.starts[i] : self.starts[i + 1]] - begin
            cut = np.cumsum(size) - size
            at = self.slots[np.repeat(begin - cut, size) + np.arange(int(size.sum()))]
            together = np.bincount(at, np.repeat(self.r[docs], size), i) - self.p[i] * self.s[:i] - self.p[:i] * self.s[i]
            spread = a[i] * (a[:i] * np.bincount(at, np.repeat(squares[docs], size), i) + b[:i] * self.q[i]) + b[i] * (a[:i] * self.q[:i] + b[:i] * total)
            strong = np.flatnonzero(np.abs(together) >= self.least * (np.sqrt(np.maximum(spread, 0)) + 1e-6))
            if len(strong):
                found.update([i, *strong.tolist()])
        return sorted(found)


class FactorizationMachine:
    """Weights and vectors of hashed terms, fitted by AdaGrad on the logistic loss."""

    def __init__(self, factors: int = 6, seed: int = 5):
        self.seed, self.bias = seed, 0.0
        self.weight = np.zeros(1 << BITS, np.float32)
        self.vector = np.zeros((1 << BITS, factors), np.float32)

    def logits(self, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; a row without terms has the bias alone."""
        out = np.full(len(offsets) - 1, self.bias, np.float64)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            cut, v = offsets[full], self.vector[at]
            s = np.add.reduceat(v, cut, axis=0)
            out[full] += np.add.reduceat(self.weight[at], cut) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), cut))
        return out

    def fit(self, bags: list[np.ndarray], y: np.ndarray, *, least_docs: int = 3, least_z: float = 3.5, least_pair_z: float = 6.0, least_pair_share: float = 0.01, epochs: int = 8, run=None) -> "FactorizationMachine":
        """bags: buckets of each document. run: what applies a function to ranges of terms (in this process by default).

        There are far more terms than labels, so most terms are noise. Buckets of at least ``least_docs`` documents are
        used whose share of documents differs between the labels by ``least_z`` standard errors; and then those that tell
        something in pairs only: of all pairs of buckets that each stand in ``least_pair_share`` of the documents, those whose joint
        presence goes with what the first fit leaves unexplained, by ``least_pair_z`` standard errors.
        """
        n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
        ones, both = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for b, label in zip(bags, y, strict=True):
            both[b] += 1
            ones[b] += label
        share = np.clip(both / (n1 + n0), 1e-9, 1 - 1e-9)
        z = (ones / n1 - (both - ones) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
        known = (both >= least_docs) & (np.abs(z) >= least_z)
        self.descend(bags, y, known, epochs=epochs)
        frequent = np.flatnonzero(both >= max(least_docs, least_pair_share * len(bags)))
        frequent = frequent[np.argsort(-both[frequent], kind="stable")]
        pairs = Pairs(bags, self.residuals(bags, y), frequent, least_pair_z)
        strong = (run or (lambda f, n: f(0, n)))(pairs.strong, len(frequent))
        paired = frequent[np.asarray(sorted(set(strong)), np.int64)]
        if not known[paired].all():
            known[paired] = True
            self.descend(bags, y, known, epochs=4 * epochs, spread=0.1)
        return self

    def residuals(self, bags: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """What the scores leave unexplained, around its mean."""
        residual = y.astype(np.float64)
        for start in range(0, len(bags), 1024):
            own = bags[start : start + 1024]
            residual[start : start + 1024] -= sigmoid(self.logits(np.concatenate([[0], np.cumsum([len(b) for b in own])]), np.concatenate(own)))
        return residual - residual.mean()

    def descend(self, bags: list[np.ndarray], y: np.ndarray, known: np.ndarray, *, epochs: int, batch: int = 64, rate: float = 0.1, decay: float = 2e-5, spread: float = 0.01) -> None:
        """Fit anew on the ``known`` buckets; all others keep zero weights."""
        rng = np.random.default_rng(self.seed)
        bags = [b[known[b]] for b in bags]
        self.weight[:], self.vector[:] = 0, 0
        self.vector[known] = rng.normal(0, spread, (int(known.sum()), self.vector.shape[1]))
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        seen_w, seen_v = np.full(1 << BITS, 0.1, np.float32), np.full(self.vector.shape, 0.1, np.float32)
        up = min(2.0, (1 - y.mean()) / max(y.mean(), 1e-3)) if y.any() else 1.0
        for _ in range(epochs):
            for i in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
                own = [bags[k] for k in i]
                size = np.array([len(b) for b in own])
                at, row = np.concatenate(own), np.repeat(np.arange(len(i)), size)
                d = (sigmoid(self.logits(np.concatenate([[0], np.cumsum(size)]), at)) - y[i]) * np.where(y[i] > 0, up, 1.0)
                self.bias -= 0.05 * float(d.mean())
                v = self.vector[at]
                s = np.zeros((len(i), v.shape[1]), np.float32)
                np.add.at(s, row, v)
                each = d[row].astype(np.float32) / len(i)
                here, back = np.unique(at, return_inverse=True)
                gw = np.bincount(back, each, len(here)).astype(np.float32) + decay * self.weight[here]
                gv = np.stack([np.bincount(back, each * (s[row, f] - v[:, f]), len(here)) for f in range(v.shape[1])], axis=1).astype(np.float32) + 10 * decay * self.vector[here]
                seen_w[here] += gw * gw * 100
                seen_v[here] += gv * gv * 100
                self.weight[here] -= rate * gw * 10 / np.sqrt(seen_w[here])
                self.vector[here] -= rate * gv / np.sqrt(seen_v[here])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, most_rows: int = 16_000, label: str = "toxic") -> FactorizationMachine:
    """Fit on at most ``most_rows`` labelled documents outside the held-out fold; executors send their buckets only.

    Documents of over ROW_BYTES of buckets are left out of the fit (not of the scores), so its memory is bounded.
    """

    def run(batches):
        for batch in batches:
            ids, ys, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for first, offsets, at in terms(batch.column(1)):
                out += [(ids[first + i], ys[first + i], at[offsets[i] : offsets[i + 1]].tobytes()) for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["doc_id", "y", "x"])

    rows = with_texts(docs, sample_labels(labels, label, most_rows)).mapInArrow(run, "doc_id long, y int, x binary").filter(F.octet_length("x") <= ROW_BYTES).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    model = FactorizationMachine()

    def spread(strong, n: int) -> list[int]:
        """The ranges of terms as tasks; what a task needs of the sample goes to the workers once."""
        shared = docs.sparkSession.sparkContext.broadcast(strong)

        def ranges(batches):
            for batch in batches:
                found = [i for k in batch.column(0).to_pylist() for i in shared.value(k, min(n, k + 256))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["id"])

        if not n:
            return []
        tasks = min(-(-n // 256), 4 * docs.sparkSession.sparkContext.defaultParallelism)
        found = docs.sparkSession.range(0, n, 256, tasks).mapInArrow(ranges, "id long").collect()
        shared.destroy()
        return sorted(r.id for r in found)

    return model.fit([np.frombuffer(r.x, np.int32) for r in rows], np.array([float(r.y) for r in rows]), run=spread) if rows else model


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, most_rows: int = 16_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    docs: doc_id and text; other columns are not read. Null and empty texts have no terms and take the score of the
    bias; very long ones are read part by part, and only the distinct buckets of one are held. A null doc_id gives a null held_out. Without labelled rows every score is 0.5. Rows that repeat a doc_id are each
    scored; the fit takes one text of each doc_id, the least, and of several labels the largest.
    """
    model = fit_toxicity(docs, labels, most_rows=most_rows)

    def run(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for first, offsets, at in terms(batch.column(1)):
                score[first : first + len(offsets) - 1] = sigmoid(model.logits(offsets, at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (folds() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
