"""Quality classifier by attention-based multiple-instance learning (operator 7).

A document is a bag of passages of a fixed number of words. Each passage is
encoded from its own measures (letter case, punctuation, repeats, word
lengths), gated attention weighs the passages, and the weighted mean decides.
Only document labels are known: the attention learns from them which passages
matter. Fitted on a bounded sample; all documents are scored, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import ROW_BYTES, folds, sample_labels, with_texts
from .store import lean
from .textkit import LOWER, hash_spans, parts, slices, words

FEATURES = 13
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_SYMBOL = ~_LETTER & ~_DIGIT & (_BYTES > 32)
_STOP = np.isin(_BYTES, [ord(c) for c in ".,;:?"])


def measure(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, features): passages of ``size`` words, one at least for each text."""
    starts, stops, of = words(data, offsets)
    rows, n = len(offsets) - 1, len(starts)
    per = np.maximum(-(-np.diff(of) // size), 1)
    base = np.concatenate([[0], np.cumsum(per)])
    bag = np.repeat(np.arange(rows), per)
    x = np.zeros((base[-1], FEATURES), np.float32)
    if not n:
        return bag, x
    doc = np.repeat(np.arange(rows), np.diff(of))
    place = base[doc] + (np.arange(n) - of[doc]) // size
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at = place[cut]
    count = np.diff(np.append(cut, n)).astype(np.float32)
    h = hash_spans(LOWER[data], starts, stops)
    length = (stops - starts).astype(np.float32)
    total = np.add.reduceat(length, cut)

    def share(mask: np.ndarray) -> np.ndarray:
        """Bytes of a kind in each passage, by their words."""
        sums = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return np.add.reduceat((sums[stops] - sums[starts]).astype(np.float32), cut) / total

    same = np.zeros(n, np.float32)
    same[1:] = (h[1:] == h[:-1]) & (place[1:] == place[:-1])
    order = np.lexsort((h, place))
    new = np.ones(n, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (place[order][1:] != place[order][:-1])
    symbol_end = _SYMBOL[data[stops - 1]] & ~_STOP[data[stops - 1]]
    x[at, 0], x[at, 1], x[at, 2], x[at, 3], x[at, 4] = share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_SYMBOL & ~_STOP), share(_LETTER)
    x[at, 5] = np.add.reduceat(same, cut) / count
    x[at, 6] = np.bincount(place[order][new], minlength=len(x))[at] / count
    x[at, 7] = total / count / 10
    x[at, 8] = np.add.reduceat((length <= 3).astype(np.float32), cut) / count
    x[at, 9] = np.add.reduceat(symbol_end.astype(np.float32), cut) / count
    x[at, 10] = np.sqrt(np.maximum(np.add.reduceat(length * length, cut) / count - (total / count) ** 2, 0)) / 10
    x[at, 11] = np.log1p(count) / 5
    x[at, 12] = np.add.reduceat(_STOP[data[stops - 1]].astype(np.float32), cut) / count
    return bag, x


def measure_long(data: np.ndarray, size: int, most: int) -> np.ndarray:
    """The features of one long text, read part by part; a part ends with a whole passage."""
    found, start, step = [], 0, most
    while start < len(data):
        end = start + next(parts(data[start:], step))[1]
        part = data[start:end]
        starts, _, _ = words(part, np.array([0, len(part)]))
        if end < len(data):
            whole = len(starts) // size * size
            if not whole and len(starts):
                step *= 2
                continue
            if whole < len(starts):
                part = part[: starts[whole]]
        if len(starts):
            found.append(measure(part, np.array([0, len(part)]), size)[1])
        start, step = start + len(part), most
    return np.concatenate(found) if found else np.zeros((1, FEATURES), np.float32)


def passages(column: pa.Array, size: int, most: int = 1 << 20):
    """(first row, bag of each passage counted from that row, features) for runs of rows; each row has a passage at least."""
    for first, last, data, offsets in slices(column, most):
        if len(data) > 2 * most and last == first + 1:
            x = measure_long(data, size, most)
            yield first, np.zeros(len(x), np.int64), x
        else:
            yield first, *measure(data, offsets, size)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Passage encoder, gated attention and document score, fitted by Adam."""

    def __init__(self, features: int, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"W": rng.normal(0, features**-0.5, (features, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, 8)), "U": rng.normal(0, hidden**-0.5, (hidden, 8)), "w": rng.normal(0, 0.3, 8), "o": rng.normal(0, 0.3, hidden), "c": np.zeros(1)}
        self.mean, self.std = np.zeros(features), np.ones(features)

    def forward(self, x: np.ndarray, cut: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        x = (x - self.mean) / self.std
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, cut)[bag])
        a = e / np.add.reduceat(e, cut)[bag]
        z = np.add.reduceat(a[:, None] * h, cut)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": sigmoid(z @ p["o"] + p["c"])}

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 512, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> "GatedAttention":
        """Adam over mini-batches of ``batch`` whole bags, whose rate falls to zero."""
        ends = np.searchsorted(bag, np.arange(len(y) + 1))
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        p, m, v = self.p, {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        p["c"][:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        rng, order, at = np.random.default_rng(seed), np.arange(len(y)), len(y)
        for step in range(1, steps + 1):
            if at >= len(y):
                order, at = rng.permutation(len(y)), 0
            own, at = np.sort(order[at : at + batch]), at + batch
            n = np.diff(ends)[own]
            cut = np.cumsum(n) - n
            here = np.repeat(np.arange(len(own)), n)
            f = self.forward(x[np.repeat(ends[own] - cut, n) + np.arange(len(here))], cut, here)
            d = (f["y"] - y[own]) / len(own)
            dz = d[:, None] * p["o"]
            da = (f["h"] * dz[here]).sum(axis=1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, cut)[here])
            dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
            dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz[here] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grad = {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "o": f["z"].T @ d, "c": np.array([d.sum()])}
            slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, q in grad.items():
                q = q + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                p[k] = p[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        cut = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
        return self.forward(x, cut, bag)["y"]


def fit_quality(docs: DataFrame, labels: DataFrame, *, most_rows: int = 6000, size: int = 64, label: str = "quality") -> GatedAttention:
    """Fit on at most ``most_rows`` labelled documents outside the held-out fold; executors send passage features only.

    Documents of over ROW_BYTES of features (some 40,000 words) are left out of the fit (not of the scores), so its memory
    is bounded. Without labelled rows the model knows nothing, and every score is 0.5.
    """

    def run(batches):
        for batch in batches:
            ids, ys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for first, bag, x in passages(batch.column(1), size):
                ends = np.searchsorted(bag, np.arange(bag[-1] + 2))
                out += [(ids[first + i], ys[first + i], x[ends[i] : ends[i + 1]].tobytes()) for i in range(bag[-1] + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["doc_id", "y", "x"])

    rows = with_texts(docs, sample_labels(labels, label, most_rows)).mapInArrow(lean(run), "doc_id long, y int, x binary").filter(F.octet_length("x") <= ROW_BYTES).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    model = GatedAttention(FEATURES)
    if not rows:
        model.p["o"][:] = 0
        return model
    found = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    return model.fit(np.concatenate(found), np.repeat(np.arange(len(rows)), [len(x) for x in found]), np.array([float(r.y) for r in rows]))


def passage_scores(column: pa.Array, model: GatedAttention, size: int) -> np.ndarray:
    """Scores (0 to 1) of the texts; null and empty ones count as one passage without words."""
    score = np.zeros(len(column))
    for first, bag, x in passages(column, size):
        found = model.score(x, bag)
        score[first : first + len(found)] = found
    return score


def keep_quality(docs: DataFrame, model: GatedAttention, *, threshold: float = 0.3, size: int = 64) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; all columns, of whatever names, stay as they are."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passage_scores(batch.column(at), model, size) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, most_rows: int = 6000, size: int = 64) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. A null doc_id gives a null held_out.

    docs: doc_id and text; other columns are not read. Rows that repeat a doc_id are each scored; the fit takes one text of
    each doc_id, the least, and of several labels the largest. Null and empty texts are one passage without words; very long
    ones are read part by part, and only the measures of their passages are held.
    """
    model = fit_quality(docs, labels, most_rows=most_rows, size=size)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(passage_scores(batch.column(1), model, size))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", (folds() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
