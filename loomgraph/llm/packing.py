"""Harmonic packing of token sequences (operator 3).

A sequence holds ``capacity`` tokens. Pieces are dealt into reciprocal-capacity
classes: class k takes pieces of ``floor(capacity / k)`` tokens at most, and each
of its bins holds exactly k pieces. Documents are cut so that the pieces fill
their classes: whole bins first, then halves, quarters and so on down to
``least`` tokens, which waste nothing, and one rest of fewer tokens, whose class
has a place for that very length (waste under ``least`` tokens a bin).

Workers number the pieces of each class on their own; a table of counts by
worker and class, summed before each worker, makes the numbers global, so each
class has one unfinished bin in all. The pieces of these last bins (under
``capacity`` for each class, whatever the input) are packed together, largest first.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import lean, materialize

_ENCODERS: dict[str, "Encoder"] = {}
#: The split's blanks (fixed values). The regular expression engine has no room for longer runs of them than some 700,000.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")


class Encoder:
    """Ids of texts by the split and the ranks of one vocabulary."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], special: dict[str, int]):
        import tiktoken

        self.split = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """A long run of blanks is one piece of the split, but for its last blank if more follows; so it is taken out by that rule."""
        parts, at = [], 0
        for run in RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += [self.split.encode_to_numpy(text[at : run.start()], allowed_special="all"), self.piece.encode_to_numpy(text[run.start() : end])]
            at = end
        parts.append(self.split.encode_to_numpy(text[at:], allowed_special="all"))
        return np.concatenate(parts)


def encoder(path: str) -> Encoder:
    """The byte-level BPE in a tokenizers .json file, without added special tokens.

    The file's merges are read as ranks of their results, which give the same ids if they stand in the order of these ids,
    behind the usual byte-level split and no normalizer; other files are refused.
    """
    if path not in _ENCODERS:
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, merges = spec["pre_tokenizer"] or {}, [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in merges]
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"] or order != sorted(order):
            raise ValueError("not a plain byte-level BPE whose merges stand in the order of their ids")
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # the fixed split of this kind of vocabulary
        _ENCODERS[path] = Encoder(pattern, ranks, added)
    return _ENCODERS[path]


def cut(n: int, capacity: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; lengths are the capacity, its halvings, or under ``least``."""
    pieces, at = [(i * capacity, capacity) for i in range(n // capacity)], n - n % capacity
    size = capacity // 2
    while size >= least:
        if n - at >= size:
            pieces.append((at, size))
            at += size
        size //= 2
    if at < n:
        pieces.append((at, n - at))
    return pieces


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, least: int = 32, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id and text; other columns are not read. A null or empty text is one piece with only the end id. A text of
    any length, and of any runs of blanks, is read whole; it and its ids are held at once. Rows that repeat a doc_id, or have none, are packed each on its own. ``capacity`` is a power of two.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "local"]

    def run(batches):
        from pyspark import TaskContext

        worker, used = TaskContext.get().partitionId(), {}
        tokens = encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(ids, texts, strict=True):
                found = np.append(tokens.ids(text.as_py() or "").astype("<u4"), np.uint32(end_id))
                raw = memoryview(found.astype("<u4").tobytes())
                for start, length in cut(len(found), capacity, least):
                    local = used.get(length, 0)
                    used[length] = local + 1
                    for column, x in zip(rows, (doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(found), worker, local), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=names)

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), ", ".join(f"{x} long" for x in names))
    pieces = materialize(pieces, "pieces")

    # sums of the counts before each worker; a length is its class, since each class takes one length
    counts = pieces.groupBy("length", "worker").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    fits = F.floor(F.lit(capacity) / F.col("length"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("total")).withColumn("fits", fits).withColumn("bins", F.floor(F.col("total") / F.col("fits")))
    totals = totals.withColumn("first_bin", F.coalesce(F.sum("bins").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = totals.withColumn("done", F.sum("bins").over(Window.partitionBy()))
    dealt = counts.join(F.broadcast(totals), "length").select("length", "worker", "before", "fits", "bins", "first_bin", "done")
    placed = pieces.join(dealt, ["length", "worker"]).withColumn("number", F.col("before") + F.col("local")).withColumn("bin", F.floor(F.col("number") / F.col("fits")))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = placed.filter("bin < bins").withColumn("sequence_id", F.col("first_bin") + F.col("bin")).withColumn("offset", (F.col("number") % F.col("fits")) * F.col("length"))

    rest = placed.filter("bin >= bins")

    def last_bins(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=lambda i: (-table["length"][i].as_py(), table["number"][i].as_py()))
        length, fill, place = table["length"].to_pylist(), [], [None] * table.num_rows
        low = 0
        for i in order:
            while low < len(fill) and fill[low] == capacity:
                low += 1
            k = next((k for k in range(low, len(fill)) if fill[k] + length[i] <= capacity), len(fill))
            if k == len(fill):
                fill.append(0)
            place[i] = (k, fill[k])
            fill[k] += length[i]
        done = table["done"].to_pylist()
        table = table.append_column("sequence_id", pa.array([d + p[0] for d, p in zip(done, place, strict=True)], pa.int64()))
        return table.append_column("offset", pa.array([p[1] for p in place], pa.int64())).select(out)

    rest = rest.select(F.lit(1).alias("one"), *out[:5], "number", "done").groupBy("one").applyInArrow(last_bins, ", ".join(f"{x} long" for x in out))
    return full.select(*out).unionByName(rest)
