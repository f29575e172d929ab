"""Alignment of two tokenizers through distinct segments (operator 13).

Texts are split before runs of blanks, where neither vocabulary can merge across, which is verified on the vocabulary
files: the byte-level split of the one never lets a token go on over a blank, and no piece of the other holds a word mark
behind another character. A text is the sequence of its segments, so what two tokenizers make of it is the sequence of
what they make of these. Each segment is tokenised and aligned once for the whole corpus, and texts are composed of the
alignments.

Texts move as numbers. A worker gives the segments of a block of texts numbers in the order of their share (a hash of the
segment) and text, so that a block's dictionary is a packet for each share whose numbers need not be sent. All packets of a
share meet in one group, which aligns its distinct segments; the packets come back to it once more with the counts
of its pairs, and then go to their blocks. A segment that stands in all texts is one entry of each block, and a group is bounded
by the number of shares, or by the size of a block. Long texts are cut into pieces before blanks.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

MARK = "▁"
#: Before a run that begins with a space, behind anything but a blank or a word mark, unless nothing but blanks follow.
CUT = re.compile(rf"(?<=[^\s{MARK}])(?= )(?!\s*\Z)")
MIXED = re.compile(rf"[\s{MARK}] |\s\Z")
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_PAIRS: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """A byte-level BPE of the tokenizers library (a) and a sentencepiece model (b), and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items() if all(c in letters for c in token)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        split = spec.get("pre_tokenizer") or {}
        by_words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        probe = "  A\tb\né ①"  # nothing is folded, dropped or added but the mark in front
        plain_pieces = b"".join(self.b_bytes[i] for i in self.b.encode(probe)) == f" {probe}".encode()
        self.separable = bool(by_words and plain_pieces and not any(MARK in p.lstrip(MARK) for p in pieces))

    def segments(self, text: str) -> list[str]:
        """The segments of space + ``text``, each without the space that it begins with; the whole text where splits are not verified."""
        if not self.separable:
            return [text]
        if not MIXED.search(f" {text}"):
            return text.split(" ")
        return [x[1:] for x in CUT.split(f" {text}")]

    def cuts(self, text: str, most: int) -> list[int]:
        """Where pieces of about ``most`` characters of a text begin, each behind the space that begins a segment."""
        starts = [0]
        while self.separable and len(text) - starts[-1] > most and (found := CUT.search(text, starts[-1] + most)):
            starts.append(found.start() + 1)
        return starts

    def align(self, segments: list[str]):
        """For each segment: its groups as text (empty if its bytes differ), and the last ids of a and of b of each group."""
        a_all = self.a.encode_batch([f" {x}" for x in segments], add_special_tokens=False)
        for segment, a, b in zip(segments, a_all, self.b.encode(segments, num_threads=1), strict=True):
            a, want = a.ids, f" {segment}".encode()
            a_parts, b_parts = [self.a_bytes.get(i, b"\0\0") for i in a], [self.b_bytes[i] for i in b]
            if b"".join(a_parts) != want or b"".join(b_parts) != want:
                yield "", (), ()
                continue
            groups, a_last, b_last = [], [], []
            i = j = i0 = j0 = a_end = b_end = 0
            while i < len(a):
                a_end += len(a_parts[i])
                i += 1
                while b_end < a_end:
                    b_end += len(b_parts[j])
                    j += 1
                if a_end == b_end:
                    groups.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
                    a_last.append(a[i - 1])
                    b_last.append(b[j - 1])
                    i0, j0 = i, j
            yield ";".join(groups), a_last, b_last


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Tokenizers(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _pack(numbers) -> bytes:
    return zlib.compress(np.asarray(numbers, "<i8" if isinstance(numbers, np.ndarray) and numbers.dtype == np.int64 else "<u4").tobytes(), 1)


def _numbers(raw: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def _pack_texts(texts: list[str]) -> bytes:
    lengths = np.fromiter(map(len, texts), "<u4", len(texts)).tobytes()
    return zlib.compress(len(texts).to_bytes(4, "little") + lengths + "".join(texts).encode(), 1)


def _texts(raw: bytes) -> list[str]:
    raw = zlib.decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    text, ends = raw[4 + 4 * n :].decode(), np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64).tolist()
    return [text[i:j] for i, j in zip([0, *ends], ends)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema.types, strict=True)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


_SPLIT = pa.schema([("block", pa.int64()), ("long", pa.bool_()), ("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("numbers", pa.binary()), ("share", pa.int32()), ("first", pa.int32()), ("segments", pa.binary()), ("counts", pa.binary())])
_ALIGNED = pa.schema([("share", pa.int32()), ("block", pa.int64()), ("long", pa.bool_()), ("first", pa.int32()), ("size", pa.int32()), ("groups", pa.binary()), ("unequal", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
_RATED = pa.schema([("block", pa.int64()), ("long", pa.bool_()), ("first", pa.int32()), ("groups", pa.binary()), ("counts", pa.binary())])
_PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("ok", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("groups", pa.string())])


class _Block:
    """The texts of a block as numbers, and its dictionary."""

    def __init__(self, number: int, is_long: bool):
        self.number, self.is_long, self.size = number, is_long, 0
        self.known: dict[str, int] = {}
        self.pieces: list[tuple] = []

    def add(self, row: int, doc_id: int | None, piece: int, segments: list[str], size: int) -> None:
        known = self.known
        self.pieces.append((row, doc_id, piece, np.fromiter((known.setdefault(x, len(known)) for x in segments), np.uint32, len(segments))))
        self.size += size + 64

    def rows(self, shares: int):
        """Pieces with their final numbers, then the packets."""
        counts = np.zeros(len(self.known), np.int64)
        for *_, numbers in self.pieces:
            counts += np.bincount(numbers, minlength=len(counts))
        by_share: list[list[str]] = [[] for _ in range(shares)]
        for x in self.known:
            by_share[zlib.crc32(x.encode()) % shares].append(x)
        final, first = np.zeros(len(self.known), np.uint32), 0
        packets = []
        for share, segments in enumerate(by_share):
            if segments:
                segments.sort()
                old = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
                final[old] = np.arange(first, first + len(segments), dtype=np.uint32)
                packets.append((self.number, self.is_long, None, None, None, None, share, first, _pack_texts(segments), _pack(counts[old].astype(np.uint32))))
                first += len(segments)
        out, held = [], 0
        self.known.clear()
        for row, doc_id, piece, numbers in self.pieces:
            out.append((self.number, self.is_long, row, doc_id, piece, _pack(final[numbers]), None, None, None, None))
            held += len(out[-1][5])
            if len(out) >= 2000 or held > 1 << 22:
                yield _batch(out, _SPLIT)
                out, held = [], 0
        yield _batch(out, _SPLIT)
        for at in range(0, len(packets), 64):
            yield _batch(packets[at : at + 64], _SPLIT)


def split_texts(docs: DataFrame, a_path: str, b_path: str, *, shares: int, block_bytes: int, piece: int) -> DataFrame:
    """Pieces of texts as numbers (row, doc_id, piece, numbers), and the packets of their blocks (share, first number, segments, counts).

    Texts of over ``piece`` characters are cut and have blocks of their own (``long``).
    """

    def run(batches):
        from pyspark import TaskContext

        both, at, open_ = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                is_long = len(text) > piece
                starts = both.cuts(text, piece) if is_long else [0]
                for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(text) + 1], strict=True)):
                    part = text[i : j - 1] if is_long else text
                    if is_long not in open_:
                        open_[is_long], at = _Block(at, is_long), at + 1
                    open_[is_long].add(row, doc_id, k, both.segments(part) if text else [], len(part))
                    if open_[is_long].size >= block_bytes:
                        yield from open_.pop(is_long).rows(shares)
        for last in open_.values():
            yield from last.rows(shares)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, _ddl(_SPLIT))


def align_shares(packets: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each packet with the groups of its segments (empty where bytes differ: ``unequal`` are their numbers), and the pair counts of each share (a, b, n)."""

    def run(table: pa.Table) -> pa.Table:
        both, known, each = tokenizers(a_path, b_path), {}, []
        total = np.zeros(0, np.int64)
        for segments, counts in zip(table["segments"].to_pylist(), table["counts"].to_pylist(), strict=True):
            own = np.fromiter((known.setdefault(x, len(known)) for x in _texts(segments)), np.int64)
            total = np.concatenate([total, np.zeros(len(known) - len(total), np.int64)])
            total[own] += _numbers(counts)  # a packet holds a segment once
            each.append(own)
        distinct, groups, pairs = list(known), [], Counter()
        for at in range(0, len(distinct), 2000):
            for text, a_last, b_last in both.align(distinct[at : at + 2000]):
                n = int(total[len(groups)])
                groups.append(text)
                for pair in zip(a_last, b_last, strict=True):
                    pairs[pair] += n
        share, out = table["share"][0].as_py(), []
        for block, is_long, first, own in zip(table["block"].to_pylist(), table["long"].to_pylist(), table["first"].to_pylist(), each, strict=True):
            texts = [groups[i] for i in own.tolist()]
            bad = [first + i for i, x in enumerate(texts) if not x]
            out.append((share, block, is_long, first, len(texts), _pack_texts(texts), _pack(bad) if bad else None, None, None, None))
        found = pa.Table.from_batches([_batch(out, _ALIGNED)])
        n = len(pairs)
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        none = [pa.nulls(n, t) for t in _ALIGNED.types[1:7]]
        counted = pa.Table.from_arrays([pa.array([share] * n, pa.int32()), *none, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(pairs.values()), pa.int64())], schema=_ALIGNED)
        return pa.concat_tables([found, counted])

    return packets.groupBy("share").applyInArrow(run, _ddl(_ALIGNED))


def last_ids(groups: str):
    """The last ids of a and b of each group."""
    for group in groups.split(";"):
        a, _, b = group.partition("|")
        yield int(a[a.rfind(",") + 1 :]), int(b[b.rfind(",") + 1 :])


def unequal_pairs(aligned: DataFrame, pieces: DataFrame) -> DataFrame | None:
    """(a, b, -n): what texts that hold a segment whose bytes differ have put into the pair counts; they have no tokens at all. None if all are equal."""
    bad = aligned.filter("unequal is not null").select("block", "unequal")
    if bad.isEmpty():
        return None

    def holds(batches):
        for batch in batches:
            hits = [any(np.isin(_numbers(x.as_py()), _numbers(bad)).any() for bad in found) for x, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hits))], names=["row"])

    def taken(batches):
        for batch in batches:
            found: Counter = Counter()
            for numbers, first, size, groups in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                numbers, n = np.unique(_numbers(numbers), return_counts=True)
                own, texts = (numbers >= first) & (numbers < first + size), _texts(groups)
                for i, k in zip((numbers[own] - first).tolist(), n[own].tolist(), strict=True):
                    for pair in last_ids(texts[i]) if texts[i] else ():
                        found[pair] -= k
            yield _batch([(*pair, n) for pair, n in found.items()], pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

    marked = bad.groupBy("block").agg(F.collect_list("unequal").alias("bad"))
    rows = pieces.select("block", "row", "numbers").join(marked, "block").select("row", "numbers", "bad").mapInArrow(holds, "row long").distinct()
    gone = pieces.select("block", "row", "numbers").join(rows, "row", "left_semi").select(F.col("block").alias("of"), "numbers")
    packets = aligned.filter("groups is not null").select("block", "first", "size", "groups")
    return gone.join(packets, gone["of"] == packets["block"]).select("numbers", "first", "size", "groups").mapInArrow(taken, "a int, b int, n long")


def pair_counts(aligned: DataFrame, pieces: DataFrame) -> DataFrame:
    """Corpus-wide: a, b, n (links that hold this pair), best (no other pair of b has more)."""
    counted = aligned.filter("a is not null").select("a", "b", "n")
    gone = unequal_pairs(aligned, pieces)
    pairs = (counted if gone is None else counted.unionByName(gone)).groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _rated(packets: pa.Table, pairs: pa.Table) -> pa.Table:
    """The packets of one share with the counts of each segment: of a, b, groups, best links, and the sum over links."""
    count = dict(zip(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()), zip(pairs["n"].to_pylist(), pairs["best"].to_pylist())))
    known: dict[str, tuple] = {"": (0, 0, 0, 0, 0)}
    out = []
    for block, is_long, first, raw in zip(*(packets[c].to_pylist() for c in ("block", "long", "first", "groups")), strict=True):
        texts = _texts(raw)
        rows = []
        for text in texts:
            found = known.get(text)
            if found is None:
                links = [count[pair] for pair in last_ids(text)]
                n, a = len(links), sum(x.partition("|")[0].count(",") for x in text.split(";"))
                found = known[text] = n + a, n + text.count(",") - a, n, sum(best for _, best in links), sum(k for k, _ in links)
            rows.append(found)
        out.append((block, is_long, first, raw, _pack(np.array(rows, np.int64).T.copy())))
    return pa.Table.from_batches([_batch(out, _RATED)])


def _composed(pieces: pa.Table, packets: pa.Table) -> pa.Table:
    """The pieces of one block, composed of the alignments of its dictionary."""
    order = sorted(range(packets.num_rows), key=packets["first"].to_pylist().__getitem__)
    groups = [x for i in order for x in _texts(packets["groups"][i].as_py())]
    counts = [_numbers(packets["counts"][i].as_py(), "<i8").reshape(5, -1) for i in order]
    n_a, n_b, n_groups, n_best, count_sum = np.concatenate(counts, axis=1) if counts else np.zeros((5, 0), np.int64)
    out, batches, held = [], [], 0
    for row, doc_id, piece, raw in zip(*(pieces[c].to_pylist() for c in ("row", "doc_id", "piece", "numbers")), strict=True):
        numbers = _numbers(raw)
        good = bool((n_groups[numbers] > 0).all())
        sums = [int(c[numbers].sum()) if good else 0 for c in (n_a, n_b, n_groups, n_groups, n_best, count_sum)]  # a group is one link
        out.append((row, doc_id, piece, good, *sums, ";".join(map(groups.__getitem__, numbers.tolist())) if good else ""))
        held += len(out[-1][-1])
        if held > 1 << 22:
            batches.append(_batch(out, _PIECE))
            out, held = [], 0
    return pa.Table.from_batches([*batches, _batch(out, _PIECE)])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, *, shares: int | None = None, block_bytes: int = 32 << 20, piece: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    docs: doc_id and text; other columns are not read. Space + text is encoded by the tokenizers file ``a_path``, text by the
    sentencepiece model ``b_path``, without special tokens. Byte offsets where tokens of both end cut the tokens into
    ``groups`` (``a1,a2|b1;a3|b2,b3``: ids in order); each group is one link, between its last tokens, whose byte ranges end
    together. A pair of ids counts its links in the whole corpus; n_best are a document's links whose count is the highest
    of their b id, count_sum is the sum of its links' counts. Texts that are null, empty, or that a tokenizer doesn't give
    back byte by byte, have no tokens: zeros, empty groups, and no part in the counts. Rows that repeat a doc_id, or
    have none, are documents each on its own; an empty table gives no rows. Texts of over ``piece`` characters are cut before
    blanks; a single segment, and the groups of a document, are one string each. ``block_bytes``: the characters that one
    task composes at a time; ``shares``: the groups that the distinct segments are dealt to (one for every 16 MB of all texts, 8 at least).
    """
    if shares is None:
        shares = max(8, (docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) >> 24)
    split = materialize(split_texts(docs, a_path, b_path, shares=shares, block_bytes=block_bytes, piece=piece), "split")
    pieces = split.filter("row is not null").select("block", "long", "row", "doc_id", "piece", "numbers")
    packets = split.filter("segments is not null").select("block", "long", "share", "first", "segments", "counts")
    aligned = materialize(align_shares(packets, a_path, b_path), "aligned")
    pairs = pair_counts(aligned, pieces)
    own = aligned.filter("a is not null").select(F.col("share").alias("of"), F.col("a").alias("a"), F.col("b").alias("b")).join(pairs, ["a", "b"])
    grouped = aligned.filter("groups is not null").select("share", "block", "long", "first", "groups").groupBy("share")
    rated = grouped.cogroup(own.groupBy("of")).applyInArrow(_rated, _ddl(_RATED))

    def composed(is_long: bool) -> DataFrame:
        known = rated.filter(F.col("long") == is_long).select(F.col("block").alias("of"), "first", "groups", "counts")
        return pieces.filter(F.col("long") == is_long).drop("long").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_composed, _ddl(_PIECE))

    columns = ["doc_id", *COUNTS, "groups"]
    if pieces.filter("long").isEmpty():
        return composed(False).select(*columns)
    rated = materialize(rated, "rated")  # read by both
    whole = composed(True).groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.min("ok").alias("ok"), *(F.sum(c).alias(c) for c in COUNTS), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "groups"))), lambda x: x["groups"]), ";").alias("groups"))
    whole = whole.select("doc_id", *(F.when(F.col("ok"), F.col(c)).otherwise(0).alias(c) for c in COUNTS), F.when(F.col("ok"), F.col("groups")).otherwise("").alias("groups"))
    return composed(False).select(*columns).unionByName(whole)
