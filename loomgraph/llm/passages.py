"""Removal of passages that earlier documents hold, byte for byte (operator 4).

Windows of ``size`` bytes that are equal must meet in one task. Each window is
sent by its minimizer, the least hash of the ``gram``-byte strings inside it,
which equal windows have in common; neighbouring windows of one minimizer go as
one string. Before that, minimizers found in one document only are dropped, so
what no other document can hold is never sent. In a task, equal strings are one
string with the smallest doc_id, and the different strings of each minimizer are
compared by interval expansion on their Burrows-Wheeler transform.

Texts move as compressed blobs of document groups, hashes and spans as packed
numbers, so a row is a block of work. The numbers of groups and buckets follow
the bytes of the corpus; no group or bucket holds more than about its share. A
minimizer shared inside one batch is sent once for the batch, so a passage in a
third of all documents is one entry a batch. The strings of a minimizer that very
many have are not compared in one task: their windows meet by their own digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import equal_windows
from .store import arrow_rows, drop, materialize
from .textkit import U, column_bytes, hash_spans, mix


def runs(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, minimizer) of the maximal runs of windows with one minimizer; a run is data[start:end]."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    n = len(data) - size + 1
    if n <= 0:
        return none
    x, w = data.astype(U), 1
    while w < 8:
        x = x[:-w] << U(8 * w) | x[w:]
        w *= 2
    k = len(data) - gram + 1
    h = np.zeros(k, U)
    for i in range(0, gram - 7, 8):
        h += x[i : i + k] * U(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1)
        h ^= h >> U(29)
    if gram % 8:
        h += x[gram - 8 : gram - 8 + k] * U(0xD6E8FEB86659FD93)
    h = mix(h)
    low, w, span = h, 1, size - gram + 1
    while 2 * w <= span:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    low = np.minimum(low[:n], low[span - w : span - w + n])
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(n) + size <= ends)
    if not len(at):
        return none
    value, text = low[at], np.searchsorted(offsets, at, "right") - 1
    first = np.ones(len(at), bool)
    first[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    cut = np.flatnonzero(first)
    last = at[np.append(cut[1:], len(at)) - 1]
    return text[cut], at[cut], last + size, value[cut]


def pieces(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, size: int, most: int = 1 << 19):
    """Runs of texts of about ``most`` bytes: (first text, bytes, offsets, place of the bytes in the first text).

    A text of more is cut into pieces that overlap by ``size`` - 1 bytes, so each window of ``size`` is in one of them.
    """
    i = 0
    while i < len(ids):
        j = min(len(ids), max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        if offsets[j] - offsets[i] > 2 * most:
            for at in range(0, int(offsets[j] - offsets[i]) - size + 1, most):
                part = data[offsets[i] + at : min(offsets[i] + at + most + size - 1, offsets[j])]
                yield i, part, np.array([0, len(part)]), at
        else:
            yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0
        i = j


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.view(U) + U(77)) % U(groups)).astype(np.int64)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def by_key(key: np.ndarray, *columns: np.ndarray):
    """(key, parts of the columns) for each key, each part in the order of its rows."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(key)), strict=True):
        yield int(sorted_[a]), [c[order[a:b]] for c in columns]


def gather(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def read(column, kind) -> np.ndarray:
    return gather([np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid], kind)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def repeated(doc: np.ndarray, key: np.ndarray, data: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each string data[place:place + length], whether an equal one of its key has a smaller doc."""
    out = np.zeros(len(doc), bool)
    if not len(doc):
        return out
    h = hash_spans(data, place, place + length)
    order = np.lexsort((doc, h, key))
    a, b = order[:-1], order[1:]
    at = np.flatnonzero((key[a] == key[b]) & (h[a] == h[b]) & (length[a] == length[b]))
    same = np.zeros(len(a), bool)
    for i in np.split(at, np.flatnonzero(np.diff(np.cumsum(length[a[at]]) // 1_000_000)) + 1) if len(at) else ():
        n = length[a[i]]
        same[i] = np.logical_and.reduceat(data[spread(place[a[i]], n)] == data[spread(place[b[i]], n)], np.cumsum(n) - n)
    head = np.concatenate([[True], ~same])
    out[order] = doc[order] > doc[order[np.flatnonzero(head)]][np.cumsum(head) - 1]
    return out


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans that touch as one; a later start must not have an earlier end."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    cut = np.flatnonzero(new)
    return doc[cut], start[cut], end[np.append(cut[1:], len(doc)) - 1]


def window_digests(data: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit BLAKE2b digests of the windows that start at ``place``."""
    view = memoryview(np.ascontiguousarray(data))
    both = np.frombuffer(b"".join(hashlib.blake2b(view[p : p + size], digest_size=16).digest() for p in place.tolist()), U).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def least_of_each(doc: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each row, the smallest doc among the rows of its digest."""
    order = np.lexsort((doc, two, one))
    new = np.ones(len(doc), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    out = np.empty_like(doc)
    out[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def digest(text: np.ndarray) -> int:
    """The first 60 bits of the text's SHA-256."""
    return int(hashlib.sha256(text.tobytes()).hexdigest()[:15], 16)


def remove_repeats(docs: DataFrame, *, size: int = 50, gram: int = 24, group_bytes: int = 4_000_000, most_strings: int = 8192) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    docs: doc_id and text; other columns are not read. A byte is removed if a ``size``-byte string over it also starts
    in a document with a smaller doc_id. spans: the maximal removed runs as array<struct<start, end>>, in bytes. A
    null text counts as empty. Rows with a null doc_id lose nothing and take nothing from others. Rows that repeat a doc_id
    with one text get one result; if their texts differ, each is judged on its own against smaller doc_ids. Minimizers with
    about ``most_strings`` strings or more, by a count over some documents, are compared window by window; results do not
    depend on it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digests = materialize(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "digests")
    total, n_rows = digests.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    groups, buckets = max(1, -(-total // group_bytes)), max(1, -(-3 * total // group_bytes))
    # the first doc_id of each text that several rows have; of those with a thousandth of all rows or more there are 1000 at most
    classes = materialize(digests.filter(f"doc_id is not null and n_bytes >= {size}").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "classes")
    hot, others = F.broadcast(classes.filter(F.col("n") * 1000 >= n_rows)), classes.filter(F.col("n") * 1000 < n_rows)
    placed = digests.join(hot.drop("n"), "sha").unionByName(digests.join(hot.select("sha"), "sha", "left_anti").join(others.drop("n"), "sha", "left"))
    later = placed.filter("doc_id > first").select("doc_id", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("digest")).distinct()
    texts = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= size))
    number = "g long, kind int, a binary, b binary"

    rate = max(1, min(128, most_strings // 64))

    def count(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            found = [runs(part, at, size, gram)[3] for _, part, at, _ in pieces(np.zeros(batch.num_rows), data, offsets, size)]
            value = gather(found, U)
            key, n = np.unique(bucket_of(value, buckets).astype(U) << U(32) | value & U(0xFFFFFFFF), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    with arrow_rows(spark, 2500):
        counted = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0).mapInArrow(count, "key long, n long")
        often = np.array([r.key for r in counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") * rate >= most_strings).select("key").collect()], np.int64).view(U)

    def frame(out: list[tuple]) -> pa.RecordBatch:
        g, kind, a, b = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["g", "kind", "a", "b"])

    def anchors(batches):
        """Kind 0, by bucket: low hashes of minimizers, and their docs as compressed steps behind the number of those that the
        batch does not share; these come first. Kind 1, by group: (doc, minimizer) shared inside the batch."""
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(), column_bytes(batch.column(1))
            docs_, values = [], []
            for first, part, at, _ in pieces(ids, data, offsets, size):
                text, _, _, value = runs(part, at, size, gram)
                order = np.lexsort((value, text))
                new = np.ones(len(order), bool)
                new[1:] = (value[order][1:] != value[order][:-1]) | (text[order][1:] != text[order][:-1])
                docs_.append(ids[first + text[order][new]])
                values.append(value[order][new])
            doc, value = gather(docs_, np.int64), gather(values, U)
            order = np.lexsort((doc, value))
            doc, value = doc[order], value[order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            of = np.cumsum(new) - 1
            cut = np.flatnonzero(new)
            many = doc[np.append(cut[1:], len(value)) - 1] != doc[cut] if len(value) else np.zeros(0, bool)
            out = [(g, 1, d.tobytes(), v.tobytes()) for g, (d, v) in by_key(group_of(doc[many[of]], groups), doc[many[of]], value[many[of]])]
            by_doc = cut[np.lexsort((doc[cut], many))]
            for b, (v, d, m) in by_key(bucket_of(value[by_doc], buckets), value[by_doc], doc[by_doc], many[of[by_doc]]):
                steps = np.concatenate([[np.count_nonzero(~m)], np.diff(d, prepend=0)])
                out.append((b, 0, (v & U(0xFFFFFFFF)).astype("<u4").tobytes(), zstandard.compress(steps.tobytes(), 3)))
            yield frame(out)

    with arrow_rows(spark, 2500):
        anchored = materialize(texts.mapInArrow(anchors, number), "anchors")

    def meet(table: pa.Table) -> pa.Table:
        """Of one bucket, by group: (doc, bucket and low hash) of minimizers that several documents share."""
        bucket, value = table["g"][0].as_py(), read(table["a"], "<u4")
        steps = [np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in table["b"]]
        doc = gather([np.cumsum(x[1:]) for x in steps], np.int64)
        known = gather([np.arange(len(x) - 1) >= x[0] for x in steps], bool)  # its batch has told its documents already
        order = np.argsort(value, kind="stable")
        value, doc, known = value[order], doc[order], known[order]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        cut, of = np.flatnonzero(new), np.cumsum(new) - 1
        shared = (np.maximum.reduceat(doc, cut) != np.minimum.reduceat(doc, cut))[of] & ~known
        key = U(bucket) << U(32) | value[shared].astype(U)
        return pa.Table.from_batches([frame([(g, 2, d.tobytes(), k.tobytes()) for g, (d, k) in by_key(group_of(doc[shared], groups), doc[shared], key)])])

    verdicts = anchored.filter("kind = 1").unionByName(anchored.filter("kind = 0").groupBy("g").applyInArrow(meet, number))

    def later_ids(batches):
        for batch in batches:
            ids, digests_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield frame([(g, 3, d.tobytes(), x.tobytes()) for g, (d, x) in by_key(group_of(ids, groups), ids, digests_)])

    def pack(batches):
        """Kind 4, by group: ids and lengths, and the texts, compressed."""
        squeeze = zstandard.ZstdCompressor(6)
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(), column_bytes(batch.column(1))
            out = []
            for g, (at,) in by_key(group_of(ids, groups), np.arange(len(ids))):
                lengths = np.diff(offsets)[at]
                out.append((g, 4, np.concatenate([ids[at], lengths]).tobytes(), squeeze.compress(b"".join(data[offsets[i] : offsets[i + 1]] for i in at))))
            yield frame(out)

    packed = texts.mapInArrow(pack, number)

    def unpack(table: pa.Table):
        """(ids, bytes, offsets) of each blob of texts."""
        for a, b in zip(table["a"], table["b"], strict=True):
            ids, lengths = np.frombuffer(a.as_buffer(), np.int64).reshape(2, -1)
            yield ids, np.frombuffer(zstandard.ZstdDecompressor().decompress(b.as_py(), int(lengths.sum())), np.uint8), np.concatenate([[0], np.cumsum(lengths)])

    def several(table: pa.Table) -> dict[int, dict[int, int]]:
        """Of one group of documents: for each doc_id with several rows, its texts' digests and their ranks."""
        values, n = np.unique(gather([np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)[0] for x in table["a"]], np.int64), return_counts=True)
        many, found = values[n > 1], {}
        for ids, data, offsets in unpack(table) if len(many) else ():
            for i in np.flatnonzero(np.isin(ids, many)):
                found.setdefault(int(ids[i]), set()).add(digest(data[offsets[i] : offsets[i + 1]]))
        return {d: {x: k for k, x in enumerate(sorted(xs))} for d, xs in found.items()}

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one group of documents, by bucket: the strings of shared minimizers. a: docs, starts, lengths, hashes; b: bytes.

        Of equal strings only those of the smallest doc_id go to the bucket, so a passage that many documents share is
        one string of each group; the others are removed for certain, and go as finished spans under a number below 0.
        Windows of minimizers in ``often`` go by their digests instead (a: digests; b: docs, starts), again those of the
        smallest doc_id only. A start holds, above its 40 lowest bits, the rank of its text among those of its doc_id.
        """
        kind = right["kind"].to_numpy()
        one, two, three = (right.filter(pa.array(kind == k)) for k in (1, 2, 3))
        value = read(one["b"], U)
        keys = np.concatenate([bucket_of(value, buckets).astype(U) << U(32) | value & U(0xFFFFFFFF), read(two["b"], U)])
        wanted = np.unique(mix(keys ^ mix(np.concatenate([read(one["a"], np.int64), read(two["a"], np.int64)]).view(U))))
        skip, out = read(three["a"], np.int64), []
        ranks, copies = several(left), set(zip(skip.tolist(), read(three["b"], np.int64).tolist(), strict=True))
        squeeze = zstandard.ZstdCompressor(3)
        docs_, starts, ends, keys_, texts_, base = [], [], [], [], [], 0
        for ids, data, offsets in unpack(left) if len(wanted) else ():
            gone, rank = np.isin(ids, skip), np.zeros(len(ids), np.int64)
            for i in np.flatnonzero(np.isin(ids, list(ranks))) if ranks else ():
                x = digest(data[offsets[i] : offsets[i + 1]])
                gone[i], rank[i] = (int(ids[i]), x) in copies, ranks[int(ids[i])][x]
            for first, part, at, within in pieces(ids, data, offsets, size):
                text, start, end, value = runs(part, at, size, gram)
                key = bucket_of(value, buckets).astype(U) << U(32) | value & U(0xFFFFFFFF)
                doc = ids[first + text]
                found = mix(key ^ mix(doc.view(U)))
                place = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                keep = (wanted[place] == found) & ~gone[first + text]
                start, end = start[keep], end[keep]
                docs_.append(doc[keep])
                shift = (rank[first + text[keep]] << 40) - at[text[keep]] + within
                starts.append(start + shift)
                ends.append(end + shift)
                keys_.append(key[keep])
                texts_.append((base + start, part))
                base += len(part)
        data = gather([p for _, p in texts_], np.uint8)
        place = gather([s for s, _ in texts_], np.int64)
        doc, start, end, key = gather(docs_, np.int64), gather(starts, np.int64), gather(ends, np.int64), gather(keys_, U)
        again = repeated(doc, key, data, place, end - start)
        if again.any():
            out.append((-1 - left["g"][0].as_py(), 6, np.concatenate(joined(doc[again], start[again], end[again])).tobytes(), None))
            doc, start, end, key, place = (x[~again] for x in (doc, start, end, key, place))
        hot = np.isin(key, often)
        if hot.any():
            n = (end - start)[hot] - size + 1
            at, d, s = spread(place[hot], n), np.repeat(doc[hot], n), spread(start[hot], n)
            one, two = window_digests(data, at, size)
            first = least_of_each(d, one, two) == d
            if not first.all():
                out.append((-1 - left["g"][0].as_py(), 6, np.concatenate(joined(d[~first], s[~first], s[~first] + size)).tobytes(), None))
            one, two, d, s = (x[first] for x in (one, two, d, s))
            for b, (h, i, d, s) in by_key(buckets + bucket_of(one, buckets), one, two, d, s):
                out.append((b, 7, np.concatenate([h, i]).tobytes(), squeeze.compress(np.concatenate([d, s]).tobytes())))
            doc, start, end, key, place = (x[~hot] for x in (doc, start, end, key, place))
        for b, (d, s, e, k, p) in by_key((key >> U(32)).astype(np.int64), doc, start, end, key & U(0xFFFFFFFF), place):
            out.append((b, 5, np.concatenate([d, s, e - s, k.view(np.int64)]).tobytes(), squeeze.compress(data[spread(p, e - s)].tobytes())))
        return pa.Table.from_batches([frame(out)])

    def solve(table: pa.Table) -> pa.Table:
        """Of one bucket, by group: (doc, start, end) of what smaller doc_ids hold. Finished spans pass."""
        if table["g"][0].as_py() < 0:
            return pa.Table.from_batches([frame([(-1 - g, 6, a, None) for g, a in zip(table["g"].to_pylist(), table["a"].to_pylist(), strict=True)])])
        if table["g"][0].as_py() >= buckets:  # windows by their digests
            one, two = np.concatenate([np.frombuffer(x.as_buffer(), U).reshape(2, -1) for x in table["a"]], axis=1)
            doc, start = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.int64).reshape(2, -1) for x in table["b"]], axis=1)
            again = doc > least_of_each(doc, one, two)
            doc, start, end = joined(doc[again], start[again], start[again] + size)
            return pa.Table.from_batches([frame([(g, 6, np.concatenate(x).tobytes(), None) for g, x in by_key(group_of(doc, groups), doc, start, end)])])
        heads = [np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for x in table["a"]]
        doc, start, length, value = np.concatenate(heads, axis=1)
        data = gather([np.frombuffer(zstandard.ZstdDecompressor().decompress(b.as_py(), int(h[2].sum())), np.uint8) for h, b in zip(heads, table["b"], strict=True)], np.uint8)
        place = np.cumsum(length) - length
        # equal strings of a minimizer are one, with its smallest doc_id
        names = {}
        string = np.fromiter((names.setdefault((v, data[p : p + n].tobytes()), len(names)) for v, p, n in zip(value.tolist(), place.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, string, doc)
        most = np.full(len(names), np.iinfo(np.int64).min)
        np.maximum.at(most, string, doc)
        sample = np.zeros(len(names), np.int64)
        sample[string[::-1]] = np.arange(len(doc))[::-1]
        values, of = np.unique(value[sample], return_inverse=True)
        versions = np.bincount(of)[of]  # different strings of the same minimizer
        out_d, out_s, out_e = [], [], []
        alone = (versions[string] == 1) & (doc > least[string])
        out_d.append(doc[alone]), out_s.append(start[alone]), out_e.append((start + length)[alone])
        several = np.flatnonzero(versions > 1)
        several = several[np.argsort(of[several], kind="stable")]
        sizes = length[sample[several]]
        i = 0
        rank = np.full(len(names), -1, np.int64)
        while i < len(several):  # whole minimizers at a time, some 300 KB each
            j = i + int(np.searchsorted(np.cumsum(sizes[i:]), 300_000, "right")) + 1
            while j < len(several) and of[several[j]] == of[several[j - 1]]:
                j += 1
            part = several[i:j]
            n = length[sample[part]]
            base = np.concatenate([[0], np.cumsum(n)])
            at, number = equal_windows(data[spread(place[sample[part]], n)], base, size)
            owner = np.searchsorted(base, at, "right") - 1
            if len(at):
                low = np.full(number.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(low, number, least[part][owner])
                first = np.full(base[-1], np.iinfo(np.int64).max)  # by place of a window, the smallest doc_id that holds it
                first[at] = low[number]
                rank[part] = np.arange(len(part))
                mine = np.flatnonzero(np.isin(string, part))
                loads = np.cumsum(length[mine]) // 300_000
                for m in np.split(mine, np.flatnonzero(np.diff(loads)) + 1):
                    windows = length[m] - size + 1
                    who = np.repeat(m, windows)
                    offset = spread(np.zeros(len(m), np.int64), windows)
                    hit = first[base[rank[string[who]]] + offset] < doc[who]
                    d, a = doc[who[hit]], start[who[hit]] + offset[hit]
                    if len(d):
                        new = np.ones(len(d), bool)
                        new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)
                        cut = np.flatnonzero(new)
                        out_d.append(d[cut]), out_s.append(a[cut]), out_e.append(a[np.append(cut[1:], len(a)) - 1] + size)
            i = j
        d, s, e = gather(out_d, np.int64), gather(out_s, np.int64), gather(out_e, np.int64)
        return pa.Table.from_batches([frame([(g, 6, np.concatenate(x).tobytes(), None) for g, x in by_key(group_of(d, groups), d, s, e)])])

    result = "doc_id long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start long, end long>>, sha string"

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one group of documents: what stays."""
        parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(3, -1) for x in right["a"]]
        columns: list[list] = [[] for _ in range(6)]
        if parts:
            doc, start, end = np.concatenate(parts, axis=1)
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], end[order]
            found, ranks = {d: (s, e) for d, (s, e) in by_key(doc, start, end)}, several(left)
            for ids, data, offsets in unpack(left):
                for i, d in enumerate(ids.tolist()):
                    if d in found:
                        s, e = found[d]
                        text = data[offsets[i] : offsets[i + 1]]
                        rank = ranks[d][digest(text)] if d in ranks else 0
                        mine = s >> 40 == rank
                        if not mine.any():
                            continue
                        s, e = s[mine] - (rank << 40), e[mine] - (rank << 40)
                        reach = np.maximum.accumulate(e)
                        first = np.concatenate([[True], s[1:] > reach[:-1]])
                        s, e = s[first], reach[np.append(np.flatnonzero(first)[1:], len(s)) - 1]
                        gone = np.zeros(len(text) + 1, np.int64)
                        gone[s], gone[e] = 1, -1
                        kept = text[np.cumsum(gone[:-1]) == 0]
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)]
                        for c, x in zip(columns, (d, int((e - s).sum()), len(s), hashlib.sha256(kept.tobytes()).hexdigest(), spans, hashlib.sha256(text.tobytes()).hexdigest()), strict=True):
                            c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_removed", "n_spans", "kept_sha256", "spans", "sha"])

    skipped = later.mapInArrow(later_ids, number)
    with arrow_rows(spark, 2500):
        strings = packed.groupBy("g").cogroup(verdicts.unionByName(skipped).groupBy("g")).applyInArrow(send, number)
        spans = materialize(strings.groupBy("g").applyInArrow(solve, number), "spans")
        drop(anchored)
        changed = materialize(packed.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(cut, result), "changed")

    out = placed.join(changed.dropDuplicates(["doc_id", "sha"]), ["doc_id", "sha"], "left")
    whole = F.col("doc_id") > F.col("first")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
    )
