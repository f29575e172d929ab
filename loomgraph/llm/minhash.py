"""Near-duplicate documents by circulant MinHash (operator 9).

Two permutations of ``2**UNIVERSE`` slots make the whole signature: the first
shuffles the shingles' slots, the second gives the values, and coordinate k
reads it circularly shifted by k. So one shingle's coordinates are neighbours
in one table, and a text's signature is a minimum over short slices.

Bands of the signature propose pairs; each pair is confirmed on the full
shingle sets. Documents of one shingle set are one class and are never expanded
into pairs. In a bucket the members are first held against one of them only,
another in each bucket and turn; what that links is one component. After a few
such turns the members of a bucket that are still in different components are
all held against each other, so no link is lost: as pairs in small buckets,
and block against block inside tasks in large ones, which give links only. A
component that fills blocks of its own there is not held against itself, so few
others in a bucket of very many near copies cost their number times the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import arrow_rows, lean, materialize, temporary
from .textkit import LOWER, U, hash_spans, mix, parts, slices, words

UNIVERSE = 20
_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def circulant_tables(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second as overlapping windows of ``coordinates`` values."""
    key = (coordinates, seed)
    if key not in _TABLES:
        rng, size = np.random.default_rng(seed), 1 << UNIVERSE
        first, second = rng.permutation(size).astype(np.uint32), rng.permutation(size).astype(np.uint32)
        around = np.concatenate([second, second[:coordinates]])
        _TABLES[key] = first, np.lib.stride_tricks.sliding_window_view(around, coordinates)
    return _TABLES[key]


def shingle_sets(column: pa.Array, size: int, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of the ``size``-word shingles) of every text.

    A-Z are lower-cased. With fewer words the whole sequence is the one shingle; without words the set is empty. Long texts
    are read part by part; the shingles across a cut begin with the last words before it.
    """
    odd = [U(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) | 1) for i in range(size)]

    def few(h: np.ndarray) -> np.ndarray:
        """The one shingle of a text of fewer words."""
        return mix(np.array([sum(int(x) * int(odd[i]) for i, x in enumerate(h)) + len(h) & (1 << 64) - 1], U))

    for first, last, data, offsets in slices(column, most):
        if len(data) > 2 * most and last == first + 1:
            found, before = np.zeros(0, U), np.zeros(0, U)
            for a, b in parts(data, most):
                part = LOWER[data[a:b]]
                starts, stops, _ = words(part, np.array([0, b - a]))
                h = np.concatenate([before, hash_spans(part, starts, stops)])
                n = max(len(h) - size + 1, 0)
                rolled = np.zeros(n, U)
                for i in range(size):
                    rolled += h[i : i + n] * odd[i]
                found, before = np.union1d(found, mix(rolled)), h[n:]
            yield first, found if len(found) or not len(before) else few(before)
            continue
        data = LOWER[data]
        starts, stops, of = words(data, offsets)
        h = hash_spans(data, starts, stops)
        n = max(len(h) - size + 1, 0)
        rolled = np.zeros(n, U)
        for i in range(size):
            rolled += h[i : i + n] * odd[i]
        rolled = mix(rolled)
        for row in range(last - first):
            a, b = of[row], of[row + 1]
            if b - a >= size:
                yield first + row, np.unique(rolled[a : b - size + 1])
            elif b > a:
                yield first + row, few(h[a:b])
            else:
                yield first + row, np.zeros(0, U)


def signature(hashes: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """All coordinates of a non-empty set."""
    first, windows = circulant_tables(coordinates, seed)
    at, low = first[(hashes & U((1 << UNIVERSE) - 1)).astype(np.int64)], None
    for i in range(0, len(at), 4096):
        part = windows[at[i : i + 4096]].min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def fold(found: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two numbers that name a set of hashes."""
    return tuple(np.add.reduce(x).view(np.int64) for x in (mix(found ^ U(0x51ED270B)), mix(found + U(0x2545F491))))


def signatures(docs: DataFrame, *, size: int = 3, bands: int = 25, rows: int = 5, seed: int = 7) -> DataFrame:
    """Per row: doc_id, digest of the text, n_shingles, two longs that name its set, and the keys of its bands (none for an empty set)."""
    weights = mix(np.arange(1, rows + 1, dtype=U)) | U(1)
    which = mix(np.arange(101, 101 + bands, dtype=U))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            count, hi, lo, keys = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            for row, found in shingle_sets(batch.column(2), size):
                count[row] = len(found)
                if len(found):
                    hi[row], lo[row] = fold(found)
                    sig = signature(found, bands * rows, seed).astype(U).reshape(bands, rows)
                    keys[row] = mix((sig * weights).sum(axis=1, dtype=U) ^ which).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), pa.array(hi), pa.array(lo), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_shingles", "hi", "lo", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(lean(run), "doc_id long, digest long, n_shingles long, hi long, lo long, bands array<long>")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b, ca, cb) of ``pairs`` whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(4), batch.column(5)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), U), np.frombuffer(right[i].as_buffer(), U)
                least, most = sorted((len(x), len(y)))
                if 100 * least < percent * most:
                    continue
                at = np.searchsorted(x, y)
                same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")
    return joined.select("a", "b", "ca", "cb", "x", "y").mapInArrow(lean(run), "a long, b long, ca long, cb long")


def large_buckets(members: DataFrame, large: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, most_rows: int = 512, most_values: int = 1_000_000) -> DataFrame:
    """Rows (a, b) that join their components (ca, cb) in the buckets of ``large``, found block against block.

    A bucket is cut into blocks of about ``most_rows`` members and ``most_values`` shingles: each component that is
    larger has blocks of its own (a lane), all others share lane -1. Each task holds two blocks, but never two of one
    component's lane. A pair is tested in the first band that it shares. A task gives each member that its links reach one
    row, with the first member of its component there.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, mine, c, cross = (table.column(k).to_numpy(zero_copy_only=False) for k in ("id", "mine", "c", "cross"))
        bands = np.stack([np.asarray(x.as_py(), np.int64) for x in table.column("bands")])
        found = [np.frombuffer(x.as_buffer(), U) for x in table.column("found")]
        n = len(ids)
        size = np.array([len(x) for x in found])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        values = values[counts > 1]
        common = np.zeros((n, n), np.float32)
        for i in range(0, len(values), 16384):
            part = values[i : i + 16384]
            has = np.zeros((n, len(part)), np.float32)
            for k, x in enumerate(found):
                x = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")]
                at = np.searchsorted(part, x)
                has[k, at[part[np.minimum(at, len(part) - 1)] == x]] = 1
            common += has @ has.T
        same = common.astype(np.int64)
        link = 100 * same >= percent * (size[:, None] + size[None, :] - same)
        link &= c[:, None] != c[None, :]
        if cross[0]:
            link &= mine[:, None] != mine[None, :]
        first = np.full((n, n), -1, np.int16)
        band = table.column("band")[0].as_py()
        for k in range(bands.shape[1] - 1, -1, -1):
            first[bands[:, k][:, None] == bands[:, k][None, :]] = k
        link &= first == int(np.flatnonzero(bands[0] == band)[0])
        label = np.arange(n)
        while True:
            low = np.where(link, label[None, :], n).min(axis=1)
            low = np.minimum(low, label)
            low = low[low]
            if (low == label).all():
                break
            label = low
        moved = label != np.arange(n)
        return pa.table({"a": ids[label[moved]], "b": ids[moved], "ca": c[label[moved]], "cb": c[moved]})

    blocks = F.ceil(F.greatest(F.sum("n") / most_rows, F.sum("volume") / most_values)).cast("int").alias("blocks")
    members = members.join(large.select("band"), "band", "left_semi")
    components = members.groupBy("band", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("volume"))
    own = (F.col("n") >= most_rows) | (F.col("volume") >= most_values)
    components = components.withColumn("lane", F.when(own, F.col("c")).otherwise(-1))
    lanes = components.groupBy("band", "lane").agg(blocks)
    partners = lanes.groupBy("band").agg(F.collect_list(F.struct("lane", "blocks")).alias("lanes"))  # one entry for most_rows members or more
    placed = members.join(components.select("band", "c", "lane"), ["band", "c"]).join(lanes, ["band", "lane"]).join(partners, "band")
    placed = placed.withColumn("side", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    others = F.filter("lanes", lambda x: (x["lane"] != F.col("lane")) | (F.col("lane") == -1))
    others = F.flatten(F.transform(others, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: F.struct(x["lane"].alias("lane"), k.alias("side")))))
    me, other = F.struct(F.col("lane").alias("lane"), F.col("side").alias("side")), F.col("o")
    dealt = placed.select("band", "id", "c", "lane", "side", F.explode(others).alias("o"))
    dealt = dealt.select("band", "id", "c", F.least(me, other).alias("i"), F.greatest(me, other).alias("j"), (me == F.least(me, other)).alias("mine"), (me != other).alias("cross"))
    wide = dealt.join(classes.select("id", "bands"), "id").join(sets, "id")
    return wide.groupBy("band", "i", "j").applyInArrow(run, "a long, b long, ca long, cb long")


def follow(rows: DataFrame, parts: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` names a node of ``parts`` get its component there instead."""
    others = [x for x in rows.columns if x != column]
    return rows.join(parts.select(F.col("node").alias(column), F.col("component").alias("_to")), column, "left").select(*others, F.coalesce("_to", column).alias(column))


def place_near_duplicates(docs: DataFrame, *, size: int, percent: int, bands: int, rows: int, stars: int, small: int, block: int, seed: int) -> DataFrame:
    """One row per row: doc_id, digest of its text, n_shingles, component (a number of its component, null where it can't link) and component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with arrow_rows(spark, 2000):
        signed = materialize(signatures(docs, size=size, bands=bands, rows=rows, seed=seed), "signed", keep=True)
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # rows of one set form a class; one with its smallest doc_id stands for it
    classes = full.groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("low"), F.any_value("bands").alias("bands"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("id", "n_shingles", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = materialize(keyed.join(shared.select("band"), "band"), "shared")
    wanted = classes.join(keyed.select("id").distinct(), "id", "left_semi").select(F.col("low").alias("doc_id"), "id", "hi", "lo", "n_shingles")

    def blobs(batches):
        for batch in batches:
            ids, his, los = (batch.column(k).to_numpy() for k in range(3))
            keep, out = [], []
            for row, found in shingle_sets(batch.column(3), size):
                if len(found) and fold(found) == (his[row], los[row]):
                    keep.append(ids[row])
                    out.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary())], names=["id", "found"])

    with arrow_rows(spark, 1000):
        texts = docs.join(wanted, "doc_id").dropDuplicates(["doc_id", "id", "text"])
        sets = materialize(texts.select("id", "hi", "lo", "text").mapInArrow(lean(blobs), "id long, found binary"), "sets")
    alike = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    turned = F.col("a") > F.col("b")
    ends = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("ca", "cb"), ("cb", "ca"))]
    now, tested, joined = keyed.withColumn("c", F.col("id")), None, []
    with arrow_rows(spark, 200):
        for turn in range(stars + 1):
            links = []
            if turn == stars:
                sizes = materialize(now.groupBy("band").agg(F.count("*").alias("members"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1"), "sizes")
                links.append(materialize(large_buckets(now, sizes.filter(F.col("members") > small), classes, sets, percent, block), "links"))
                now = now.join(sizes.filter(F.col("members") <= small).select("band"), "band", "left_semi")
            other = now.select("band", F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("c").alias("cb"))
            order = F.xxhash64("id", "band", F.lit(turn))
            buckets = now.groupBy("band").agg(F.min_by(F.struct("id", "n_shingles", "c"), order).alias("p"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1")
            if turn < stars:
                pivots = buckets.select("band", F.col("p.id").alias("a"), F.col("p.n_shingles").alias("na"), F.col("p.c").alias("ca"))
            else:
                pivots = now.join(buckets.select("band"), "band", "left_semi").select("band", F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("c").alias("ca"))
            pairs = pivots.join(other, "band").filter(f"ca <> cb and {alike}" + (" and a < b" if turn == stars else "")).select(*ends).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = materialize(pairs, "pairs")
            tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
            links.append(materialize(verify(pairs, sets, percent), "links"))
            # only the components of the turn before are joined: they are the nodes now, so later turns have few edges
            joined.append(connected_components(reduce(DataFrame.unionByName, links), "ca", "cb"))
            if turn < stars:
                now = materialize(follow(now, joined[-1], "c"), "labelled")
    placed = classes.select("hi", "lo", "n_shingles", "low", F.col("id").alias("component"))
    for parts in joined:
        placed = follow(placed, parts, "component")
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    placed = materialize(placed.join(lowest, "component").select("hi", "lo", "n_shingles", "component", "component_id"), "placed", keep=True)
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = signed.select("doc_id", "digest", "n_shingles", "hi", "lo").join(placed, ["hi", "lo", "n_shingles"], "left")
    return out.select("doc_id", "digest", "n_shingles", F.when(~alone, F.col("component")).alias("component"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, stars: int = 3, small: int = 16, block: int = 512, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs: doc_id and text; other columns are not read. Link: 100 * intersection >= percent * union of the distinct
    ``size``-word shingles. A document without words links with nothing and is kept. A row with a null
    doc_id links with nothing, gets a null component_id and is kept. Rows that repeat a doc_id are each returned, and each is
    placed by its own text; component_id is the smallest doc_id of those that its links reach.
    Recall: a pair at exactly 0.8 meets in one of 25 bands of 5 with probability 0.99995, at 0.85 with 0.9999996.
    """
    with temporary(docs.sparkSession):
        found = place_near_duplicates(docs, size=size, percent=percent, bands=bands, rows=rows, stars=stars, small=small, block=block, seed=seed)
    return found.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, stars: int = 3, small: int = 16, block: int = 512, seed: int = 7) -> DataFrame:
    """``docs`` with one row of each group of near copies, with all its columns: of the rows with the group's smallest doc_id
    the one whose text has the smallest digest.

    Rows without words or without doc_id stay. Rows that repeat a doc_id with unlike texts are told apart by their texts and
    stay, each for its own group; of rows that repeat both doc_id and text one stays.
    """
    with temporary(docs.sparkSession):
        with temporary(docs.sparkSession):
            found = place_near_duplicates(docs, size=size, percent=percent, bands=bands, rows=rows, stars=stars, small=small, block=block, seed=seed)
        first = found.filter("component is not null and doc_id = component_id").groupBy("component").agg(F.min("digest").alias("first"))
        place = found.filter("component is not null").join(first, "component").select("doc_id", "digest", ((F.col("doc_id") != F.col("component_id")) | (F.col("digest") != F.col("first"))).alias("gone"))
        place = materialize(place.groupBy("doc_id", "digest").agg(F.max("gone").alias("gone"), F.count("*").alias("n")).filter("gone or n > 1"), "gone", keep=True)
    names = [f"_near_{k}" for k in range(len(docs.columns))]
    marked = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    marked = marked.withColumn("_near_id", doc_id.cast("long")).withColumn("_near_digest", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    keys = [F.col("_near_id") == F.col("doc_id"), F.col("_near_digest") == F.col("digest")]
    kept = marked.join(place.filter("gone"), keys, "left_anti")
    twice = place.filter("not gone and n > 1")
    if twice.isEmpty():
        return kept.select(*names).toDF(*docs.columns)
    once = kept.join(twice, keys, "left_semi").dropDuplicates(["_near_id", "_near_digest"])
    return kept.join(twice, keys, "left_anti").unionByName(once).select(*names).toDF(*docs.columns)
