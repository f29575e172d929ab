"""Exact duplicates by a tree merge of sorted digest runs (operator 11).

The digest rows of all documents are dealt into runs. A run holds one entry for each text: its key, the smallest
identifier among its rows, and their number. In each binomial round, ``fan`` neighbouring runs (those whose numbers agree
but for their last bits) give their entries to one run of the next level, which merges them by key and retains the
smallest identifier again; the last level is one run, cut by key over all workers. Found classes of several rows then go
back down the same tree, level by level, to the rows.

Equal keys are verified at every level: entries merge only if the SHA-256, the number of bytes and a second hash of
another kind all agree. No join or merge meets more than ``fan`` entries of one text, and no run more rows of it than a
run has, so a text in a third of all rows is as cheap as any other. Only digests move; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, materialize

#: What must agree for two texts to count as equal.
KEY = ["digest", "n_bytes", "check"]


def exact_duplicates(docs: DataFrame, *, keep: str = "largest", fan: int = 8, run_rows: int = 65_536) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    docs: doc_id and text; other columns are not read. Of equal texts the row with the ``keep`` ("largest" or "smallest")
    doc_id stays; a null text counts as empty. Rows without doc_id come after all others (their group's keep_id is null
    if it has no other rows), and of rows that repeat both text and doc_id one stays. An empty table gives no rows. ``fan``
    is a power of two: the runs that merge into one; a run has about ``run_rows`` rows, and there are ``fan`` squared or more.
    """
    if keep not in ("largest", "smallest") or fan < 2 or fan & (fan - 1):
        raise ValueError("keep is largest or smallest, and fan a power of two")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id, bits = F.col("doc_id").cast("long"), fan.bit_length() - 1
    # the identifier that is retained if it is the smallest: rows without doc_id last, then by doc_id, then by place
    order = F.bitwise_not(doc_id) if keep == "largest" else doc_id
    read = docs.select(doc_id.alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check"), order.alias("order"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(read, "digests")

    depth = 2
    while fan**depth * run_rows < rows.count():
        depth += 1
    run = F.pmod(F.xxhash64("row"), F.lit(fan**depth)).cast("long")
    dealt = rows.withColumn("run", run)
    entry = dealt.select("run", *KEY, F.struct(F.col("order").isNull().alias("none"), "order", "row").alias("first"), F.lit(1).cast("long").alias("size"))
    levels = [materialize(merged(entry), "run")]
    for _ in range(depth):
        levels.append(materialize(merged(levels[-1].withColumn("run", F.shiftright("run", bits))), "run"))

    found = levels.pop().filter("size > 1")
    for level in reversed(levels):
        above = found.select(F.col("run").alias("above"), *KEY, "first", "size")
        found = level.select("run", F.shiftright("run", bits).alias("above"), *KEY).join(above, ["above", *KEY]).select("run", *KEY, "first", "size")
    found = materialize(found, "classes")
    drop(*levels)
    several = F.col("first").isNotNull()
    keep_id = F.bitwise_not(F.col("first.order")) if keep == "largest" else F.col("first.order")
    return dealt.join(found, ["run", *KEY], "left").select(
        "doc_id",
        F.when(several, keep_id).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def merged(entries: DataFrame) -> DataFrame:
    """The entries of each run merged by key in sorted order: the smallest identifier and the number of rows."""
    return entries.groupBy("run", *KEY).agg(F.min("first").alias("first"), F.sum("size").alias("size"))


def drop_exact_duplicates(docs: DataFrame, *, keep: str = "largest") -> DataFrame:
    """``docs`` with all its columns, without the rows whose text another row keeps; of rows that repeat both text and doc_id, one stays."""
    columns, text = docs.columns, F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = exact_duplicates(docs, keep=keep)
    stay = marks.filter("kept and group_size > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    copied = marks.filter("group_size > 1").select(F.col("text_sha256").alias("_sha")).distinct().withColumn("_copied", F.lit(True))
    named = docs.withColumns({"_sha": F.sha2(text.cast("binary"), 256), "_id": F.col("doc_id").cast("long")}).join(copied, "_sha", "left")
    alone = named.filter("_copied is null").select(*columns)
    kept = named.filter("_copied").alias("d").join(stay.alias("s"), F.col("d._id").eqNullSafe(F.col("s._id")) & (F.col("d._sha") == F.col("s._sha")), "left_semi")
    return alone.unionByName(kept.dropDuplicates(["_id", "_sha"]).select(*columns))
