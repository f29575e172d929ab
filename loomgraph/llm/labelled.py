"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of features that one document brings to a fit at most; with the bound on rows this bounds the driver's memory.
ROW_BYTES = 32_768


def folds(doc_id: str = "doc_id"):
    """Remainder of crc32(doc_id as text) by 5; 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def sample_labels(labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows outside the held-out fold, picked by a hash of doc_id.

    Rows without doc_id or label are left out; a doc_id with several labels takes the largest.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    rows = rows.filter(folds() != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the sampled ids, one row for each that has a row in ``docs``: of several texts the least.

    The sample is bounded, so it is broadcast.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("y").alias("y"))
