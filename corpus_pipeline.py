"""Corpus preparation as a chain of stages, each written as Parquet before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.minhash import drop_near_duplicates
from loomgraph.llm.mixing import resample_domains
from loomgraph.llm.packing import pack
from loomgraph.llm.quality import fit_quality, keep_quality
from loomgraph.llm.registry import MIX_TARGETS, table, tokenizer_path
from loomgraph.llm.secrets import redact_secrets
from loomgraph.llm.store import materialize, temporary

QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return keep_quality(docs, model, threshold=QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays: the one with the smallest doc_id.

    Rows without words or doc_id stay, and so do unlike texts of one doc_id; of rows that repeat both, one stays.
    """
    return drop_near_duplicates(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their fitted rate says, so that languages have their target shares of tokens."""
    return resample_domains(docs, MIX_TARGETS, domain="lang")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is written and read again, and what a stage leaves behind is removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
    return docs
