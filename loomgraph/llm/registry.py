"""Queries of this subpackage for the entry module: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import COUNTS, align_tokenizers
from .conversations import PLAN_COLUMNS, damage, repair_digests
from .embeddings import near_embeddings
from .exact import exact_duplicates
from .minhash import near_duplicates
from .mixing import mix_domains
from .packing import pack
from .passages import remove_repeats
from .quality import classify_quality
from .secrets import find_secrets
from .tokens import token_counts
from .topk import top_k
from .toxicity import classify_toxicity

#: Shares of all tokens by language that the mixing query and the pipeline aim at.
MIX_TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; looked up when a query runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op2_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"), least=0.98)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048)


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), size=50).drop("spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_domains(table(spark, sf_dir, "documents"), MIX_TARGETS, domain="lang")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the rows of ``find_secrets``."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def n(kind: str):
        return F.size(F.filter("secrets", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda x: x.base)
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(find_secrets(table(spark, sf_dir, "documents")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair_digests(damage(conversations)).withColumnRenamed("conv_id", "_conv")
    rows = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in PLAN_COLUMNS]
    return rows.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", *COUNTS, F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"))


def repair_sql() -> str:
    """The repair as dynamic programming over rows: for each row the least (cost, audit) of beginnings without rows (e), and ending in s, u, a."""

    def add(x: str, edit: str, cost: int, truncated: bool = True) -> str:
        return f"{{'c': {x}.c + {cost}{' + tr' if truncated else ''}, 'a': {x}.a || '{edit}'}}"

    def when(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE {{'c': 1000000000, 'a': ''}} END"

    u1 = f"least(u, {add('e', 'I', 2, False)}, {add('s', 'I', 2, False)}, {add('a', 'I', 2, False)})"
    closed = f"SELECT conv_id, n, e, s, {u1} AS u, least(a, {add(f'({u1})', 'I', 2, False)}) AS a"
    user = ", ".join([add("u", "D", 3, False)] + [when("NOT must", add(x, "R", 2)) for x in "esa"] + [when("NOT must AND i = 'u'", add(x, "K", 0)) for x in "esa"])
    assistant = ", ".join([add("a", "D", 3, False), when("NOT must", add("u", "R", 2)), when("NOT must AND i = 'a'", add("u", "K", 0))])
    none = "{'c': 1000000000::BIGINT, 'a': ''}"
    return f"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS k FROM conversations),
        coded AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, k), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 20 AS f FROM named, crc),
        damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE f <> 0),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, role[1] AS i, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS kept FROM damaged),
        faults AS (SELECT *, CASE WHEN kept = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN kept[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM numbered),
        r AS MATERIALIZED (SELECT conv_id, n, role, text, i, fault IN ('b', 'd') AS must, (fault = 't')::BIGINT AS tr FROM faults),
        p AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': ''}} AS e, {none} AS s, {none} AS u, {none} AS a FROM r
              UNION ALL SELECT conv_id, n + 1, {add("e", "D", 3, False)}, least({add("s", "D", 3, False)}, {when("NOT must AND i = 's'", add("e", "K", 0))}), least({user}), least({assistant})
              FROM (SELECT o.*, r.i, r.must, r.tr FROM ({closed} FROM p) o JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.n + 1 = r.n)),
        best AS (SELECT conv_id, n, least(e, a) AS v FROM ({closed} FROM p) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
        edits AS (SELECT conv_id, j, v.a[j] AS edit, length(replace(v.a[:j], 'I', '')) AS n, length(replace(v.a[:j], 'D', '')) AS place FROM best, LATERAL (SELECT unnest(range(1, length(v.a) + 1)) AS j)),
        placed AS (SELECT e.conv_id, e.j, e.edit, e.place, r.role, r.text, max(CASE WHEN e.edit = 'K' AND r.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS opened
                   FROM edits e LEFT JOIN r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.n = r.n AND e.edit <> 'I' WHERE e.edit <> 'D'),
        hashed AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS h FROM placed GROUP BY conv_id),
        counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM faults) GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost, coalesce(v.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN hashed h ON o.conv_id IS NOT DISTINCT FROM h.conv_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_near_embeddings": op2_near_embeddings,
    "op3_packing": op3_packing,
    "op4_remove_repeats": op4_remove_repeats,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_secrets": op8_secrets,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_top_k": op10_top_k,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_repair": op12_repair,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op12_repair": repair_sql(),
    "op11_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op10_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, x -> floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL
                   AND len(list_filter(embedding, x -> x IS NULL OR isnan(x) OR isinf(x))) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
                   FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op2_near_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, x -> x::DOUBLE) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR isnan(x) OR isinf(x))) = 0
                   AND len(list_filter(embedding, x -> x <> 0)) > 0),
             l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                   AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
             r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a WHERE r.c < l.b),
             c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a)
        SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN c USING (vec_id)""",
}
