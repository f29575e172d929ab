"""Bulk work over accounts and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIGHT = ("id", "name", "description", "picture_url")


def projects_by_owner(projects: DataFrame) -> DataFrame:
    """Per author_id: total, and the projects in light form by id."""
    return projects.groupBy("author_id").agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.struct(*LIGHT))).alias("projects"))


def owned_projects(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests (project_id, account_id), each with the other columns of its project and ``found``.

    A project that doesn't exist, or that another account owns, is not found: its columns are null.
    """
    own = projects.withColumnRenamed("id", "project_id").withColumnRenamed("author_id", "account_id").withColumn("_found", F.lit(True))
    joined = requests.join(own, ["project_id", "account_id"], "left")
    return joined.withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def homepage(accounts: DataFrame, projects: DataFrame) -> DataFrame:
    """Per account: id, name, surname, total, projects; none gives 0 and an empty list."""
    lists = projects_by_owner(projects)
    found = accounts.select("id", "name", "surname").join(lists.withColumnRenamed("author_id", "id"), "id", "left")
    return found.select("id", "name", "surname", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("projects", F.array().cast(lists.schema["projects"].dataType)).alias("projects"))


def apply_patches(rows: DataFrame, patches: DataFrame, fields: list[str], order: str = "seq") -> DataFrame:
    """``rows`` with the last non-null value that ``patches`` (id, fields, ``order``) has for each field; of several at one place in
    the order, the greatest."""
    last = patches.groupBy("id").agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(F.col(order), F.col(f)))).alias(f"_new_{f}") for f in fields))
    joined = rows.join(last, "id", "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def bucket(key: Column, buckets: int) -> Column:
    """The partition of a stored table that holds a row."""
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(buckets)).cast("int")


def store_rows(rows: DataFrame, path: str, buckets: int) -> None:
    """``rows`` (with ``id``) as a stored table that ``merge_patches`` can change: Parquet in ``buckets`` folders by a hash of id."""
    rows.withColumn("bucket", bucket(F.col("id"), buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)


def merge_patches(spark: SparkSession, path: str, patches: DataFrame, fields: list[str], buckets: int, order: str = "seq") -> list[int]:
    """Apply ``patches`` to a table of ``store_rows``, as ``apply_patches`` does; gives the numbers of the folders written anew.

    Only folders that hold a patched row are read and written; all others keep their files. The new folders are written
    aside and take their places when the job commits, so a job that fails before leaves the table as it was.
    """
    placed = patches.filter("id is not null").withColumn("bucket", bucket(F.col("id"), buckets))
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != "bucket"]
    hit = stored.select("id", "bucket").join(placed.select("id", "bucket").distinct(), ["id", "bucket"], "left_semi").select("bucket").distinct()
    touched = sorted(r.bucket for r in hit.collect())  # at most ``buckets``
    if touched:
        own = stored.filter(F.col("bucket").isin(touched))
        changed = apply_patches(own, patches, fields, order).select(*columns, "bucket").repartition(len(touched), "bucket")
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def reject_taken(registrations: DataFrame, accounts: DataFrame, field: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Registrations that are free (of equal ones the first by ``order``), and the refused ones. Null values are free.

    Rows without a value take no part in the sort or the join.
    """
    columns, value = registrations.columns, F.col(field)
    taken = accounts.select(field).filter(value.isNotNull()).distinct().withColumn("_taken", F.lit(True))
    first = Window.partitionBy(field).orderBy(order)
    ranked = registrations.filter(value.isNotNull()).withColumn("_n", F.row_number().over(first)).join(taken, field, "left")
    free = F.col("_taken").isNull() & (F.col("_n") == 1)
    without = registrations.filter(value.isNull())
    return ranked.filter(free).select(*columns).unionByName(without), ranked.filter(~free).select(*columns)


def delete_accounts_cascade(accounts: DataFrame, projects: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accounts and projects without those of the ids in ``gone``."""
    return accounts.join(gone.select("id"), "id", "left_anti"), projects.join(gone.select(F.col("id").alias("author_id")), "author_id", "left_anti")


def delete_owned_projects(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """``projects`` without those that a request (project_id, account_id) of their own author names."""
    gone = requests.select(F.col("project_id").alias("id"), F.col("account_id").alias("author_id")).distinct()
    return projects.join(gone, ["id", "author_id"], "left_anti").select(*projects.columns)
