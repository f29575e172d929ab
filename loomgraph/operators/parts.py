"""Ordered graph parts of tasks, and project documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.scratch import written
from ..schemas import PART_BODIES, STATUSES

ORDER = ["task_id", "stage", "k", "p"]


def numbered(keys: DataFrame) -> DataFrame:
    """``keys`` (ORDER) with response_id: 1, 2, ... in each task, without gaps.

    Ranges of the sorted keys number themselves; a table of the rows of each task in each range, summed before each range,
    makes the numbers those of the task. So a task of very many keys is numbered by many tasks of Spark.
    """
    ranged = written(keys.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("n", F.monotonically_increasing_id()), "numbered")
    ranged = ranged.withColumn("range", F.shiftright("n", 33))
    runs = ranged.groupBy("task_id", "range").agg(F.min("n").alias("least"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("task_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("task_id", "range", (F.coalesce(before, F.lit(0)) - F.col("least") + 1).alias("shift"))
    return ranged.join(runs, ["task_id", "range"]).select(*ORDER, (F.col("n") + F.col("shift")).cast("int").alias("response_id"))


def graph_parts(dependencies: DataFrame, endpoint_maps: DataFrame, graph: DataFrame) -> DataFrame:
    """All parts of each task of ``endpoint_maps``: requirements, endpoints, architecture, done; numbered from 1.

    The numbering sorts small keys only; the bodies follow by their own keys, of which each part has one: a manifest of a task,
    and a function of a file, come once.
    """
    tasks = endpoint_maps.select("task_id")
    none = {f: F.lit(None).cast(t).alias(f) for f, t in PART_BODIES.items()}

    def part(rows: DataFrame, status: str, key, pos, field: str, body) -> DataFrame:
        others = [none[f] for f in none if f != field]
        return rows.select("task_id", F.lit(STATUSES.index(status)).alias("stage"), key.alias("k"), pos.alias("p"), F.lit(status).alias("status"), body.cast(PART_BODIES[field]).alias(field), *others)

    first, zero = F.lit(""), F.lit(0)
    rows = part(dependencies.join(tasks, "task_id", "left_semi"), "REQUIREMENTS", F.col("place"), zero, "requirements", F.struct("total", F.col("packages").alias("requirements")))
    rows = rows.unionByName(part(endpoint_maps, "ENDPOINTS", first, zero, "endpoints", F.struct("total", "endpoints")))
    rows = rows.unionByName(part(graph.join(tasks, "task_id", "left_semi"), "ARHITECTURE", F.col("key"), F.col("pos"), "architecture", F.struct("parent", "children")))
    rows = rows.unionByName(part(tasks, "DONE", first, zero, "architecture", F.struct(F.lit("").alias("parent"), F.array().cast("array<string>").alias("children"))))
    return rows.join(numbered(rows.select(*ORDER)), ORDER).select("task_id", "response_id", "status", "requirements", "endpoints", "architecture")


def assemble_architecture(parts: DataFrame) -> DataFrame:
    """Per task: requirements joined in order, endpoint entries sorted, map parent -> children (of equal parents the last)."""
    lists = parts.groupBy("task_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "REQUIREMENTS", F.struct("response_id", "requirements.requirements")))), lambda x: x["requirements"])).alias("requirements"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "ENDPOINTS", F.struct("response_id", F.map_entries("endpoints.endpoints").alias("e"))))), lambda x: x["e"])).alias("endpoints"),
    )
    last = parts.filter("status = 'ARHITECTURE'").groupBy("task_id", "architecture.parent").agg(F.max_by("architecture.children", "response_id").alias("children"))
    data = last.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parent", "children")))).alias("data"))
    none = F.create_map().cast("map<string,array<string>>")
    return lists.join(data, "task_id", "left").withColumn("data", F.coalesce("data", none))
