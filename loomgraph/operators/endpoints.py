"""HTTP endpoints of decorated functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decorator methods that make an endpoint (fixed values).
METHODS = ("get", "post", "put", "patch", "delete")
#: How an argument names its response model (fixed value).
MODEL = r"response_model\s*=\s*([A-Za-z_][A-Za-z0-9_\.]*)"


def detect_endpoints(functions: DataFrame) -> DataFrame:
    """Adds object, method, path, decorator_args: the first decorator ``object.method``; null where there is none."""

    def matches(d: Column) -> Column:
        parts = F.split(d["name"], r"\.", -1)
        return (F.size(parts) == 2) & F.lower(F.try_element_at(parts, F.lit(2))).isin(*METHODS)

    hit = F.try_element_at(F.filter("decorators", matches), F.lit(1))
    parts = F.split(F.col("hit.name"), r"\.", -1)
    return functions.withColumn("hit", hit).select(*functions.columns, F.try_element_at(parts, F.lit(1)).alias("object"), F.lower(F.try_element_at(parts, F.lit(2))).alias("method"), F.coalesce("hit.path", F.when(F.col("hit").isNotNull(), "")).alias("path"), F.col("hit.args").alias("decorator_args"))


def endpoint_full_path(detected: DataFrame) -> DataFrame:
    """Adds full_path: the prefix of the router of that name in the same file, then the path."""
    return detected.withColumn("full_path", F.when(F.col("method").isNotNull(), F.concat(F.coalesce(F.try_element_at("routers", F.col("object")), F.lit("")), "path")))


def response_model(args: Column, returns: Column) -> Column:
    """The name after the last ``response_model=`` in the arguments; else the return annotation."""
    names = F.filter(F.transform(args, lambda x: F.regexp_extract(x, MODEL, 1)), lambda x: x != "")
    return F.coalesce(F.try_element_at(names, F.lit(-1)), returns)


def endpoints(functions: DataFrame) -> DataFrame:
    """All endpoint functions: task_id, file, pos, function, method, path, args, response_model, calls, decorators."""
    found = endpoint_full_path(detect_endpoints(functions)).filter("method is not null")
    return found.select("task_id", F.col("key").alias("file"), "pos", F.col("fn_key").alias("function"), F.upper("method").alias("method"), F.col("full_path").alias("path"), "args", response_model(F.col("decorator_args"), F.col("returns")).alias("response_model"), "calls", "decorators")


def endpoint_map(found: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task: map function -> ``METHOD path`` (of equal names the last in file and place order), and its size."""
    last = found.groupBy("task_id", "function").agg(F.max_by(F.concat_ws(" ", "method", "path"), F.struct("file", "pos")).alias("label"))
    maps = last.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("function", "label")))).alias("endpoints"))
    none = F.create_map().cast("map<string,string>")
    return tasks.select("task_id").distinct().join(maps, "task_id", "left").select("task_id", F.coalesce("endpoints", none).alias("endpoints")).withColumn("total", F.size("endpoints").cast("long"))
