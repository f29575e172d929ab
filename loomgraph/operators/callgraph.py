"""Calls resolved to functions, and call graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import extract_calls


CALL = ["task_id", "key", "pos", "fn_key", "call_pos", "call"]


def qualified(key: Column, owner: Column, name: Column) -> Column:
    """``file/Class.name``; a function without a class prints None for it."""
    return F.concat(key, F.lit("/"), F.coalesce(owner, F.lit("None")), F.lit("."), name)


def function_index(functions: DataFrame) -> DataFrame:
    """Per task and function key: its last definition in (key, pos) order."""
    last = F.max_by(F.struct("key", "pos", "class", "name"), F.struct("key", "pos")).alias("d")
    return functions.groupBy("task_id", "fn_key").agg(last).select("task_id", "fn_key", F.col("d.key").alias("def_key"), F.col("d.pos").alias("def_pos"), qualified(F.col("d.key"), F.col("d.class"), F.col("d.name")).alias("target"))


def candidates(functions: DataFrame) -> DataFrame:
    """Each call with the name of its receiver's annotated type in place of the receiver (``typed``), null where there is none."""
    receiver = F.substring_index("call", ".", 1)
    rest = F.when(F.instr("call", ".") > 0, F.substring(F.col("call"), F.length(receiver) + 2, F.length("call"))).otherwise("")
    return extract_calls(functions).select(*CALL, F.concat(F.try_element_at("arg_types", receiver), F.lit("."), rest).alias("typed"))


def spread(name: Column) -> Column:
    """``name`` for a join in which rows without one find nothing, each under its call, so that they don't meet in one task."""
    return F.coalesce(name, F.concat(F.lit("\0"), "call"))


def definitions(functions: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Per task and name an array of at most ``most`` definitions in (key, pos) order, with ``whole`` true where these are all; and
    arrays of all definitions of the other names, by the number (``lead``, from 1) of the first array's entry that leads to them."""
    named = functions.select("task_id", F.col("fn_key").alias("name"), F.struct("key", "pos", qualified(F.col("key"), F.col("class"), F.col("name")).alias("target")).alias("d"))
    group = Window.partitionBy("task_id", "name")
    named = named.withColumn("n", F.row_number().over(group.orderBy("d.key", "d.pos")) - 1).withColumn("each", F.ceil(F.count("*").over(group) / most))
    heads = named.filter("n % each = 0").groupBy("task_id", "name").agg(F.array_sort(F.collect_list("d")).alias("defs"), (F.max("each") == 1).alias("whole"))
    rest = named.filter("each > 1").groupBy("task_id", "name", (F.floor(F.col("n") / F.col("each")) + 1).cast("int").alias("lead")).agg(F.array_sort(F.collect_list("d")).alias("defs"))
    return heads, rest


def _latest(calls: DataFrame, name: str, found: str, heads: DataFrame, rest: DataFrame | None) -> DataFrame:
    """``calls`` with the latest definition of column ``name`` at or before the caller as ``found``."""
    here = F.struct(F.col("key").alias("key"), F.col("pos").alias("pos"))

    def up_to_here(defs: str) -> Column:
        return F.filter(defs, lambda d: F.struct(d["key"].alias("key"), d["pos"].alias("pos")) <= here)

    columns = calls.columns
    known = calls.withColumn("name", spread(F.col(name))).join(heads, ["task_id", "name"], "left").withColumn("before", up_to_here("defs"))
    last = F.try_element_at("before", F.lit(-1))["target"]
    if rest is None:
        return known.select(*columns, last.alias(found))
    ask = F.when(~F.col("whole"), F.col("name"))
    known = known.select(*columns, last.alias(found), spread(ask).alias("name"), F.coalesce(F.size("before"), F.lit(0)).alias("lead"))
    ranged = known.join(rest, ["task_id", "name", "lead"], "left").withColumn("before", up_to_here("defs"))
    return ranged.select(*columns, F.coalesce(last, F.col(found)).alias(found))


def resolve_calls_asof(functions: DataFrame, most: int = 256) -> DataFrame:
    """Each call with ``target``: the latest definition of its name at or before its caller, else of the typed name, else null.

    The definitions of a name travel as one array of ``most`` at most, so a call finds its target without a sort, and a name
    with very many calls is split like any skewed join. Both names of a call are looked up one after the other, so calls
    are read once. Names with more definitions are cut into as many ranges, each of which begins with a definition that leads
    to the range's own array; that lookup is made only if there are such names.
    """
    heads, rest = definitions(functions, most)
    heavy = not functions.groupBy("task_id", "fn_key").count().filter(F.col("count") > most).isEmpty()
    calls = candidates(functions)
    for name, found in (("call", "own"), ("typed", "by_type")):
        calls = _latest(calls, name, found, heads, rest if heavy else None)
    return calls.select(*CALL, F.coalesce("own", "by_type").alias("target"))


def resolve_calls_global(functions: DataFrame) -> DataFrame:
    """Each call with ``target`` by the finished index of its task."""
    index = function_index(functions).select("task_id", F.col("fn_key").alias("name"), "target")
    calls = candidates(functions)
    for name, found in (("call", "own"), ("typed", "by_type")):
        calls = calls.withColumn("name", spread(F.col(name))).join(index.withColumnRenamed("target", found), ["task_id", "name"], "left").drop("name")
    return calls.select(*CALL, F.coalesce("own", "by_type").alias("target"))


def call_edges(functions: DataFrame, resolution: str = "asof") -> DataFrame:
    """One row per call: parent, parent_id in the children's spelling, child, and whether it was resolved."""
    resolved = (resolve_calls_asof if resolution == "asof" else resolve_calls_global)(functions)
    owner = F.when(F.instr("fn_key", ".") > 0, F.substring_index("fn_key", ".", 1))
    name = F.substring_index("fn_key", ".", -1)
    child = F.coalesce("target", F.concat("key", F.lit("/"), "call"))
    return resolved.select("task_id", "key", "pos", "call_pos", F.col("fn_key").alias("parent"), qualified(F.col("key"), owner, name).alias("parent_id"), child.alias("child"), F.col("target").isNotNull().alias("resolved"))


def call_graph(functions: DataFrame, resolution: str = "asof") -> DataFrame:
    """One row per function, also of those that call nothing: parent and its children in call order, with repeats."""
    edges = call_edges(functions, resolution)
    lists = edges.groupBy("task_id", "key", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("call_pos", "child"))), lambda x: x["child"]).alias("children"))
    rows = functions.select("task_id", "key", "pos", F.col("fn_key").alias("parent")).join(lists, ["task_id", "key", "pos"], "left")
    return rows.withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
