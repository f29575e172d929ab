"""Row views of parsed files (O7 to O12). Each takes the output of ``parse_sources``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_imports(parsed: DataFrame) -> DataFrame:
    """One row per imported name of each file that parses."""
    return parsed.select("task_id", "key", F.posexplode("imports").alias("pos", "i")).select("task_id", "key", "pos", "i.*")


def extract_routers(parsed: DataFrame) -> DataFrame:
    return parsed.select("task_id", "key", F.explode("routers").alias("router", "prefix"))


def extract_functions(parsed: DataFrame) -> DataFrame:
    """One row per function, with the routers of its file beside it, so that endpoints need no join."""
    return parsed.select("task_id", "key", "routers", F.explode("functions").alias("f")).select("task_id", "key", "f.*", "routers")


def extract_calls(functions: DataFrame) -> DataFrame:
    """One row per named call, in the order in which a breadth-first walk of the function meets them."""
    return functions.select("task_id", "key", "pos", "fn_key", "arg_types", F.posexplode("calls").alias("call_pos", "call"))


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select("task_id", "key", "error")


def extract_decorators(functions: DataFrame) -> DataFrame:
    rows = functions.select("task_id", "key", "pos", "fn_key", F.posexplode("decorators").alias("decorator_pos", "d"))
    return rows.select("task_id", "key", "pos", "fn_key", "decorator_pos", "d.*")
