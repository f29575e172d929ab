"""Package names of dependency manifests."""

from __future__ import annotations

import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blanks that Python's strip removes beyond those of the (?U) class.
_BLANK = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def requirement_name(line: Column) -> Column:
    """The package text of a requirements line: what stands before the first of ``= < > ~ !``; null for none or a comment."""
    clean = stripped(line)
    name = stripped(F.split(clean, "[=<>~!]", 2)[0])
    return F.when((clean != "") & ~clean.startswith("#") & (name != ""), name)


def parse_requirements(files: DataFrame) -> DataFrame:
    """(task_id, key, packages, error), in line order with repeats; a file without packages has an empty list."""
    text = F.col("content").cast("string")
    names = F.filter(F.transform(F.split(text, "\n", -1), requirement_name), lambda x: x.isNotNull())
    ok = F.is_valid_utf8(text)
    return files.select("task_id", "key", F.when(ok, names).alias("packages"), F.when(~F.coalesce(ok, F.lit(False)), "not UTF-8").alias("error"))


def parse_pyproject(files: DataFrame) -> DataFrame:
    """(task_id, key, packages, error): sorted distinct names of both dependency tables of each TOML file; one dependency that is no
    text fails its file."""

    def run(batches):
        for batch in batches:
            lists, errors = [], []
            for x in batch.column(2):
                try:
                    data = tomllib.loads((x.as_py() or b"").decode())
                    poetry = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
                    project = list(data.get("project", {}).get("dependencies", []))
                    if not all(isinstance(d, str) for d in project):
                        raise TypeError("a dependency is no text")
                    lists.append((project, [d for d in poetry if d.lower() != "python"]))
                    errors.append(None)
                except (ValueError, AttributeError, TypeError, RecursionError) as e:
                    lists.append((None, None))
                    errors.append(f"{type(e).__name__}: {e}")
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in lists], kind), pa.array([b for _, b in lists], kind), pa.array(errors, pa.string())], names=["task_id", "key", "project", "poetry", "error"])

    rows = files.select("task_id", "key", "content").mapInArrow(run, "task_id long, key string, project array<string>, poetry array<string>, error string")
    names = F.filter(F.transform("project", lambda d: F.split(d, rf"(?U)[=<>!~\[]|{_BLANK}", 2)[0]), lambda x: x != "")
    return rows.select("task_id", "key", F.array_sort(F.array_distinct(F.concat(names, "poetry"))).alias("packages"), "error")


def project_dependencies(requirements: DataFrame, pyprojects: DataFrame) -> DataFrame:
    """Per task and manifest basename: the last file in key order that parses; ``place`` is the first one's key."""
    good = requirements.unionByName(pyprojects).filter("error is null").withColumn("manifest", F.element_at(F.split("key", "/", -1), -1))
    w = Window.partitionBy("task_id", "manifest")
    last = good.withColumn("place", F.min("key").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("key")))).filter("n = 1")
    return last.select("task_id", "manifest", "place", "packages", F.size("packages").cast("long").alias("total"))
