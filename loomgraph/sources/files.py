"""Source files, archives and object keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .archives import _UNPACKED, unpack_rows
from .folders import batched

MANIFESTS = ("requirements.txt", "pyproject.toml")


def source_files(found: DataFrame, tasks: DataFrame, root: str) -> DataFrame:
    """(task_id, project_path, key, content) of what ``read_directory`` found below ``root``: keys are the paths below it, and tasks
    (task_id, project_path) have the files whose key has their path up to ``/unpacked/``. Files that could not be read are left out."""
    top = re.sub("^file:/*", "/", root.rstrip("/")) + "/"
    key = F.regexp_replace("path", "^file:/*", "/")
    keyed = found.filter("content is not null").select(F.substring(key, F.instr(key, top) + len(top), 1 << 30).alias("key"), "content")
    keyed = keyed.withColumn("project_path", project_path(F.col("key")))
    return tasks.select("task_id", "project_path").join(keyed, "project_path").select("task_id", "project_path", "key", "content")


def store_source_files(files: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """``files`` as a stored table, bucketed by task_id and sorted by task_id and key, one file a bucket however small the bodies are.

    Joins and groupings by task_id read such a table without an exchange. ``buckets``: so many that one is a few hundred MB.
    """
    wanted = files.select("task_id", "project_path", "key", "content").repartition(buckets, "task_id")
    wanted.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "task_id").sortBy("task_id", "key").saveAsTable(name)
    return files.sparkSession.table(name)


def list_project_files(files: DataFrame, prefix: str | None = None) -> DataFrame:
    """(task_id, key) of the files below ``prefix``, by key."""
    rows = files.select("task_id", "key")
    return (rows.filter(F.col("key").startswith(prefix)) if prefix is not None else rows).orderBy("task_id", "key")


def read_source_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Bodies of ``keys`` (task_id, key); a missing one is a row with ``error``."""
    found = keys.select("task_id", "key").join(files.select("task_id", "key", "content", F.lit(True).alias("found")), ["task_id", "key"], "left")
    return found.select("task_id", "key", "content", F.when(F.col("found").isNull(), "no such key").alias("error"))


def read_text_lines(files: DataFrame) -> DataFrame:
    """(task_id, key, line_no, line, error): the lines of UTF-8 bodies, or one error row for a body that isn't UTF-8."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.split(F.col("content").cast("string"), "\n", -1)).otherwise(F.array(F.lit(None).cast("string")))
    return files.select("task_id", "key", valid.alias("ok"), F.posexplode(text).alias("line_no", "line")).select("task_id", "key", "line_no", "line", F.when(~F.col("ok"), "not UTF-8").alias("error"))


def select_project_files(files: DataFrame, kind: str) -> DataFrame:
    """Files of a kind by the end of their key, case-sensitive: "python" or "manifest"."""
    ends = (".py",) if kind == "python" else MANIFESTS
    wanted = F.lit(False)
    for end in ends:
        wanted = wanted | F.col("key").endswith(end)
    return files.filter(wanted)


def object_key(user: Column, filename: Column, uuid: Column, tag: Column) -> Column:
    """``{user}/{filename}/{uuid}/{tag}``; a null tag prints as None."""
    return F.concat_ws("/", user, filename, uuid, F.coalesce(tag, F.lit("None")))


def parse_object_key(key: Column) -> Column:
    """Struct of user, filename, uuid, tag, relpath of ``{user}/{filename}/{uuid}/{tag}/unpacked/{relpath}``."""
    pattern = r"^([^/]*)/([^/]*)/([^/]*)/([^/]*)/unpacked/(.*)$"
    return F.struct(*(F.regexp_extract(key, pattern, i + 1).alias(n) for i, n in enumerate(("user", "filename", "uuid", "tag", "relpath"))))


def project_path(key: Column) -> Column:
    """The part of a key up to and with ``/unpacked/``."""
    return F.regexp_extract(key, "^.*?/unpacked/", 0)


def unpack_archives(archives: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """(base, key, content, error): one row per file of each archive, or one error row for an archive that can't be read whole.

    archives: user, filename, uuid, tag, content. Rules of names and entries are those of ``sources.archives``. An archive is read
    once to see that all of it can be read, and once more to give its files, one at a time, so its unpacked size needs no
    bound; ``most_bytes``, if given, refuses archives of more. For archives that are no single value, see ``read_archives``.
    """

    def run(batches):
        pairs = ((base, x.as_py()) for batch in batches for base, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        yield from batched((row for base, content in pairs for row in unpack_rows(base, content, most_bytes)), _UNPACKED, 2)

    base = object_key(F.col("user"), F.col("filename"), F.col("uuid"), F.col("tag"))
    return archives.select(base.alias("base"), "content").mapInArrow(run, "base string, key string, content binary, error string")


def write_graph_parts(parts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parts as Parquet, a folder for each status; inside a file, and from one file to the next, by task_id and response_id.

    Ranges, not hashes, deal the rows, so a task of very many parts is spread over several files.
    """
    order = ["status", "task_id", "response_id"]
    parts.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("status").parquet(path)


def stream_graph_parts(parts: DataFrame, path: str) -> StreamingQuery:
    """Start a stream of parts into Parquet below ``path``, a folder for each status, over what is there now."""
    return parts.writeStream.format("parquet").partitionBy("status").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)


def stream_ordered_parts(parts: DataFrame, path: str) -> StreamingQuery:
    """Start a stream of parts whose micro-batches are each written as ``write_graph_parts`` does, in a folder of their own (``batch``).

    A micro-batch that failed anywhere before its commit writes its folder again after a restart, so no part is lost or twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        write_graph_parts(batch, f"{path}/batch={number}", mode="overwrite")

    return parts.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
