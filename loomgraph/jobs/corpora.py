"""Source files, manifests, messages, parts and accounts, made from the test tables by string templates."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PYTHON = """from fastapi import APIRouter
import os.path as osp
router = APIRouter(prefix={prefix})

@router.get("/{k}", response_model=Out{k4})
async def h_{k7}(svc: C{k25}, q: int) -> Res{k3}:
    svc.run(q)
    h_{k317}()
    missing_{k}()
    return osp.join("a")

class C{k5}:
    @staticmethod
    def run(x):
        return h_{k7}()

    def plain(self):
        return x

def undecorated():
    return 1
{end}"""
TOML = """[project{close}
name = "x"
dependencies = ["zlib{k9}>=1", "uvicorn[standard]>=1", "uvicorn~=2"]
[tool.poetry.dependencies]
Python = "^3.13"
alpha{k6} = "*"
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(template: str, **columns):
    """The template with columns in its ``{name}`` places."""
    parts, rest = [], template
    while rest:
        text, _, rest = rest.partition("{")
        parts.append(F.lit(text))
        if rest:
            name, _, rest = rest.partition("}")
            parts.append(columns[name].cast("string"))
    return F.concat(*parts)


def files(rows: DataFrame, task, path, text) -> DataFrame:
    project = F.concat(F.lit("t"), task.cast("string"), F.lit("/unpacked/"))
    return rows.select(task.cast("long").alias("task_id"), project.alias("project_path"), F.concat(project, path).alias("key"), text.cast("binary").alias("content"))


def padded(k):
    return F.lpad(k.cast("string"), 8, "0")


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    prefix = F.when((k % 13 == 0) & (k % 11 != 0), F.lit("PREFIX")).otherwise(F.concat(F.lit('"/s'), s.cast("string"), F.lit('"')))
    end = F.when(k % 11 == 0, F.lit("def broken(:\n")).otherwise(F.lit(""))
    text = filled(PYTHON, prefix=prefix, k=k, k4=k % 4, k7=k % 7, k25=(k + 2) % 5, k3=k % 3, k317=(k * 3 + 1) % 7, k5=k % 5, end=end)
    return files(table(spark, sf_dir, "part").select("p_partkey", "p_size"), s, F.concat(padded(k), F.lit(".py")), text)


def requirements_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    text = filled("# {seg}\n  {low}>=1.{k10}\r\n\npkg{k97}[x]==2\nplain\n", seg=segment, low=F.lower(segment), k10=k % 10, k97=k % 97)
    name = F.when(k % 2 == 0, F.lit("/requirements.txt")).otherwise(F.lit("/dev-requirements.txt"))
    return files(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), n, F.concat(padded(k), name), text)


def pyproject_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    whole = filled(TOML, close=F.lit("]"), k9=k % 9, k6=k % 6)
    text = F.when(k % 10 == 0, F.lit("[project")).otherwise(whole)
    return files(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), n, F.concat(padded(k), F.lit("/pyproject.toml")), text)


def task_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("t"), (1 + F.col("user_id") % 50).cast("string"), F.lit("/unpacked/"))
    body = F.when(F.col("event_type") == "error", "not json").otherwise(F.to_json(F.struct(F.col("event_id").alias("task_id"), path.alias("project_path"))))
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id").select(body.alias("body"))


def conversation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    status = F.when(F.col("turn") == F.col("last"), "DONE").when(F.col("role") == "user", "REQUIREMENTS").when(F.col("role") == "assistant", "ARHITECTURE").otherwise("ENDPOINTS")
    turn = F.col("turn").cast("string")
    rows = rows.join(last, "conv_id").select(F.col("conv_id").alias("task_id"), (F.col("turn") + 1).cast("int").alias("response_id"), status.alias("status"), "role", "turn")
    return rows.select(
        "task_id",
        "response_id",
        "status",
        F.when(F.col("status") == "REQUIREMENTS", F.struct(F.lit(1).cast("long").alias("total"), F.array(F.concat("role", turn)).alias("requirements"))).alias("requirements"),
        F.when(F.col("status") == "ENDPOINTS", F.struct(F.lit(1).cast("long").alias("total"), F.create_map(F.concat(F.lit("e"), turn), F.concat(F.lit("GET /"), turn)).alias("endpoints"))).alias("endpoints"),
        F.when(F.col("status") == "ARHITECTURE", F.struct(F.concat(F.lit("p"), (F.col("turn") % 2).cast("string")).alias("parent"), F.array(F.concat(F.lit("c"), turn)).alias("children"))).alias("architecture"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("surname"), F.col("c_name").alias("login"), F.when(k % 3 != 0, F.concat("c_name", F.lit("@x"))).alias("email"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_custkey % 4 <> 0")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("description"), F.lit("").alias("picture_url"))


def zip_archives(sources: DataFrame, most: int = 50) -> DataFrame:
    """ZIP archives of the files of (task_id, key, content), about ``most`` ways for each task."""

    def run(data: pa.Table) -> pa.Table:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for key, content in sorted(zip(data["key"].to_pylist(), data["content"].to_pylist(), strict=True)):
                z.writestr(key.partition("/unpacked/")[2], content)
        return pa.table({"user": [str(data["task_id"][0].as_py())], "filename": ["src.zip"], "uuid": [str(data["part"][0].as_py())], "tag": pa.array([None], pa.string()), "content": pa.array([raw.getvalue()], pa.binary())})

    part = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(most)).cast("int")
    return sources.select("task_id", part.alias("part"), "key", "content").groupBy("task_id", "part").applyInArrow(run, "user string, filename string, uuid string, tag string, content binary")


def write_files(rows: DataFrame, folder: str) -> None:
    """Each (name, content) as a file below ``folder``, which all executors reach."""

    def run(batches):
        from ..sources.folders import created

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                created(f"{folder}/{name}", content.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    rows.select("name", "content").mapInArrow(run, "name string").count()
