"""Stored tables, large texts and restarts."""

import os
import random

import pytest

from loomgraph.jobs.scratch import scratch
from loomgraph.operators import projects
from loomgraph.sources import files as sources
from loomgraph.sources import folders


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
def test_lines_of_ranges_are_those_of_whole_files(spark, tmp_path, size):
    rng = random.Random(size)
    texts = {"empty": "", "one": "\n", "plain": "a\nb\n", "none": "abc", "é": "é\n\n\nü🙂\n日本\r\nx"}
    texts |= {f"r{i}": "".join(rng.choices(["a", "\n", "é", "bc"], k=rng.randrange(12))) for i in range(12)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad").write_bytes(b"a\nb\xff\nc\n")
    got = {}
    for r in folders.read_lines(spark, str(tmp_path), range_bytes=size).collect():
        got.setdefault(os.path.basename(r.path), []).append((r.line_no, r.line, r.error))
    assert got.pop("bad") == [(None, None, "not UTF-8")]
    assert {n: [x[1] for x in sorted(v)] for n, v in got.items()} == {n: t.split("\n") for n, t in texts.items()}
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in got.values())


def test_a_large_text_is_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    with open(tmp_path / "large", "w") as f:
        for i in range(400_000):
            f.write(f"line {i} " + "x" * (i % 90) + "\n")
    rows = folders.read_lines(spark, str(tmp_path), range_bytes=1 << 20)
    assert rows.rdd.getNumPartitions() >= 8
    assert rows.filter("line <> ''").select((F.concat(F.lit("line "), F.col("line_no").cast("string")) == F.substring_index("line", " ", 2)).alias("ok")).groupBy("ok").count().collect()[0] == (True, 400_000)


def test_many_small_texts_take_few_tasks(spark, tmp_path):
    """Tasks follow the bytes and openings, not the number of ranges; one text of several ranges among them keeps its numbers."""
    for i in range(1500):
        (tmp_path / str(i % 7)).mkdir(exist_ok=True)
        (tmp_path / str(i % 7) / f"f{i}").write_text(f"{i}\n\né{i}")
    (tmp_path / "long").write_text("\n".join(str(i) for i in range(500)) + "\n" + "x" * 9000 + "\nend")
    (tmp_path / "bad").write_bytes(b"a\nb\xff\nc\n")
    rows = folders.read_lines(spark, str(tmp_path), range_bytes=256)
    assert rows.rdd.getNumPartitions() <= 16
    got = {}
    for r in rows.collect():
        got.setdefault(os.path.basename(r.path), []).append((r.line_no, r.line, r.error))
    assert got.pop("bad") == [(None, None, "not UTF-8")]
    assert sorted(got.pop("long")) == [*((i, str(i), None) for i in range(500)), (500, "x" * 9000, None), (501, "end", None)]
    assert {n: sorted(v) for n, v in got.items()} == {f"f{i}": [(0, f"{i}", None), (1, "", None), (2, f"é{i}", None)] for i in range(1500)}


def test_source_files_are_stored_by_task(spark, tmp_path):
    bodies = {"u/a.zip/1/None/unpacked/__init__.py": b"", "u/a.zip/1/None/unpacked/d/x.py": b"x", "u/b.zip/2/t/unpacked/y.py": b"y", "stray": b"z"}
    for name, body in bodies.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    jobs = spark.createDataFrame([(1, "u/a.zip/1/None/unpacked/"), (2, "u/b.zip/2/t/unpacked/"), (3, "none/unpacked/")], "task_id long, project_path string")
    rows = sources.source_files(folders.read_directory(spark, str(tmp_path / "in")), jobs, str(tmp_path / "in"))
    spark.sql("DROP TABLE IF EXISTS stored_files")
    stored = sources.store_source_files(rows.repartition(5), "stored_files", str(tmp_path / "table"), 4)
    assert sorted((r.task_id, r.key, bytes(r.content)) for r in stored.collect()) == sorted((1 if "a.zip" in k else 2, k, b) for k, b in bodies.items() if k != "stray")
    other = sources.store_source_files(rows, "stored_again", str(tmp_path / "again"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.join(other.groupBy("task_id").count(), "task_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and len([n for n in os.listdir(tmp_path / "table") if n.endswith(".parquet")]) <= 4


def test_patches_change_touched_folders_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", None if i % 2 else "s") for i in range(500)], "id long, name string, surname string")
    patches = spark.createDataFrame([(3, 1, "a", None), (3, 2, None, "b"), (3, 3, "c", None), (7, 1, None, "z"), (9999, 1, "none", None), (None, 1, "x", "x")], "id long, seq long, name string, surname string")
    path = str(tmp_path / "t")
    projects.store_rows(rows, path, 16)

    def files():
        return {(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}

    old = files()
    touched = projects.merge_patches(spark, path, patches, ["name", "surname"], 16)
    assert 1 <= len(touched) <= 2
    kept = {k: v for k, v in old.items() if int(k[0].rsplit("=", 1)[1]) not in touched}
    assert kept.items() <= files().items()
    want = projects.apply_patches(rows, patches, ["name", "surname"])
    assert sorted(map(str, spark.read.parquet(path).select(rows.columns).collect())) == sorted(map(str, want.collect()))
    assert projects.merge_patches(spark, path, patches.filter("id = 9999"), ["name"], 16) == []


def test_a_failed_micro_batch_gives_its_parts_once(spark, monkeypatch):
    path, out = scratch(spark, "parts"), scratch(spark, "ordered")
    schema = "task_id long, response_id int, status string"
    for k in range(3):
        spark.createDataFrame([(t, r, "DONE" if r == 5 else "ENDPOINTS") for t in range(k, 9, 3) for r in range(1, 6)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    write, calls = sources.write_graph_parts, []

    def failing(rows, where, mode):
        write(rows, where, mode)
        calls.append(where)
        if len(calls) == 2:
            raise RuntimeError("lost after the write, before the commit")

    monkeypatch.setattr(sources, "write_graph_parts", failing)
    with pytest.raises(Exception, match="lost"):
        sources.stream_ordered_parts(stream, out).awaitTermination()
    sources.stream_ordered_parts(stream, out).awaitTermination()
    got = sorted((r.task_id, r.response_id) for r in spark.read.parquet(out).collect())
    assert got == sorted((t, r) for t in range(9) for r in range(1, 6)) and len(calls) == 4
    for name in spark.read.parquet(out).inputFiles():
        order = [(r.task_id, r.response_id) for r in spark.read.parquet(name).coalesce(1).collect()]
        assert order == sorted(order)
