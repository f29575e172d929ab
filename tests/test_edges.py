"""Hand-made sources, one for each rule."""

import io
import json
import os
import tarfile
import time
import zipfile

import pandas as pd
import pytest

from loomgraph.functions.pyparse import parse_source, parse_sources
from loomgraph.jobs import queries
from loomgraph.jobs.scratch import scratch
from loomgraph.operators import callgraph, dependencies, endpoints, extract, parts, projects
from loomgraph.sources import files as sources
from loomgraph.sources import folders
from loomgraph.streaming import tasks

def one(text, **options):
    return parse_source(text.encode(), **options)

def decorated(text):
    return one(text)["functions"]

@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("from . import a", [("from", None, "a", None, 1)]),
        ("import a, b as c", [("import", "a", None, None, None), ("import", "b", None, "c", None)]),
        ("def f():\n import a", []),
    ],
)
def test_imports(text, want):
    assert [tuple(r[k] for k in ("type", "module", "name", "alias", "level")) for r in one(text)["imports"]] == want

@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('r = fastapi.APIRouter("x")', {"r": ""}),
        ('r: APIRouter = APIRouter(prefix="/p")', {}),
        ('a = FastAPI(prefix="/p", root_path="/r")', {"a": "/r"}),
        ('r = APIRouter(prefix="/a")\nr = APIRouter(prefix="/b")', {"r": "/b"}),
        ("r = APIRouter(prefix=None)", {"r": "None"}),
        ('a, b = t["k"]()', {}),
    ],
)
def test_routers(text, want):
    row = one(text)
    assert row["error"] is None and dict(row["routers"]) == want

@pytest.mark.parametrize("text", ['import a\nr = APIRouter(prefix="/a" + "/b")', 'import a\nx = t["k"]()', "def f(:", "\0"])
def test_failing_files(text):
    row = one(text + "\n@d\ndef f(): pass" if "def f(:" not in text else text)
    assert row["error"] and not row["functions"] and not row["routers"]

def test_redefinition_keeps_its_place():
    found = decorated("@d\ndef f(): a()\n@d\ndef g(): pass\n@d\ndef f(): b()\nclass C:\n @property\n def x(self): pass\n @x.setter\n def x(self, v): pass\n class D:\n  @d\n  def y(): pass\nif True:\n @d\n def z(): pass")
    assert [(f["fn_key"], f["pos"], f["calls"], f["args"]) for f in found] == [("f", 0, ["b"], []), ("g", 1, [], []), ("C.x", 2, [], ["self", "v"])]

def test_arguments_and_calls():
    (f,) = decorated("@d\ndef f(a, /, b: T, *, c: U, d: list[int]):\n q().z()\n w[0].k()\n w[1]()\n (1+2).bit()")
    assert f["args"] == ["b"] and dict(f["arg_types"]) == {"b": "T"} and sorted(f["calls"]) == ["bit", "k", "q", "q.z"]
    assert not decorated("def f(): pass") and len(one("def f(): pass", include_undecorated=True)["functions"]) == 1

def files(spark, *texts, suffix=".py"):
    return spark.createDataFrame([(1, "p/", f"p/{i}{suffix}", t.encode()) for i, t in enumerate(texts)], "task_id long, project_path string, key string, content binary")

def functions(spark, *texts, **options):
    return extract.extract_functions(parse_sources(files(spark, *texts), **options))

def test_endpoints(spark):
    cases = ['@r.get("/a", "/b", x)', '@r.get(path="/a")', '@r.GET("/a")', '@api.v1.get("/a")', '@get("/a")', '@r.head("/a")', "@cache.get", "@r.get('/m', response_model=list[M])", "@r.get('/m', response_model=a.B)", "@r.get('/m', response_model=None)", "@r.get('/m', response_model=M | None)"]
    text = 'r = APIRouter(prefix="/p")\n' + "".join(f"{c}\ndef f{i}() -> X: pass\n" for i, c in enumerate(cases))
    got = {r.function: (r.method, r.path, r.response_model) for r in endpoints.endpoints(functions(spark, text)).collect()}
    assert got == {"f0": ("GET", "/p/b", "X"), "f1": ("GET", "/p", "X"), "f2": ("GET", "/p/a", "X"), "f6": ("GET", "", "X"), "f7": ("GET", "/p/m", "list"), "f8": ("GET", "/p/m", "a.B"), "f9": ("GET", "/p/m", "None"), "f10": ("GET", "/p/m", "M")}
    stacked = '@cache\n@r.get("/")\ndef f(): pass'
    assert endpoints.endpoints(functions(spark, stacked)).count() == 0
    assert endpoints.endpoints(functions(spark, stacked, include_undecorated=True)).count() == 1

@pytest.mark.parametrize(
    ("line", "want"),
    [("fastapi>=0.1", "fastapi"), ("uvicorn[standard]==1", "uvicorn[standard]"), ("-r base.txt", "-r base.txt"), ("==1", None), ("a # x==1", "a # x"), (" # c", None), ("pkg @ https://h/p.whl", "pkg @ https://h/p.whl"), ("git+https://x/y.git@v1#egg=z", "git+https://x/y.git@v1#egg"), ("\u00a0\u2003a\u2003", "a"), ("\x1ca\x1f", "a")],
)
def test_requirement_lines(spark, line, want):
    row = dependencies.parse_requirements(files(spark, line, suffix="requirements.txt")).first()
    assert row.packages == ([want] if want else []) and row.error is None

def test_pyproject_and_last_good_manifest(spark):
    toml = '[project]\ndependencies = ["foo; python_version<\'3\'", "foo;python_version<\'3\'", "pkg @ https://x"]\n[tool.poetry.dependencies]\nPYTHON = "3"\nb = "*"'
    row = dependencies.parse_pyproject(files(spark, toml, suffix="pyproject.toml")).first()
    assert row.packages == ["b", "foo;", "foo;python_version", "pkg"]
    two = spark.createDataFrame([(1, "p/a/requirements.txt", ["x"], None), (1, "p/b/requirements.txt", None, "not UTF-8")], "task_id long, key string, packages array<string>, error string")
    assert [tuple(r) for r in dependencies.project_dependencies(two, two.limit(0)).collect()] == [(1, "requirements.txt", "p/a/requirements.txt", ["x"], 1)]

def resolved(spark, *texts, how=callgraph.resolve_calls_asof):
    return {(r.fn_key, r.call): r.target for r in how(functions(spark, *texts)).collect()}

def test_resolution(spark):
    early, late = "@d\ndef f():\n f()\n g()\n h()", "@d\ndef g(): pass\n@d\ndef h(): pass"
    assert resolved(spark, early, late) == {("f", "f"): "p/0.py/None.f", ("f", "g"): None, ("f", "h"): None}
    assert resolved(spark, early, late, how=callgraph.resolve_calls_global)["f", "g"] == "p/1.py/None.g"
    assert resolved(spark, late, late, early)["f", "g"] == "p/1.py/None.g"
    typed = "class S:\n @d\n def run(self): pass\n"
    call = "@d\ndef f(svc: S):\n svc.run()\n svc.a.b()\n svc()"
    assert resolved(spark, typed, call) == {("f", "svc.run"): "p/0.py/S.run", ("f", "svc.a.b"): None, ("f", "svc"): None}
    assert resolved(spark, typed, "@d\ndef f(*, svc: S):\n svc.run()")["f", "svc.run"] is None
    assert callgraph.call_graph(functions(spark, "@d\ndef f(): pass")).first().children == []

@pytest.mark.parametrize("n", [1, 7, 64])
def test_partitions_do_not_matter(spark, n):
    texts = ["@d\ndef f():\n f()\n g()", "@d\ndef g():\n f()", "@d\ndef f():\n g()"]
    rows = functions(spark, *texts)
    want = sorted(map(str, callgraph.call_graph(rows).collect()))
    assert sorted(map(str, callgraph.call_graph(rows.repartition(n)).collect())) == want

def test_bare_project_has_two_parts(spark):
    none = functions(spark, "")
    maps = endpoints.endpoint_map(endpoints.endpoints(none), files(spark, ""))
    empty = spark.createDataFrame([], "task_id long, manifest string, place string, packages array<string>, total long")
    got = parts.graph_parts(empty, maps, callgraph.call_graph(none)).orderBy("response_id").collect()
    assert [(r.response_id, r.status) for r in got] == [(1, "ENDPOINTS"), (2, "DONE")] and got[0].endpoints.total == 0

def test_messages(spark):
    bodies = [json.dumps({"task_id": 1, "project_path": "p"}), json.dumps({"task_id": 2}), "[1]", "nope", None]
    good, bad = tasks.read_task_messages(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert [tuple(r) for r in good.collect()] == [(1, "p")] and bad.count() == 4

def archive(kind, names):
    raw = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(raw, "w") as z:
            for n in names:
                z.writestr(n, n)
    else:
        with tarfile.open(fileobj=raw, mode="w:gz" if kind == "gz" else "w") as t:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size = len(n)
                t.addfile(info, io.BytesIO(n.encode()))
    return raw.getvalue()

def test_archives(spark):
    rows = [("u", k, "1", None, archive(k, ["a.py", "d/b.py"])) for k in ("zip", "tar", "gz")]
    rows += [("u", "bad", "1", None, b"no archive"), ("u", "none", "1", None, archive("zip", [])), ("u", "up", "1", "t", archive("zip", ["ok", "../x"])), ("u", "null", "1", None, None)]
    got = sources.unpack_archives(spark.createDataFrame(rows, "user string, filename string, uuid string, tag string, content binary")).collect()
    assert sorted(r.key for r in got if r.error is None) == sorted(f"u/{k}/1/None/unpacked/{n}" for k in ("zip", "tar", "gz") for n in ("a.py", "d/b.py"))
    assert {r.base.split("/")[1]: r.error for r in got if r.error}.keys() == {"bad", "up", "null"}

def test_text_lines_and_plan(spark):
    rows = spark.createDataFrame([(1, "a", b"x\ny\n"), (1, "b", b"\xff")], "task_id long, key string, content binary")
    assert [(r.key, r.line, r.error) for r in sources.read_text_lines(rows).orderBy("key", "line_no").collect()] == [("a", "x", None), ("a", "y", None), ("a", "", None), ("b", None, "not UTF-8")]
    plan = callgraph.call_graph(functions(spark, "x = 1"))._jdf.queryExecution().toString()
    assert not any(bad in plan for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"))

def listed(df):
    return sorted(map(str, df.collect()))

def test_equal_contents_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, "a.py", b"import x"), (2, "b.py", b"import x"), (2, "c.py", b"@d\ndef f(): g()"), (3, "n.py", None)], "task_id long, key string, content binary")
    assert listed(parse_sources(rows, once=True).select(*parse_sources(rows).columns)) == listed(parse_sources(rows))

def test_asof_equals_global_if_definitions_come_first(spark):
    texts = ["@d\ndef g(): pass\nclass S:\n @d\n def run(self): pass", "@d\ndef f(s: S):\n g()\n s.run()\n len()\n s.other()"]
    rows = functions(spark, *texts)
    assert listed(callgraph.resolve_calls_asof(rows)) == listed(callgraph.resolve_calls_global(rows))
    assert callgraph.resolve_calls_asof(rows).count() == 4 + rows.filter("size(calls) > 0 and fn_key <> 'f'").count()

@pytest.mark.parametrize("most", [1, 2, 3])
def test_names_with_many_definitions(spark, most):
    """More definitions of a name than go into one array: ranges, each with its own sort, give the same."""
    texts = [f"@d\ndef {'f' if i % 3 else 'g'}(s: S):\n f()\n g()\n s.run()\n len()" if i % 4 else "class S:\n @d\n def run(self): f()" for i in range(23)]
    rows = functions(spark, *texts)
    assert listed(callgraph.resolve_calls_asof(rows, most)) == listed(callgraph.resolve_calls_asof(rows))

def test_parts_are_numbered_without_gaps_and_end_in_done(spark):
    sources_ = files(spark, "@d\ndef f(): pass\n@r.get('/')\ndef g(): f()").unionByName(files(spark, "a", "b", suffix="/requirements.txt"))
    sources_ = sources_.selectExpr("task_id", "project_path", "replace(key, 'p/', 'p/unpacked/') AS key", "content")
    jobs = spark.createDataFrame([(7, "p/unpacked/"), (8, "p/unpacked/"), (9, "q/unpacked/")], "task_id long, project_path string")
    batch = tasks.parts_of_tasks(jobs, sources_)
    for task in (7, 8, 9):
        rows = batch.filter(f"task_id = {task}").orderBy("response_id").collect()
        assert [r.response_id for r in rows] == list(range(1, len(rows) + 1)) and [r.status for r in rows][-1] == "DONE"
        assert len(rows) == (5 if task < 9 else 2)
    path = scratch(spark, "jobs")
    for k in range(2):
        jobs.filter(f"task_id % 2 = {k}").coalesce(1).write.mode("append").parquet(path)
    out = scratch(spark, "stream")
    tasks.stream_parts(spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(path), sources_, out).awaitTermination()
    assert listed(spark.read.parquet(out).select(*batch.columns)) == listed(batch)

def test_written_parts_are_in_order(spark):
    rows = spark.createDataFrame([(t, r, "DONE" if r == 9 else "ENDPOINTS") for t in range(40) for r in range(10)], "task_id long, response_id int, status string").repartition(5)
    path = scratch(spark, "parts")
    sources.write_graph_parts(rows, path)
    for name in spark.read.parquet(f"{path}/status=ENDPOINTS").inputFiles():
        got = [(r.task_id, r.response_id) for r in spark.read.parquet(name).coalesce(1).collect()]
        assert got == sorted(got)
    streamed = scratch(spark, "parts")
    sources.stream_graph_parts(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), streamed).awaitTermination()
    assert listed(spark.read.parquet(streamed)) == listed(spark.read.parquet(path))

@pytest.mark.parametrize("split", [1, 3])
def test_sessions_equal_their_batch_twin(spark, split):
    rows = spark.createDataFrame([(t, r, "DONE" if r == 4 and t % 3 else "ENDPOINTS") for t in range(6) for r in range(1, 5)], "task_id long, response_id int, status string")
    path = scratch(spark, "sessions")
    for k in range(split):
        rows.filter(f"response_id * {split} > {4 * k} and response_id * {split} <= {4 * (k + 1)}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert listed(tasks.drain(tasks.task_sessions(stream), "done")) == listed(tasks.finished_tasks(rows))

def test_accounts_and_projects(spark):
    accounts = spark.createDataFrame([(1, "a", None), (2, None, "x")], "id long, login string, email string")
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, None)], "seq long, login string")
    free, refused = projects.reject_taken(wanted, accounts, "login", "seq")
    assert sorted(r.seq for r in free.collect()) == [2, 4, 5] and sorted(r.seq for r in refused.collect()) == [1, 3]
    own = spark.createDataFrame([(10, 1, "p"), (11, 2, "q")], "id long, author_id long, name string")
    asked = spark.createDataFrame([(10, 1), (10, 1), (11, 1), (12, 1), (None, 1)], "project_id long, account_id long")
    assert [r.id for r in projects.delete_owned_projects(own, asked).collect()] == [11]
    assert sorted((r.found, r.name) for r in projects.owned_projects(asked, own).collect() if r.found) == [(True, "p")] * 2

def test_folder_of_files(spark):
    path = scratch(spark, "folder")
    spark.createDataFrame([("x",)], "body string").coalesce(1).write.text(f"{path}/a/b")
    rows = folders.read_directory(spark, path).filter("path LIKE '%.txt'").collect()
    assert [bytes(r.content) for r in rows] == [b"x\n"] and "/a/b/" in rows[0].path

def test_folder_keeps_empty_files_and_odd_names(spark, tmp_path):
    bodies = {"a.py": b"x", ".env": b"", "d/__init__.py": b"z", "_private/e/f.py": b"", "d/b c+d%20é.py": b"y", "d/e +%.py": b""}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = folders.read_directory(spark, str(tmp_path))
    assert {r.path.removeprefix(f"file:{tmp_path}/"): bytes(r.content) for r in rows.collect()} == bodies
    assert {r.path.removeprefix(f"file:{tmp_path}/"): r.length for r in folders.list_directory(spark, f"file://{tmp_path}/").collect()} == {n: len(b) for n, b in bodies.items()}

def test_paths_are_any_opening_of_keys(spark):
    keys = ["p/unpacked/a.py", "p/unpacked/sub/b.py", "p/unpacked/sub/deep/c.py", "p/unpacked2/d.py", "q/x", "p", "", "/", "//r/", "é/ü\nv/w"]
    paths = ["p/", "p/unpacked/", "p/unpacked", "p/unpacked/sub/", "p/unpacked/sub/deep/c.py", "p/unp", "", "q/x/", "/", "//", "é/ü\n", "none/", "p/unpacked/sub/b.pyc", "qq", "p/unpacked/s", "p/unpacked/sub", None]
    tasks_ = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(99, "p/")], "task_id long, project_path string")
    files_ = spark.createDataFrame([(k,) for k in keys], "key string")
    got = sorted((r.task_id, r.project_path, r.key) for r in tasks.task_files(tasks_, files_).collect())
    assert got == sorted((i, p, k) for i, p in [*enumerate(paths), (99, "p/")] if p is not None for k in keys if k.startswith(p))
    assert sorted(r.project_path for r in tasks.missing_projects(tasks_.filter("project_path is not null"), files_).collect()) == ["none/", "p/unpacked/sub/b.pyc", "q/x/", "qq"]
    plan = tasks.task_files(tasks_, files_)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

def most_rows(df):
    """The most rows that any join or aggregate of ``df`` gives out when it runs."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name or "Aggregate" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
        todo += inner + [children.apply(i) for i in range(children.size())]
    return max(found)

def test_files_are_counted_without_pairs(spark, sf_dir):
    """2,000 messages about 2,000 files: no step of the count makes their 4,000,000 pairs."""
    tasks_ = spark.range(2000).selectExpr("id AS task_id", "if(id % 2 = 0, 'p/', 'p/unpacked/') AS project_path")
    tasks_ = tasks_.unionByName(spark.createDataFrame([(0, "p/"), (1, "none/"), (5000, None), (5001, "p/unpacked/0")], "task_id long, project_path string"))
    files_ = spark.range(2000).selectExpr("concat('p/unpacked/', id, '.py') AS key")
    got = tasks.file_counts(tasks_, files_)
    assert {(r.task_id, r.project_path): r.n_files for r in got.collect()} == {(i, "p/unpacked/" if i % 2 else "p/"): 2000 for i in range(2000)} | {(0, "p/"): 4000, (5001, "p/unpacked/0"): 1}
    listing = tasks.task_files(tasks_.limit(20), files_).groupBy("task_id").count()
    assert most_rows(listing) >= 40_000 and most_rows(got) < 20_000
    counts = queries.o31_task_files(spark, sf_dir)
    pairs = counts.selectExpr("sum(n_files)").first()[0]
    assert most_rows(counts) < pairs

@pytest.mark.parametrize("batches", [1, 2])
def test_a_repeated_message_gives_its_parts_once(spark, batches):
    sources_ = files(spark, "@d\ndef f(): pass\n@r.get('/')\ndef g(): f()").selectExpr("task_id", "project_path", "replace(key, 'p/', 'p/unpacked/') AS key", "content")
    rows = [(7, "p/unpacked/"), (7, "p/unpacked/"), (8, "p/"), (9, "p/unpacked/no/")]
    jobs = spark.createDataFrame(rows, "task_id long, project_path string")
    batch = tasks.parts_of_tasks(jobs, sources_)
    got = {t: sorted(r.response_id for r in batch.filter(f"task_id = {t}").collect()) for t in (7, 8, 9)}
    assert got == {7: [1, 2, 3, 4], 8: [1, 2, 3, 4], 9: [1, 2]}
    path, out = scratch(spark, "jobs"), scratch(spark, "stream")
    for _ in range(batches):
        jobs.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    top = os.path.dirname(scratch(spark, "x").removeprefix("file://"))
    before = set(os.listdir(top))
    tasks.stream_parts(stream, sources_, out).awaitTermination()
    assert listed(spark.read.parquet(out).select(*batch.columns)) == listed(batch)
    assert all(name.startswith("stream") for name in set(os.listdir(top)) - before)

def test_messages_are_remembered_by_bucket(spark):
    """The state has a row for each bucket, not for each task, and still each task passes once, with the least path of its micro-batch."""
    path, out, far = scratch(spark, "messages"), scratch(spark, "once"), 1 << 62
    schema = "task_id long, project_path string"
    spark.range(5000).selectExpr(f"id + {far} AS task_id", "explode(array('c/', 'b/', 'é/')) AS project_path").repartition(1).write.parquet(path)
    again = spark.range(4000, 7000).selectExpr(f"id + {far} AS task_id", "'a/' AS project_path")
    again.unionByName(spark.createDataFrame([(None, "p/"), (1, None)], schema)).coalesce(1).write.mode("append").parquet(path)
    stream = tasks.first_messages(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), buckets=16)
    with tasks.keyed_state(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    got = sorted((r.task_id - far, r.project_path) for r in spark.read.parquet(out).collect())
    assert got == [(i, "b/" if i < 5000 else "a/") for i in range(7000)]
    assert [p["numInputRows"] for p in query.recentProgress] == [15000, 3002]
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16

def test_messages_are_forgotten_one_by_one():
    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Clock:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = lambda: now

    def passed(now, *rows):
        found = first.handleInputRows((0,), iter([pd.DataFrame(rows[:1], columns=["task_id", "project_path"]), pd.DataFrame(rows[1:], columns=["task_id", "project_path"])]), Clock(now))
        return sorted(row for batch in found for row in batch.itertuples(index=False, name=None))

    first = tasks.FirstMessages(10)
    first.seen = State()
    assert passed(0, (1, "b"), (1, "a")) == [(1, "a")]
    assert passed(6000, (1, "z"), (2, "x")) == [(2, "x")]
    assert passed(9999, (1, "z"), (2, "y")) == []
    assert passed(10_000, (1, "z"), (2, "y")) == [(1, "z")]
    assert passed(16_000, (2, "y"), (1, "q")) == [(2, "y")]

def test_bad_messages_are_a_stream_of_their_own(spark):
    path, out = scratch(spark, "bodies"), scratch(spark, "read")
    for body in ('{"task_id": 1, "project_path": "p/"}', "nope"):
        spark.createDataFrame([(body,)], "body string").coalesce(1).write.mode("append").text(path)
    bodies = spark.readStream.text(path).withColumnRenamed("value", "body")
    for _ in range(2):  # starting again adds nothing
        tasks.stream_messages(bodies, out).awaitTermination()
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{out}/tasks").collect()] == [(1, "p/")] and [r.body for r in spark.read.parquet(f"{out}/refused").collect()] == ["nope"]

def test_unfinished_sessions_expire(spark):
    path, out = scratch(spark, "sessions"), scratch(spark, "ended")
    schema = "task_id long, response_id int, status string"
    spark.createDataFrame([(1, 1, "ENDPOINTS"), (2, 1, "ENDPOINTS"), (2, 2, "DONE")], schema).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tasks.ROCKSDB)
    stream = tasks.task_sessions(spark.readStream.schema(schema).parquet(path), expire_after=3)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(processingTime="1 second").start(out)
    try:
        until = time.time() + 60
        while time.time() < until:
            rows = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()) if os.path.isdir(out.removeprefix("file://")) else []
            state = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress and query.lastProgress["stateOperators"] else None
            if len(rows) == 2 and state == 0:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert rows == [(1, 1, "ENDPOINTS", True), (2, 2, "ENDPOINTS,DONE", False)] and state == 0

def test_parts_of_a_huge_task_are_numbered_by_ranges(spark):
    keys = spark.range(200_000).selectExpr("if(id % 10 < 8, 1, id % 7) AS task_id", "cast(id % 4 AS int) AS stage", "cast(id % 1000 AS string) AS k", "cast(id AS int) AS p")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = parts.numbered(keys)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = keys.selectExpr("*", "row_number() over (partition by task_id order by stage, k, p) AS response_id")
    assert got.exceptAll(want).count() == 0 and got.count() == 200_000

def test_long_chains_of_calls():
    (f,) = decorated("@d\ndef f():\n q" + "().z" * 2500 + "()")
    assert f["calls"][0] == "q" + ".z" * 2500 and len(f["calls"]) == 2501

def test_call_plans_read_functions_once(spark):
    fn = scratch(spark, "functions")
    functions(spark, "@d\ndef f(s: S):\n f()\n s.run()").write.parquet(fn)
    plan = callgraph.resolve_calls_asof(spark.read.parquet(fn))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Window" in plan and plan.count("FileScan") <= 3

def test_dependencies_that_are_no_text_and_equal_places(spark):
    row = dependencies.parse_pyproject(files(spark, '[project]\ndependencies = ["a", {b = 1}]', suffix="pyproject.toml")).first()
    assert row.packages is None and row.error.startswith("TypeError")
    rows = spark.createDataFrame([(1, "old")], "id long, name string")
    patches = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 2, None), (1, 1, "z")], "id long, seq long, name string")
    assert projects.apply_patches(rows, patches, ["name"]).first().name == "b"
