"""Archives of any size and kind of damage, against zipfile and tarfile."""

import io
import random
import tarfile
import zipfile

import pytest

from loomgraph.jobs.scratch import scratch
from loomgraph.sources import archives as ar
from loomgraph.sources import files as sources

ROW = "user string, filename string, uuid string, tag string, content binary"


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", method) as z:
        for name, body in entries:
            z.writestr(name, body)
    return raw.getvalue()


def tarred(entries, mode="w"):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode=mode) as t:
        for name, body in entries:
            info = tarfile.TarInfo(name)
            if isinstance(body, str):  # a hard link
                info.type, info.linkname = tarfile.LNKTYPE, body
                t.addfile(info)
            else:
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
    return raw.getvalue()


def unpacked(spark, contents):
    rows = spark.createDataFrame([("u", str(i), "1", None, c) for i, c in enumerate(contents)], ROW).repartition(8)
    found = {i: [] for i in range(len(contents))}
    for r in sources.unpack_archives(rows).collect():
        found[int(r.base.split("/")[1])].append((r.key and r.key.split("/unpacked/")[1], r.content and bytes(r.content), r.error))
    return found


def written(spark, contents):
    """A folder of archives, as its path."""
    path = scratch(spark, "archives").removeprefix("file://")
    import os

    os.makedirs(path)
    for name, content in contents.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(content)
    return path


def read(spark, contents, range_bytes):
    found = {name: [] for name in contents}
    for r in ar.read_archives(spark, written(spark, contents), range_bytes=range_bytes).collect():
        found[r.path.rsplit("/", 1)[1]].append((r.relpath, None if r.content is None else bytes(r.content), r.error))
    return found


def test_any_damaged_byte_gives_rows(spark):
    """300 ZIPs and 450 TARs with one byte changed: each gives files or one error row, and no job fails."""
    rng = random.Random(5)
    entries = [(f"d/{i}.py", rng.randbytes(40) * rng.randrange(1, 30)) for i in range(6)]
    whole = [zipped(entries)] * 300 + [tarred(entries, m) for m in ("w:gz", "w:bz2", "w:xz") for _ in range(150)]
    damaged = []
    for content in whole:
        at = rng.randrange(len(content))
        damaged.append(content[:at] + bytes([content[at] ^ rng.randrange(1, 256)]) + content[at + 1 :])
    found = unpacked(spark, damaged)
    assert all(rows and (all(e is None for *_, e in rows) or (len(rows) == 1 and rows[0][2])) for rows in found.values())
    assert sum(rows[0][2] is not None for rows in found.values()) > 300
    many = read(spark, {f"{i}.bin": c for i, c in enumerate(damaged) if i % 5 == 0}, 200)
    assert all(rows for rows in many.values())


def test_names_links_and_repeats(spark):
    entries = [("./a.py", b"old"), ("d//b.py", b"b"), ("d/", b""), ("a.py", b"new"), ("empty", b"")]
    want = [("a.py", b"new", None), ("d/b.py", b"b", None), ("empty", b"", None)]
    files = [e for e in entries if e[0] != "d/"]
    contents = [zipped(entries), *(tarred(files, m) for m in ("w", "w:gz", "w:bz2", "w:xz"))]
    for rows in unpacked(spark, contents).values():
        assert sorted((k, c or b"", e) for k, c, e in rows) == want
    for size in (100, 1 << 20):
        for rows in read(spark, {f"{i} é": c for i, c in enumerate(contents)}, size).values():
            assert sorted(rows) == want
    links = [tarred([("x", b"body"), ("y", "x"), ("z", b"tail")], m) for m in ("w", "w:gz")]
    for rows in [*unpacked(spark, links).values(), *read(spark, dict(zip("ab", links)), 1).values()]:
        assert sorted(rows) == [("x", b"body", None), ("y", b"body", None), ("z", b"tail", None)]


def test_refused_archives(spark):
    bad = [b"no archive", None, b"", zipped([("ok", b"1"), ("../x", b"2")]), tarred([("/abs", b"1")]), tarred([("x", b"1" * 2000)])[:900]]
    for rows in unpacked(spark, bad).values():
        assert len(rows) == 1 and rows[0][0] is None and rows[0][2]
    for rows in read(spark, {str(i): c for i, c in enumerate(bad) if c is not None}, 100).values():
        assert len(rows) == 1 and rows[0][2]
    assert unpacked(spark, [zipped([])])[0] == []


def test_a_damaged_entry_leaves_the_others(spark):
    content = bytearray(zipped([(str(i), bytes([i]) * 500) for i in range(5)], zipfile.ZIP_STORED))
    at = content.find(b"\x02" * 500)
    content[at + 9] ^= 1
    rows = {n: (c, e) for n, c, e in read(spark, {"a.zip": bytes(content)}, 700)["a.zip"]}
    assert {n for n, (c, e) in rows.items() if e} == {"2"} and all(c == bytes([int(n)]) * 500 for n, (c, e) in rows.items() if n != "2")
    assert [r[2] is not None for r in unpacked(spark, [bytes(content)])[0]] == [True]


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_large_archive_is_read_by_many_tasks(spark, kind):
    """Some 600 MB unpacked in ranges; the digest of each file is that of zipfile or tarfile."""
    import hashlib

    from pyspark.sql import functions as F

    bodies = {f"f{i:03d}": bytes([i]) * 10_000_000 + str(i).encode() for i in range(60)}
    content = zipped(bodies.items()) if kind == "zip" else tarred(bodies.items())
    path = written(spark, {"large": content})
    plans = ar.plan_archives(spark, path, len(content) // 12)
    assert plans.count() >= 10
    rows = ar.read_archives(spark, path, range_bytes=len(content) // 12).select("relpath", F.sha2("content", 256).alias("sha"), F.spark_partition_id().alias("task"), "error").collect()
    assert {r.relpath: r.sha for r in rows} == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}
    assert len({r.task for r in rows}) >= 5 and not any(r.error for r in rows)
