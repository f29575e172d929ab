"""Archives of any size (O4): regular files of ZIPs and TARs, from rows of bytes or from a folder of archives.

A ZIP is tried first, then a TAR with any compression. Names are normalised (``./a//b`` is ``a/b``); of equal names the last
entry counts, hard links have the body of what they name, symbolic links are not followed, and an absolute name or one
that climbs with ``..`` refuses its archive. Whatever is wrong with one archive is an error row, never a failed job.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..jobs.scratch import written
from .folders import MOST_CELL, batched, list_directory, opened, said

Entry = tuple[str, int, Callable[[], object]]


def safe_name(name: str) -> str:
    if name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"unsafe entry {name}")
    return posixpath.normpath(name)


def zip_entries(archive: zipfile.ZipFile) -> list[Entry]:
    """(name, size, open) of the files of a ZIP, of equal names the last, in the order of its directory."""
    last = {safe_name(i.filename): i for i in archive.infolist() if not i.is_dir()}
    return [(name, i.file_size, lambda i=i: archive.open(i)) for name, i in last.items()]


def tar_entries(archive: tarfile.TarFile) -> list[Entry]:
    """The same of a TAR."""
    last = {safe_name(i.name): i for i in archive.getmembers() if i.isfile() or i.islnk()}
    return [(name, i.size, lambda i=i: archive.extractfile(i)) for name, i in last.items()]


def open_archive(raw):
    """The ZIP or TAR in a seekable file."""
    if zipfile.is_zipfile(raw):
        return zipfile.ZipFile(raw)
    raw.seek(0)
    try:
        return tarfile.open(fileobj=raw)
    except tarfile.TarError:
        raise ValueError("not ZIP or TAR") from None


def entries_of(archive) -> list[Entry]:
    return zip_entries(archive) if isinstance(archive, zipfile.ZipFile) else tar_entries(archive)


def whole_body(entry: Entry) -> bytes:
    name, size, open_ = entry
    if size > MOST_CELL:
        raise ValueError(f"{name} is too large for one value")
    with open_() as body:
        found = body.read()
    if len(found) > MOST_CELL:
        raise ValueError(f"{name} is too large for one value")
    return found


def unpack_rows(base: str, content: bytes | None, most_bytes: int | None) -> Iterator[tuple]:
    """(base, key, content, error) of one archive in memory: all its files, read once to see that all can be read, or one error row."""
    try:
        with open_archive(io.BytesIO(content or b"")) as archive:
            entries, total = entries_of(archive), 0
            for name, size, open_ in entries:
                if size > MOST_CELL:
                    raise ValueError(f"{name} is too large for one value")
                with open_() as body:
                    while chunk := body.read(1 << 20):
                        total += len(chunk)
                        if most_bytes is not None and total > most_bytes:
                            raise ValueError("archive too large")
            for entry in entries:
                yield base, f"{base}/unpacked/{entry[0]}", whole_body(entry), None
    except Exception as e:  # of every kind that damaged bytes can cause
        yield base, None, None, said(e)


_UNPACKED = pa.schema([("base", pa.string()), ("key", pa.string()), ("content", pa.binary()), ("error", pa.string())])
_PLAN = pa.schema([("path", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("members", pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]))), ("error", pa.string())])
PLAN = "path string, kind string, first long, last long, members array<struct<name:string,offset:long,size:long>>, error string"
_FILE = pa.schema([("path", pa.string()), ("relpath", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def plan_archive(path: str, range_bytes: int) -> Iterator[tuple]:
    """Ranges of one archive's files, each of about ``range_bytes`` in the archive, that tasks read on their own.

    A ZIP is cut by its directory, an uncompressed TAR by its headers; a TAR that is compressed or holds sparse files is one
    stream. Only directories and headers are read.
    """
    try:
        with opened(path) as raw:
            if not raw.size():
                raise ValueError("not ZIP or TAR")
            if zipfile.is_zipfile(raw):
                with zipfile.ZipFile(raw) as archive:
                    zip_entries(archive)  # an unsafe name refuses it all
                    sizes = [i.compress_size + 100 for i in archive.infolist()]
                    first = held = 0
                    for k, size in enumerate(sizes):
                        if k > first and held + size > range_bytes:
                            yield path, "zip", first, k, None, None
                            first, held = k, 0
                        held += size
                    yield path, "zip", first, len(sizes), None, None
                return
            raw.seek(0)
            try:
                archive = tarfile.open(fileobj=raw, mode="r:")
            except tarfile.TarError:
                yield path, "stream", 0, 0, None, None
                return
            with archive:
                members = {safe_name(i.name): i for i in archive.getmembers() if i.isfile() or i.islnk()}
                if any(i.sparse is not None for i in members.values()):
                    yield path, "stream", 0, 0, None, None
                    return
                held, out, end = 0, [], raw.size()
                for name, i in members.items():
                    at = archive._find_link_target(i) if i.islnk() else i
                    if at.offset_data + at.size > end:
                        raise ValueError("unexpected end of data")
                    if out and held + at.size > range_bytes:
                        yield path, "tar", 0, 0, out, None
                        out, held = [], 0
                    out.append({"name": name, "offset": at.offset_data, "size": at.size})
                    held += at.size + 512
                yield path, "tar", 0, 0, out, None
    except Exception as e:  # of every kind that damaged bytes can cause
        yield path, "error", 0, 0, None, said(e)


def range_rows(path: str, kind: str, first: int, last: int, members: list[dict] | None, error: str | None) -> Iterator[tuple]:
    """(path, relpath, content, error) of one range; an entry that can't be read is an error row of its name."""
    if kind == "error":
        yield path, None, None, error
        return
    try:
        with opened(path) as raw:
            if kind == "tar":
                for m in members or ():
                    raw.seek(m["offset"])
                    yield (path, m["name"], raw.read(m["size"]), None) if m["size"] <= MOST_CELL else (path, m["name"], None, "too large for one value")
                return
            with open_archive(raw) as archive:
                entries = entries_of(archive)
                if kind == "zip":
                    own = {id(i) for i in archive.infolist()[first:last]}
                    entries = [e for e in entries if id(e[2].__defaults__[0]) in own]
                for entry in entries:
                    try:
                        yield path, entry[0], whole_body(entry), None
                    except Exception as e:
                        yield path, entry[0], None, said(e)
    except Exception as e:
        yield path, None, None, said(e)


def plan_archives(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """One row per range of the archives below a folder (see ``plan_archive``)."""
    listed = list_directory(spark, path).select("path")

    def plan(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                rows = list(plan_archive(x, range_bytes))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PLAN.types, strict=True)], schema=_PLAN)

    return listed.mapInArrow(plan, PLAN)


def read_archives(spark: SparkSession, path: str, *, range_bytes: int = 64 << 20) -> DataFrame:
    """(path, relpath, content, error): the files of all archives below a folder, of any size.

    Archives are listed and planned without their bodies; each range of about ``range_bytes`` is then read by a task of its
    own, by seek, and given on in batches, so neither an archive nor a range is held in memory: only one file is. A
    damaged file is an error row with its name, and the archive's other files stay; an archive that can't be opened,
    or that holds an unsafe name, is one error row. A compressed TAR is one stream, so one task. A file of over 2 GB is an error row,
    since it is no single value.
    """
    def read(batches):
        rows = (row for batch in batches for plan in batch.to_pylist() for row in range_rows(**plan))
        yield from batched(rows, _FILE, 2)

    plans = written(plan_archives(spark, path, range_bytes), "ranges")
    tasks = max(spark.sparkContext.defaultParallelism, min(plans.count(), 100_000))
    return plans.repartition(tasks, "path", "first", "members").mapInArrow(read, "path string, relpath string, content binary, error string")
