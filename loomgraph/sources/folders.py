"""Folders of files in any store: listing and reading that leave nothing out.

Spark's own file scan takes names that begin with ``_`` or ``.`` for hidden and skips empty files, so ``__init__.py`` would be
lost; here every file counts, as in an object listing.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..jobs.scratch import written

#: Bytes of a column's value at most.
MOST_CELL = (1 << 31) - (1 << 20)
BATCH_BYTES = 16 << 20
_LISTED = pa.schema([("path", pa.string()), ("length", pa.int64())])
_BODY = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def store_of(path: str):
    """(store, path in it, what stands before that in full paths), of any store that Arrow reads: local, HDFS, S3, GCS."""
    from urllib.parse import quote

    from pyarrow import fs

    if re.match("file:/|/", path):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path), "file:"
    store, inside = fs.FileSystem.from_uri(quote(path, safe=":/"))
    return store, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


def opened(path: str):
    """A seekable file."""
    store, inside, _ = store_of(path)
    return store.open_input_file(inside)


def created(path: str, content: bytes) -> None:
    """A new file with its folders."""
    store, inside, _ = store_of(path)
    store.create_dir(posixpath.dirname(inside), recursive=True)
    with store.open_output_stream(inside) as out:
        out.write(content)


def said(error: BaseException) -> str:
    return str(error) or type(error).__name__


def batched(rows: Iterator[tuple], schema: pa.Schema, size_at: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH_BYTES of the bodies in column ``size_at``."""
    out: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        held += len(row[size_at] or b"") + 64
        if held >= BATCH_BYTES:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file below a folder. The driver lists the folder itself, tasks what is below its subfolders."""
    from pyarrow import fs

    store, top, before = store_of(path.rstrip("/"))
    here = store.get_file_info(fs.FileSelector(top, recursive=False))
    files = [(before + i.path, i.size) for i in here if i.is_file]
    folders = [(before + i.path,) for i in here if i.type == fs.FileType.Directory]

    def below(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, top, before = store_of(folder)
                found = [i for i in store.get_file_info(fs.FileSelector(top, recursive=True)) if i.is_file]
                yield pa.RecordBatch.from_arrays([pa.array([before + i.path for i in found], pa.string()), pa.array([i.size for i in found], pa.int64())], schema=_LISTED)

    own = spark.createDataFrame(files, "path string, length long")
    if not folders:
        return own
    tasks = min(len(folders), max(spark.sparkContext.defaultParallelism, len(folders) // 100))
    deeper = spark.createDataFrame(folders, "path string").repartition(tasks).mapInArrow(below, "path string, length long")
    return own.unionByName(deeper)


def read_directory(spark: SparkSession, path: str, *, task_bytes: int = 64 << 20) -> DataFrame:
    """(path, content, error) of every file below a folder, about ``task_bytes`` a task; one that can't be read, or is over 2 GB, is an error row."""
    listed = written(list_directory(spark, path), "listed")
    total = listed.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, min(total // task_bytes, 100_000))

    def bodies(batches):
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if length > MOST_CELL:
                        raise ValueError("too large for one value")
                    with opened(path) as f:
                        yield path, f.read(), None
                except Exception as e:
                    yield path, None, said(e)

    return listed.repartition(tasks, "path").mapInArrow(lambda batches: batched(bodies(batches), _BODY, 1), "path string, content binary, error string")


_LINES = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("error", pa.string())])
_COUNTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("lines", pa.int64()), ("error", pa.string())])


def range_lines(path: str, first: int, last: int, size: int) -> Iterator[bytes]:
    """The lines that begin at the bytes ``first`` to ``last`` of a file, the last of them read to its end wherever that is."""
    with opened(path) as f:
        f.seek(max(first - 1, 0))
        raw = f.read(last - max(first - 1, 0))
        if first:  # a line begins behind each newline from the byte before the range on
            at = raw.find(b"\n")
            if at < 0:
                return
            raw = raw[at + 1 :]
        *lines, rest = raw.split(b"\n")
        yield from lines
        if not rest and last < size:
            return  # the next line begins at the next range
        parts, more = [rest], 4096  # most lines end soon
        while chunk := f.read(more):
            at = chunk.find(b"\n")
            parts.append(chunk if at < 0 else chunk[:at])
            if at >= 0:
                break
            more = min(2 * more, 1 << 20)
        yield b"".join(parts)


def read_lines(spark: SparkSession, path: str, *, range_bytes: int = 16 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """(path, line_no, line, error) of the text files below a folder: lines between newlines, numbered from 0; one error row for
    a file that isn't UTF-8 or can't be read.

    Files are read in ranges of ``range_bytes``, about ``task_bytes`` a task, where opening a range counts as 64 KB more. Ranges of a file that
    has several count their lines and look at their bytes first; counts summed before each range make the numbers those of
    the whole file, and one bad range refuses its file. A file that is one range is read once. A range holds its bytes, and
    the one line that it ends in.
    """
    listed = list_directory(spark, path)
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = listed.select("path", "length", F.explode(cuts).alias("first")).withColumn("last", F.least(F.col("first") + range_bytes, "length"))
    ranges = written(ranges, "ranges")

    one = F.col("length") <= range_bytes

    def dealt(rows: DataFrame, of: DataFrame) -> DataFrame:
        work = of.agg(F.sum(F.col("last") - F.col("first") + (64 << 10))).first()[0] or 0
        return rows.repartition(max(spark.sparkContext.defaultParallelism, min(work // task_bytes, 100_000)), "path", "first")

    def count(batches):
        for batch in batches:
            out = []
            for name, size, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, error = 0, None
                try:
                    for line in range_lines(name, first, last, size):
                        line.decode()
                        n += 1
                except UnicodeDecodeError:
                    error = "not UTF-8"
                except Exception as e:
                    error = said(e)
                out.append((name, size, first, last, n, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _COUNTED.types, strict=True)], schema=_COUNTED)

    def whole(name: str) -> Iterator[tuple]:
        try:
            with opened(name) as f:
                lines = f.read().decode().split("\n")
        except UnicodeDecodeError:
            yield name, None, None, "not UTF-8"
        except Exception as e:
            yield name, None, None, said(e)
        else:
            yield from ((name, k, line, None) for k, line in enumerate(lines))

    def rows(batches):
        for batch in batches:
            for name, size, first, last, number, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size <= range_bytes:
                    yield from whole(name)
                elif error is None:
                    for k, line in enumerate(range_lines(name, first, last, size)):
                        yield name, number + k, line.decode(), None
                elif not first:
                    yield name, None, None, error

    counted = written(dealt(ranges.filter(~one), ranges.filter(~one)).mapInArrow(count, "path string, length long, first long, last long, lines long, error string"), "counted")
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    numbered = counted.select("path", "length", "first", "last", F.coalesce(before, F.lit(0)).alias("number"), F.max("error").over(Window.partitionBy("path")).alias("error"))
    placed = ranges.filter(one).select("*", F.lit(0).cast("long").alias("number"), F.lit(None).cast("string").alias("error")).unionByName(numbered)
    return dealt(placed, ranges).mapInArrow(lambda batches: batched(rows(batches), _LINES, 2), "path string, line_no long, line string, error string")
