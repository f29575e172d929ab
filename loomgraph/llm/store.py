"""Where intermediate tables live, how Arrow batches are bounded, and what workers hold between them.

Every table that is read more than once is written to the shared folder named
by ``spark.checkpoint.dir``, so a lost executor costs a re-read and no rerun. A
result reads such tables as long as it is used; write it inside a ``temporary``
block to have them removed afterwards.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Paths written inside the open ``temporary`` blocks, innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "t", *, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage.

    Inside a ``temporary`` block the table is removed at the end of the block, unless it is to ``keep``; outside, when the
    application ends, since results may read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    depth = -2 if keep else -1
    if len(_OPEN) >= -depth:
        _OPEN[depth].append(path)
    else:
        forget(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` gave and that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, [table.written_to])


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders, in whatever store they are."""
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)


def forget(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block go at its end; kept ones go with the block around it, if any."""
    _OPEN.append([])
    try:
        yield
    finally:
        remove(spark, _OPEN.pop())


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Hold Arrow batches at ``rows`` rows while an action over wide rows runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Give back the memory that this process's allocators hold unused, Arrow's and (with glibc) malloc's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: float = 1.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, in a worker that trims its memory between batches, each ``every`` seconds at most, and at the end.

    Workers are used again by later tasks, and each would else keep the most that any of them took, beside the executor's heap.
    """

    def trimmed(batches):
        last = time.monotonic()
        for batch in batches:
            yield batch
            del batch
            if time.monotonic() - last >= every:
                trim()
                last = time.monotonic()

    def out(batches):
        try:
            yield from run(trimmed(batches))
        finally:
            trim()

    return out
