"""Folders for streams and written tables, below the session's shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a folder of our own, on a local master only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/loomgraph-jobs/{name}-{uuid.uuid4().hex}"


#: Paths written inside the open ``temporary`` blocks, innermost last.
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that ``written`` makes inside the block are removed at its end."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _store(spark, path, lambda store, place: store.delete(place, True))


def _store(spark: SparkSession, path: str, act) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, read back, so that what is used twice is computed once.

    Outside a ``temporary`` block the table stays as long as the application, since results may read it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    else:
        _store(df.sparkSession, path, lambda store, place: store.deleteOnExit(place))
    return df.sparkSession.read.schema(df.schema).parquet(path)
