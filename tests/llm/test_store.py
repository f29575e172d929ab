import os
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from loomgraph.llm import store
from loomgraph.llm.store import drop, materialize, shared_dir, temporary


def test_tables_go_at_the_end_of_their_block(spark):
    df = spark.range(3)
    outside = materialize(df)
    with temporary(spark):
        with temporary(spark):
            gone, kept = materialize(df), materialize(df, keep=True)
            early = materialize(df)
            drop(early)
            assert os.path.isdir(gone.written_to) and not os.path.exists(early.written_to)
        assert not os.path.exists(gone.written_to) and kept.count() == 3
        with pytest.raises(ZeroDivisionError), temporary(spark):
            failed = materialize(df)
            raise ZeroDivisionError
        assert not os.path.exists(failed.written_to)
    assert not os.path.exists(kept.written_to) and outside.count() == 3


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def held() -> float:
    """MB of this process without mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:")) / 1024


def test_workers_give_memory_back():
    """What a task took at most is not kept by its worker for the tasks after it."""

    def run(batches):
        for batch in batches:
            texts = [x.as_py() + "!" for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(texts)], names=["x"])

    def task(of):
        last = pa.array(["x"])
        for out in of(pa.RecordBatch.from_arrays([pa.array([f"{i:06} " + "y" * 390 for i in range(250_000)])], names=["x"]) for _ in range(2)):
            assert out.num_rows == 250_000
            del out
        return last

    store.trim()
    before, kept = held(), []
    for _ in range(3):
        last = task(store.lean(run))  # noqa: F841  small things made later stay where they are
        kept.append(held() - before)
    assert max(kept) < 60


def test_lean_passes_rows_and_errors_on(spark):
    def twice(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.compute.multiply(batch.column(0), 2)], names=["id"])

    def fails(batches):
        for _ in batches:
            raise ValueError("told")
        yield

    rows = spark.range(0, 5000, 1, 3).mapInArrow(store.lean(twice, every=0), "id long")
    assert sorted(r.id for r in rows.collect()) == list(range(0, 10_000, 2))
    with pytest.raises(ValueError, match="told"):
        list(store.lean(fails)(iter([1])))
