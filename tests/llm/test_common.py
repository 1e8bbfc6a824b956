import numpy as np
import pyarrow as pa
import pytest

from textgauge.llm import common


def test_slices_hold_few_rows_and_bytes():
    texts = pa.array(["x" * 3_000_000, None, "", "y" * 2_000_000, "z" * 9_000_000] + ["a"] * 300)
    parts = list(common.sliced([texts]))
    assert [len(p) for p in parts] == [3, 1, 1, 128, 128, 44] and pa.concat_arrays(parts).equals(texts)
    assert [len(a) for a, b in common.sliced([(texts.slice(3), texts.slice(3))])] == [1, 1, 128, 128, 44]
    assert [len(p) for p in common.sliced([pa.array(np.arange(300))])] == [128, 128, 44]
    assert list(common.sliced([pa.array([], pa.string())])) == []


def test_operators_leave_the_session_as_it_is(spark):
    from helpers import odd

    from textgauge.llm import langid, simhash

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "5000")
    try:
        simhash.near_duplicates(odd(spark)).count()
        langid.identify(odd(spark), langid.Profiles({})).count()
        assert [spark.conf.get(n) for n in names] == ["5000", "5000"]
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session())
