import numpy as np
import pytest

from tests.llm.helpers import docs
from trustloom.llm._units import TokenPool, hashed_units

corpus_pipeline = pytest.importorskip("corpus_pipeline")
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_pool_indexes_only_units_without_a_slot():
    pool = TokenPool(lambda units, kinds: [[*u] for u in units], np.uint16)
    data = np.frombuffer(" ".join(f"{k}" for k in range(50_000)).encode(), np.uint8)
    starts, lengths, kinds, hashes = hashed_units(np.array([0, len(data)]), data, True)
    for _ in range(2):
        ids, _ = pool.tokens(pool.lookup(data, starts, lengths, kinds, hashes))
        assert bytes(ids.astype(np.uint8)) == data.tobytes()
        assert pool.count == len(starts) and len(pool.index) < pool.count // 10


def test_pipeline_sends_small_batches(spark, tmp_path):
    for asked, given in (("10000", 1000), ("0", 1000), ("300", 300)):
        spark.conf.set(ROWS, asked)
        try:
            corpus_pipeline.tokens(spark, docs(spark, ["one text", "another"]), str(tmp_path))
            assert int(spark.conf.get(ROWS)) == given
        finally:
            spark.conf.unset(ROWS)
