"""Rows without a doc_id and rows that share one, in the stages that remove documents."""

import random

import pytest

from tests.llm.helpers import docs
from tests.llm.test_pipeline import ITEM

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_rows_go_by_themselves(spark, tmp_path):
    rnd = random.Random(41)
    said = lambda n: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(n))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    one, two, three = said(100), said(100), said(60)
    rows = [(5, one), (5, three), (9, one + " more"), (None, one), (None, two), (None, two + " more"), (7, f"{said(30)} {ITEM}"), (7, said(40)), (None, f"{ITEM} {said(30)}"), (None, said(40)), (1, None), (None, None), (12, two[:30])]
    ids, texts = [i for i, _ in rows], [t for _, t in rows]
    df = docs(spark, texts, ids).selectExpr("*", "1 AS __x", "2 AS kept", "3 AS component_id")
    near = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
    assert near.columns == df.columns
    left = [(r.doc_id, r.text) for r in near.collect()]
    # of two rows without an id either may stay
    first = [x for x in left if x in (rows[4], rows[5])]
    assert len(first) == 1 and sorted(left, key=repr) == sorted([r for r in rows if r not in (rows[2], rows[3], rows[4], rows[5])] + first, key=repr)
    leaks = corpus_pipeline.benchmark_leaks(spark, df, str(tmp_path))
    assert leaks.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in leaks.collect()], key=repr) == sorted([r for r in rows if ITEM not in (r[1] or "")], key=repr)
