"""Whole definition: copies of dense items, clashing columns, repeated rows, rows told apart."""

from tests.llm.helpers import ODD, docs
from tests.llm.test_decontaminate import ITEMS, found
from trustloom.llm import decontaminate as d

DENSE = "Add 12 and 7 and 9 and 4 and 31 and 8 and 44 and 6 then take off 3 and 15 and 2 and divide by 5 and 2"
WALK = "Alice walks past the old mill every day before the bell rings and then Alice goes home along the quiet river to rest"


def test_dense_and_upper_case_copies(spark):
    items = [(1, DENSE), (2, DENSE.upper()), (3, WALK)]
    got = found(spark, [f"so {DENSE} and that", DENSE.upper(), WALK.upper(), WALK.title()], items)
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 3), (3, 3)} and all(r.coverage == 1 and r.exact for r in got.values())


def test_a_conflict_keeps_the_longest_consistent_run(spark):
    # 18 tokens after the first slot agree with one another
    got = found(spark, [WALK.replace("Alice walks", "Zoe walks").replace("then Alice", "then Bob"), WALK.replace("Alice", "Zoe")], [(1, WALK)])
    assert got[0, 1].n_matched >= d.RUN and not got[0, 1].exact and got[0, 1].n_matched < got[1, 1].n_matched == got[1, 1].n_item


def test_clashing_columns_and_repeated_rows(spark):
    items = spark.createDataFrame([(1, WALK, 1), (1, WALK, 2), (2, ITEMS[1][1], 3), (None, None, 4)], "item_id long, text string, doc_id int").selectExpr("*", "7 AS row", "8 AS hash")
    df = docs(spark, [WALK, WALK, "nothing here", ITEMS[1][1], WALK], [5, 5, 6, None, None]).selectExpr("*", "1 AS row", "2 AS id", "3 AS hash", "4 AS item", "5 AS item_id", "6 AS own", "7 AS at", "8 AS exact")
    rows = [(r.doc_id, r.item_id, r.n_matched) for r in d.leaks(df, items).collect()]
    n = [len(x.split()) for x in (WALK, ITEMS[1][1])]
    assert sorted(rows, key=repr) == sorted([(5, 1, n[0]), (5, 1, n[0]), (None, 2, n[1]), (None, 1, n[0])], key=repr)
    # with a column that names rows, rows of one name are one
    named = [tuple(r) for r in d.leaks(df.withColumn("nr", df.item * 0 + 9), items, row_col="nr").collect()]
    assert {x[0] for x in named} == {9} and {x[2] for x in named} == {1, 2}


def test_one_item_in_many_documents_and_many_items_in_one(spark):
    items = [(k, f"{WALK} number {k}") for k in range(40)]
    got = found(spark, [WALK] * 60 + ODD, items)
    assert set(got) == {(a, b) for a in range(60) for b in range(40)}
    assert found(spark, ODD, []) == {}
