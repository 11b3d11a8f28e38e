"""Queries whose registered SQL cuts its input, against the same SQL without the cuts.

The registered SQL takes the first six sentences of an answer, 40 vectors of a
label, 12 or 4 characters of a claim; the queries take all.  The cuts are
removed here from its text, nothing else.  The SQL also splits behind
abbreviations; answers with one before a capital are left to test_whole.
"""

import re

import duckdb
import pytest

from tests.core.test_queries import SF, TABLES, rows
from trustloom.functions.text import ABBREVIATIONS
from trustloom.plans.catalog import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables")
CUTS = ((r"\[1:6\]", ""), (r" WHERE sample_idx % 1000 < 40", ""), (r"left\((\w+\.)?claim, (12|4)\)", r"\1claim"))


def whole(sql):
    for cut, with_ in CUTS:
        sql = re.sub(cut, with_, sql)
    return sql


CUT = sorted(k for k, v in ORACLE_SQL.items() if whole(v) != v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def abbreviated(duck):
    """Conversations in which an abbreviation stands before a capital."""
    found = re.compile(rf"(?i:\b({'|'.join(map(re.escape, ABBREVIATIONS))}))\.\s+[A-Z]")
    turns = duck.execute("SELECT conv_id, text FROM conversations WHERE text IS NOT NULL").fetchall()
    ids = {i for i, t in turns if found.search(t)}
    assert len(ids) < 0.2 * len({i for i, _ in turns})
    return ids


@pytest.mark.parametrize("name", CUT)
def test_equals_sql_without_its_cuts(spark, duck, abbreviated, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(whole(ORACLE_SQL[name])).df()
    if name != "bert_score":
        ours, theirs = (x[~x["prompt_id"].isin(abbreviated)] for x in (ours, theirs))
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs) and len(ours)
