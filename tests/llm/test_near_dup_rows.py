"""Repeated rows in number, rows that share an id, clashing columns."""

import random
import time

from tests.llm.helpers import docs
from tests.llm.test_near_dup import brute, edited, run
from trustloom.llm import near_dup


def words(rnd, n):
    return [f"w{rnd.randint(0, 9999)}" for _ in range(n)]


def test_thousands_of_copies_of_two_rows(spark):
    rnd = random.Random(31)
    one = words(rnd, 150)
    texts = [" ".join(one), edited(rnd, one, 0.01), " ".join(words(rnd, 90))]
    begin = time.time()
    rows = run(spark, [texts[0]] * 5000 + [texts[1]] * 5000 + [texts[2]], [4] * 5000 + [9] * 5000 + [11])
    assert [x for x in dict.fromkeys(rows)] == brute(texts, [4, 9, 11], 4) and len(rows) == 10_001 and rows[-1][2] == 4
    assert time.time() - begin < 120


def test_repeated_rows_equal_brute_force_by_pairs_and_by_blocks(spark, monkeypatch):
    rnd = random.Random(32)
    base = [f"w{k}" for k in range(110)]
    texts = [edited(rnd, base, rnd.choice([0.01, 0.03, 0.06])) for _ in range(60)] + [" ".join(words(rnd, 40)) for _ in range(10)]
    ids = rnd.sample(range(1000), 70)
    want = sorted(brute(texts, ids, 4) * 3, key=repr)
    assert run(spark, texts * 3, ids * 3) == want
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    real = near_dup.linked_groups
    monkeypatch.setattr(near_dup, "linked_groups", lambda *a, **k: real(*a, **k, small=4))
    assert run(spark, texts * 3, ids * 3) == want


def test_many_texts_of_one_id_and_clashing_columns(spark):
    rnd = random.Random(33)
    base = words(rnd, 120)
    texts = [edited(rnd, base, 0.005) for _ in range(40)] + [edited(rnd, base, 0.005), " ".join(words(rnd, 50))]
    df = docs(spark, texts, [3] * 40 + [8, 9]).selectExpr("*", "1 AS id", "2 AS rep", "3 AS whole", "4 AS component", "5 AS kept", "6 AS a")
    got = sorted({(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df, width=4).collect()})
    assert got == [(3, 3, True), (8, 3, False), (9, 9, True)]
