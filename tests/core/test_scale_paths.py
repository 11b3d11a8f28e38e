"""Plans that cut scores into ranges and bins, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from trustloom.functions import text
from trustloom.operators import code_scores, ensemble


@pytest.fixture(scope="module")
def graded():
    rnd = random.Random(3)
    return [(f"s{k % 3}", rnd.choice([rnd.random(), round(rnd.random(), 1), 0.5, -0.25, 1.5]), rnd.random() < 0.4) for k in range(900)]


def counted(spark, graded):
    rows = spark.createDataFrame(graded, "scorer string, score double, correct boolean")
    return rows.groupBy("scorer", "score").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("pos"))


def test_auc_and_average_precision_over_ranges(spark, graded):
    counts = counted(spark, graded)
    roc = {r.scorer: r.roc_auc for r in ensemble.auc(counts, ["scorer"]).collect()}
    prc = {r.scorer: r.average_precision for r in ensemble.average_precision(counts, ["scorer"]).collect()}
    for name in roc:
        own = [(s, c) for n, s, c in graded if n == name]
        good, bad = [s for s, c in own if c], [s for s, c in own if not c]
        assert roc[name] == pytest.approx(sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)))
        steps = sorted({s for s, _ in own}, reverse=True)
        want = sum(sum(c for s, c in own if s == t) / len(good) * sum(c for s, c in own if s >= t) / sum(s >= t for s, _ in own) for t in steps)
        assert prc[name] == pytest.approx(want)
    assert ensemble.auc(counts.where("pos = 0")).first().roc_auc is None


def test_confusion_by_bins(spark, graded):
    counts = counted(spark, graded)
    steps = [0.0, 0.1, 0.5, 0.9, 2.0]
    thresholds = spark.createDataFrame([(t,) for t in steps], "threshold double")
    got = {(r.scorer, r.threshold): (r.tp, r.fp, r.fn, r.tn) for r in ensemble.confusion(counts, thresholds, ["scorer", "threshold"]).collect()}
    want = {(n, t): tuple(sum(x == n and (s > t) == over and c == good for x, s, c in graded) for over, good in ((True, True), (True, False), (False, True), (False, False))) for n in ("s0", "s1", "s2") for t in steps}
    assert got == want
    whole = {r.threshold: r.tp + r.fn for r in ensemble.confusion(counts, thresholds).collect()}
    assert whole == {t: sum(c for _, _, c in graded) for t in steps}


def test_sentence_ends(spark):
    said = "Dr. Who met Prof. Ames at 2.5 p.m. There was rain! Was it? Yes. Ph.D. Students of the U.S. Army left. xDr. Green stayed. end. no"
    want = ["Dr. Who met Prof. Ames at 2.5 p.m.", "There was rain!", "Was it?", "Yes.", "Ph.D. Students of the U.S. Army left. xDr.", "Green stayed. end. no"]
    assert spark.range(1).select(text.sentences(F.lit(f"  {said}\n"))).first()[0] == want
    assert [spark.range(1).select(text.sentences(F.lit(x).cast("string"))).first()[0] for x in ("", None)] == [[""], None]


def test_programs_are_graded_by_lines_and_numbers(spark):
    rows = [(1, "print(1.50)\nprint('a b')", "1.5\na b"), (2, "print('a  b')", "a b"), (3, "print('1 2.0')", "1.0 2"), (4, "print(1); print(2)", "1 2"), (5, "x = bytearray(1 << 31); print(1)", "1"), (6, "raise SystemExit(1)", "")]
    df = spark.createDataFrame([(k, code, [("", out)]) for k, code, out in rows], "row_id long, code string, cases array<struct<input:string,output:string>>")
    assert {r.row_id: r.passed for r in code_scores.run_cases(df, memory_mb=512).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
