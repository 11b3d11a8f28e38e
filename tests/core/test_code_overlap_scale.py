"""Overlap of programs is worked out once a pair, by many tasks."""

import pytest

from tests.core.test_code_overlap import bleu
from trustloom.operators import code_scores as code
from trustloom.operators import program_grams, program_shape

PAIR = "prompt_id long, original string, sample string"
MEANS = (code.codebleu, code.codebleu_of_python)


@pytest.mark.parametrize("mean", MEANS)
def test_texts_are_split_once_and_dealt_before(spark, mean):
    df = spark.createDataFrame([(1, "def f(x):\n    return x", "def g(x):\n    return x")], PAIR)
    plan = mean(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2  # of the original and of the sample, outside any lambda
    assert plan.index("ArrowEvalPython") < plan.rindex("hashpartitioning(prompt_id")  # plans read upwards
    assert "original" in plan[plan.rindex("hashpartitioning(prompt_id") :].split("\n")[0]


def test_repeated_pairs_weigh_as_often_as_they_occur(spark):
    a, b, c = "def f ( x ) : return x", "def g ( y ) : return y", "print ( 1 )"
    rows = [(1, a, b)] * 3 + [(1, a, c), (2, a, a), (3, a, ""), (4, None, a), (5, None, a), (5, a, a), (6, "", a)]
    got = {r.prompt_id: r.codebleu for r in code.codebleu(spark.createDataFrame(rows, PAIR)).collect()}
    of = lambda r, s: (bleu(r.split(), s.split(), False) + bleu(r.split(), s.split(), True)) / 2
    assert got == pytest.approx({1: (3 * of(a, b) + of(a, c)) / 4, 2: 1.0, 3: 0.0, 4: None, 5: 1.0, 6: of("", a)})


def test_long_programs(spark):
    one = "".join(f"x{k % 7} = y{k % 11} + {k % 5}\n" for k in range(4000))
    other = "".join(f"x{k % 11} = y{k % 7} + {k % 3}\n" for k in range(3000))
    got = code.codebleu(spark.createDataFrame([(1, one, other)], PAIR)).first().codebleu
    assert got == pytest.approx((bleu(one.split(), other.split(), False) + bleu(one.split(), other.split(), True)) / 2)


def test_few_programs_are_held():
    grams, shapes = {}, {}
    for k in range(3 * program_grams.KEPT):
        assert program_grams.overlaps(f"x{k} = {k}", f"x{k} = {k}", 4, code.KEYWORDS, grams) == (1.0, 1.0)
        assert program_shape.matches(f"x{k} = {k}", f"y{k} = {k}", shapes) == (1.0, 1.0)
    assert max(len(grams), len(shapes)) <= program_grams.KEPT + 3
