"""Grading of programs, and the structure parts of code overlap."""

import pytest

from trustloom.operators import code_scores as code
from trustloom.operators import program_runner as runner
from trustloom.operators import program_shape as shape

CASES = "row_id long, code string, entry string, cases array<struct<input:string,output:string>>"
WRONG, LATE, FAILED = runner.WRONG, runner.LATE, runner.FAILED


def test_called_and_printing_programs(spark):
    add = "class Solution:\n    def add(self, a, b):\n        return a + b"
    rows = [
        (1, add, "add", [("1\n2", "3"), ('"a"\n"b"', '"ab"')]),
        (2, add, "add", [("1\n2", "3"), ("1\n2", "4"), ("1\n2", "3")]),
        (3, "def pair(a):\n    return a, Counter(a)['x']", "pair", [('["x", "y"]', '[["x", "y"], 1]')]),
        (4, "def f(x): return x", "g", [("1", "1")]),
        (5, "def f(x): return [(x, x)]", "f", [("1", "[[1, 1]]")]),
        (6, "def f(:", "f", [("1", "1")]),
        (7, "print(int(input()) / 2)\nsys.exit(3)", None, [("3", "1.50"), ("4", "2")]),
        (8, "print('no')", " ", [("", "yes")]),
        (9, "if __name__ == '__main__':\n    print(sum(map(int, sys.stdin)))", "", [("1\n2\n3", "6")]),
        (10, None, None, None),
        (11, "print(input() + input())", None, [("only", "only")]),
        (12, "import os\nos._exit(0)", None, [("", "")]),
        (13, "def f(x): return x", "f", [("{", "1")]),
    ]
    got = {r.row_id: (r.passed, r.error_code, r.n_run) for r in code.grade_programs(spark.createDataFrame(rows, CASES)).collect()}
    assert got == {
        1: (True, None, 2), 2: (False, WRONG, 2), 3: (True, None, 1), 4: (False, FAILED, 0), 5: (False, WRONG, 1), 6: (False, FAILED, 0), 7: (True, None, 2),
        8: (False, WRONG, 1), 9: (True, None, 1), 10: (True, None, 0), 11: (False, FAILED, 1), 12: (False, FAILED, None), 13: (False, FAILED, 1),
    }


def test_slow_and_hanging_programs(spark):
    stubborn = "import time, signal\nsignal.signal(signal.SIGALRM, signal.SIG_IGN)\ntime.sleep(60)"
    rows = [(1, "while True: pass", None, [("", "")]), (2, stubborn, None, [("", "")]), (3, "def f(): return 1", "f", [])]
    got = {r.row_id: r.error_code for r in code.grade_programs(spark.createDataFrame(rows, CASES), timeout=1.0).collect()}
    assert got == {1: LATE, 2: runner.HUNG, 3: None}
    assert code.grade_programs(spark.createDataFrame([], CASES)).count() == 0


def test_structure_ignores_names():
    one = "def f(a, b):\n    c = a + b\n    return c * a"
    other = "def g(x, y):\n    z = x + y\n    return z * x"
    assert shape.matches(one, other, {}) == (1.0, 1.0)
    syntax, flow = shape.matches(one, "def g(x, y):\n    z = x + y\n    return z * y", {})
    assert syntax == 1.0 and flow == 0.8  # of a, b, c made, c and a read, the last differs
    assert shape.matches(one, "def f(", {}) == (None, None) and shape.matches(None, one, {}) == (None, None)
    assert shape.matches("pass", one, {})[1] == 1.0


def test_subtrees_are_counted():
    tree = shape.ast.parse("x = 1 + 2\ny = 3 + 4")
    # the module, two assignments of equal shape, two sums of equal shape
    assert sorted(shape.subtrees(tree).values()) == [1, 2, 2]
    assert shape.share(shape.Counter("aab"), shape.Counter("abb")) == pytest.approx(2 / 3)


def test_four_parts(spark):
    rows = [(1, "x = a + b", "y = c + d"), (1, "x = a + b", ""), (2, "select 1 from", "select 1 from"), (3, None, "x"), (4, "def f(x):\n  return x", "def f(x):\n  return x")]
    df = spark.createDataFrame(rows, "prompt_id long, original string, sample string")
    got = {r.prompt_id: r.codebleu for r in code.codebleu_of_python(df).collect()}
    grams = code.codebleu(df.where("sample = 'y = c + d'")).first().codebleu
    assert got == {1: pytest.approx(grams / 2 + 0.5), 2: pytest.approx(1.0), 3: None, 4: pytest.approx(1.0)}
