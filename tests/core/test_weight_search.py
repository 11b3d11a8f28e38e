"""Sequential search of weights."""

import random

import pytest

import trustloom as t
from trustloom.operators import ensemble as E


@pytest.fixture(scope="module")
def graded(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(300):
        y = rnd.random() < 0.5
        rows.append((k, min(1.0, max(0.0, 0.5 + (0.25 if y else -0.25) + rnd.gauss(0, 0.2))), min(1.0, max(0.0, 0.5 + (0.1 if y else -0.1) + rnd.gauss(0, 0.2))), rnd.random(), rnd.random() if k % 5 else None, int(y)))
    return spark.createDataFrame(rows, "prompt_id int, a double, b double, c double, e double, correct int")


def test_later_rounds_never_lose(graded):
    args = (graded, ["a", "b", "c", "e"], "roc_auc")
    first, last = E.searched_weights(*args, trials=20, rounds=0), E.searched_weights(*args, trials=20, rounds=4)
    assert last[2] > first[2] and sum(last[0]) == pytest.approx(1.0) and last[1] is None
    assert last[0] == E.searched_weights(*args, trials=20, rounds=4)[0] and last[0][0] > last[0][2]
    loss = [E.searched_weights(graded, ["a", "b", "c", "e"], "brier_score", trials=8, rounds=r)[2] for r in (0, 2)]
    assert loss[1] <= loss[0]


def test_moves():
    rows = E.neighbours((0.5, 0.5, 0.0), 0.2)
    assert rows[0] == (0.5, 0.5, 0.0) and len(rows) == 5 and all(sum(r) == pytest.approx(1.0) and min(r) >= 0 for r in rows)
    assert E.neighbours((0.1, 0.9), 0.2)[1] == (0.0, 1.0)


def test_ensembles_of_four(graded):
    e = t.ScoreEnsemble(["a", "b", "c", "e"]).tune(graded, "balanced_accuracy_score", trials=10)
    assert 0 < e.threshold < 1 and len(e.weights) == 4
    e = t.ScoreEnsemble(["a", "b"], threshold=0.99).tune(graded, "roc_auc", weight_steps=11, thresh_objective="accuracy_score")
    assert 0.2 < e.threshold < 0.8
    with pytest.raises(ValueError):
        e.tune(graded, "roc_auc", thresh_objective="roc_auc")
    assert t.ScoreEnsemble.of_settings(e.settings()).settings() == e.settings()


def test_nothing_to_search(spark, graded):
    weights, threshold, value = E.searched_weights(graded.limit(0), ["a", "b", "c", "e"], "roc_auc", trials=4)
    assert (weights, threshold, value) == ([0.25] * 4, None, None)
