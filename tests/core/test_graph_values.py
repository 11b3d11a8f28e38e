"""Betweenness, PageRank and the calibrators, against independent computations."""

import itertools
import math
import random

import numpy as np
import pytest

from trustloom.operators import claim_graph
from trustloom.operators.calibration import Calibrator


def graphs(spark):
    rnd = random.Random(4)
    made = {p: (n, m, {(c, r): rnd.choice([0.3, 0.6, 0.9]) for c in range(n) for r in range(m) if rnd.random() < share}) for p, (n, m, share) in enumerate([(4, 3, 0.6), (6, 4, 0.4), (1, 3, 0.9), (3, 5, 0.0), (5, 2, 1.0)])}
    edges = spark.createDataFrame([(p, c, r, w) for p, (_, _, e) in made.items() for (c, r), w in e.items()], "prompt_id long, claim_idx int, resp_idx int, w double")
    sizes = spark.createDataFrame([(p, n, m) for p, (n, m, _) in made.items()], "prompt_id long, n_claims int, n_responses int")
    return made, {(r.prompt_id, r.claim_idx): r for r in claim_graph.iterated(edges, sizes).collect()}


def test_betweenness_counts_shortest_paths(spark):
    made, got = graphs(spark)
    for p, (n, m, edges) in made.items():
        near = {v: set() for v in range(n + m)}
        for c, r in edges:
            near[c].add(n + r)
            near[n + r].add(c)

        def paths(a, b):
            level = [[a]]
            while level and not any(x[-1] == b for x in level):
                seen = {v for x in level for v in x}
                level = [[*x, v] for x in level for v in near[x[-1]] if v not in seen]
            return [x for x in level if x[-1] == b]

        through = [0.0] * n
        for a, b in itertools.combinations(range(n + m), 2):
            found = paths(a, b)
            for v in set(range(n)) - {a, b}:
                through[v] += sum(v in x for x in found) / len(found) if found else 0
        # the most that a node of n has beside m others: all paths between the others, shared as evenly as can be
        s, t = divmod(n - 1, m)
        most = (m * m * (s + 1) ** 2 + m * (s + 1) * (2 * t - s - 1) - t * (2 * s - t + 3)) / 2
        assert [got[p, c].betweenness for c in range(n)] == pytest.approx([x / most if most else 0 for x in through], abs=1e-5)


def test_pagerank_solves_its_equation(spark):
    made, got = graphs(spark)
    for p, (n, m, edges) in made.items():
        size = n + m
        a = np.zeros((size, size))
        for (c, r), w in edges.items():
            a[c, n + r] = a[n + r, c] = w
        step = np.array([x / x.sum() if x.sum() else np.full(size, 1 / size) for x in a])
        want = np.linalg.solve(np.eye(size) - claim_graph.DAMPING * step.T, np.full(size, (1 - claim_graph.DAMPING) / size))
        assert [got[p, c].pagerank for c in range(n)] == pytest.approx(want[:n].tolist(), abs=5e-5)


@pytest.fixture(scope="module")
def graded():
    rnd = random.Random(5)
    return [(s, int(rnd.random() < s**2)) for s in (round(rnd.random(), 2) for _ in range(300))]


def test_platt_scaling_is_the_penalised_optimum(spark, graded):
    x, y = (np.array(v, float) for v in zip(*graded))
    w = b = 0.0
    for _ in range(50):  # Newton's steps on the log loss plus half the squared weight
        q = 1 / (1 + np.exp(-(w * x + b)))
        g = np.array([(q - y) @ x + w, (q - y).sum()])
        v = q * (1 - q)
        w, b = np.array([w, b]) - np.linalg.solve([[v @ (x * x) + 1, v @ x], [v @ x, v.sum()]], g)
    df = spark.createDataFrame(graded, "s double, correct int")
    for r in Calibrator("platt").fit_transform(df, ["s"]).collect():
        assert r.calibrated_s == pytest.approx(1 / (1 + math.exp(-(w * r.s + b))), abs=1e-4)


def test_isotonic_regression_pools_violators(spark, graded):
    blocks = []
    for s in sorted({s for s, _ in graded}):
        own = [c for t, c in graded if t == s]
        blocks.append([sum(own), len(own), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    want = {s: a / n for a, n, at in blocks for s in at}
    df = spark.createDataFrame(graded, "s double, correct int")
    assert {r.s: r.calibrated_s for r in Calibrator("isotonic").fit_transform(df, ["s"]).collect()} == pytest.approx(want)
