"""Centrality of claims in the bipartite graph of claims and the responses that entail them.

edges: (prompt_id, claim_idx, resp_idx, w), kept where w >= 0.5; sizes:
(prompt_id, n_claims, n_responses).  A prompt's graph has a few dozen nodes.
Degree and the Laplacian drop are closed forms in SQL, distances are a
breadth-first search by array functions over the prompt's own row; only
betweenness and PageRank, which iterate, take a pandas function of one graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
DAMPING, TOLERANCE, MOST_ROUNDS = 0.85, 1e-6, 1000


def edges_of(cells: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return cells.where(F.col("w") >= threshold)


def all_claims(sizes: DataFrame) -> DataFrame:
    return sizes.where("n_claims > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n_claims").cast("int") - 1)).alias("claim_idx"))


def degree(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, degree): sum of weights over the number of responses."""
    sums = edges.groupBy("prompt_id", "claim_idx").agg(F.sum("w").alias("d"))
    return all_claims(sizes).join(sums, ["prompt_id", "claim_idx"], "left").select("prompt_id", "claim_idx", F.round(F.try_divide(F.coalesce("d", F.lit(0.0)), F.col("n_responses").cast("double")), 5).alias("degree"))


def distances(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, n_claims, n_responses, dist map node -> steps) from each claim; nodes: claims, then responses.

    Frontiers alternate between responses and claims, so claims + responses steps are enough.
    """
    lists = edges.groupBy("prompt_id").agg(F.collect_list(F.struct(F.col("claim_idx").cast("int").alias("c"), F.col("resp_idx").cast("int").alias("r"))).alias("e"))
    rows = all_claims(sizes).join(lists, "prompt_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<c:int,r:int>>")))
    nodes = (F.col("n_claims") + F.col("n_responses")).cast("int")

    def step(state, k):
        reached = state["seen"]
        to_r = F.transform(F.filter("e", lambda x: F.array_contains(state["front"], x["c"])), lambda x: x["r"] + F.col("n_claims").cast("int"))
        to_c = F.transform(F.filter("e", lambda x: F.array_contains(state["front"], x["r"] + F.col("n_claims").cast("int"))), lambda x: x["c"])
        new = F.array_except(F.concat(to_r, to_c), F.transform(reached, lambda x: x["node"]))
        return F.struct(F.concat(reached, F.transform(new, lambda x: F.struct(x.alias("node"), k.alias("steps")))).alias("seen"), new.alias("front"))

    c = F.col("claim_idx").cast("int")
    start = F.struct(F.array(F.struct(c.alias("node"), F.lit(0).alias("steps"))).alias("seen"), F.array(c).alias("front"))
    return rows.select("prompt_id", "claim_idx", "n_claims", "n_responses", F.aggregate(F.sequence(F.lit(1), nodes), start, step, lambda s: s["seen"]).alias("dist"))


def closeness(dist: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, closeness, harmonic), scaled for two node sets."""
    c, r = F.col("n_claims").cast("double"), F.col("n_responses").cast("double")
    total = F.aggregate("dist", F.lit(0), lambda s, x: s + x["steps"]).cast("double")
    reached = F.size("dist").cast("double") - 1.0
    close = F.coalesce(F.try_divide(r + 2.0 * (c - 1.0), total) * F.try_divide(reached, c + r - 1.0), F.lit(0.0))
    inverse = F.aggregate("dist", F.lit(0.0), lambda s, x: s + F.coalesce(F.try_divide(F.lit(1.0), x["steps"].cast("double")), F.lit(0.0)))
    return dist.select("prompt_id", "claim_idx", F.round(F.least(close, F.lit(1.0)), 5).alias("closeness"), F.round(F.try_divide(inverse, r + (c - 1.0) / 2.0), 5).alias("harmonic"))


def laplacian(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, laplacian): share of the graph's Laplacian energy that goes with the claim.

    The energy is the sum of squared degrees plus twice the sum of squared weights.
    """
    claim = edges.groupBy("prompt_id", "claim_idx").agg(F.sum("w").alias("d"))
    resp = edges.groupBy("prompt_id", "resp_idx").agg(F.sum("w").alias("dr"))
    squares = claim.groupBy("prompt_id").agg(F.sum(F.col("d") * F.col("d")).alias("a")).join(resp.groupBy("prompt_id").agg(F.sum(F.col("dr") * F.col("dr")).alias("b")), "prompt_id").join(edges.groupBy("prompt_id").agg((2.0 * F.sum(F.col("w") * F.col("w"))).alias("c")), "prompt_id")
    energy = squares.select("prompt_id", (F.col("a") + F.col("b") + F.col("c")).alias("energy"))
    drop = edges.join(resp, ["prompt_id", "resp_idx"]).groupBy("prompt_id", "claim_idx").agg(F.sum(2.0 * F.col("dr") * F.col("w") + F.col("w") * F.col("w")).alias("x"), F.sum("w").alias("d"))
    lost = drop.select("prompt_id", "claim_idx", (F.col("d") * F.col("d") + F.col("x")).alias("lost"))
    rows = all_claims(sizes).join(lost, ["prompt_id", "claim_idx"], "left").join(energy, "prompt_id", "left")
    return rows.select("prompt_id", "claim_idx", F.round(F.try_divide(F.coalesce("lost", F.lit(0.0)), F.col("energy")), 5).alias("laplacian"))


def _betweenness(w: np.ndarray) -> np.ndarray:
    """Unweighted betweenness of the first kind of nodes of a bipartite 0/1 matrix, over its largest possible value."""
    n, m = w.shape
    size = n + m
    near = [[*(n + np.flatnonzero(w[k])).tolist()] for k in range(n)] + [[*np.flatnonzero(w[:, k]).tolist()] for k in range(m)]
    score = np.zeros(size)
    for s in range(size):
        order, before, paths, steps = [], [[] for _ in range(size)], np.zeros(size), np.full(size, -1)
        paths[s], steps[s], queue = 1, 0, [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for x in near[v]:
                if steps[x] < 0:
                    steps[x] = steps[v] + 1
                    queue.append(x)
                if steps[x] == steps[v] + 1:
                    paths[x] += paths[v]
                    before[x].append(v)
        share = np.zeros(size)
        for x in reversed(order):
            for v in before[x]:
                share[v] += paths[v] / paths[x] * (1 + share[x])
            if x != s:
                score[x] += share[x]
    score /= 2
    s, t = (n - 1) // m, (n - 1) % m
    most = (m * m * (s + 1) ** 2 + m * (s + 1) * (2 * t - s - 1) - t * (2 * s - t + 3)) / 2
    return score[:n] / most if most else np.zeros(n)


def _pagerank(w: np.ndarray) -> np.ndarray:
    n, m = w.shape
    size = n + m
    a = np.zeros((size, size))
    a[:n, n:], a[n:, :n] = w, w.T
    out = a.sum(axis=1)
    step = np.divide(a, out[:, None], out=np.zeros_like(a), where=out[:, None] > 0)
    x = np.full(size, 1 / size)
    for _ in range(MOST_ROUNDS):
        new = DAMPING * (x @ step + x[out == 0].sum() / size) + (1 - DAMPING) / size
        if np.abs(new - x).sum() < size * TOLERANCE:
            return new[:n]
        x = new
    return np.full(n, np.nan)


def iterated(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, betweenness, pagerank); PageRank is null where it doesn't settle."""
    lists = edges.groupBy("prompt_id").agg(F.collect_list(F.struct("claim_idx", "resp_idx", "w")).alias("e"))
    rows = sizes.where("n_claims > 0 AND n_responses > 0").join(lists, "prompt_id", "left").select("prompt_id", "n_claims", "n_responses", "e")

    def run(frames):
        for frame in frames:
            parts = []
            for p, n, m, e in frame.itertuples(index=False):
                w = np.zeros((int(n), int(m)))
                for x in e if e is not None else []:
                    w[int(x["claim_idx"]), int(x["resp_idx"])] = x["w"]
                parts.append(pd.DataFrame({"prompt_id": p, "claim_idx": range(int(n)), "betweenness": np.round(_betweenness(w > 0), 5), "pagerank": np.round(_pagerank(w), 5)}))
            if parts:
                yield pd.concat(parts)

    found = rows.mapInPandas(run, "prompt_id long, claim_idx int, betweenness double, pagerank double")
    return found.withColumn("pagerank", F.when(~F.isnan("pagerank"), F.col("pagerank")))


def all_metrics(cells: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    edges = edges_of(cells, threshold)
    keys = ["prompt_id", "claim_idx"]
    return degree(edges, sizes).join(closeness(distances(edges, sizes)), keys).join(laplacian(edges, sizes), keys).join(iterated(edges, sizes), keys)
