"""Weighted ensembles, tuning of their weights and threshold, and quality measures.

Scores are long, (prompt_id, scorer, score), or wide, a column each.  A grid of
weights and thresholds is a table of fixed size; it is joined to score counts,
never to the prompts: scores are first counted by value, so a grid search
shuffles one row for each distinct score whatever the number of prompts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The components and weights of the default ensemble.
DEFAULT_WEIGHTS = {"noncontradiction": 0.56, "exact_match": 0.14, "self_judge": 0.30}
#: Objectives by name, and whether a larger value is better.
OBJECTIVES = {"fbeta_score": True, "accuracy_score": True, "balanced_accuracy_score": True, "log_loss": False, "roc_auc": True, "average_precision": True, "brier_score": False}
#: Objectives that need a threshold.
WITH_THRESHOLD = ("fbeta_score", "accuracy_score", "balanced_accuracy_score")
WHITE_BOX = ("sequence_probability", "min_probability", "mean_token_negentropy", "min_token_negentropy", "probability_margin", "monte_carlo_probability", "consistency_and_confidence", "semantic_negentropy", "semantic_density", "p_true")
BLACK_BOX = ("semantic_negentropy", "noncontradiction", "exact_match", "cosine_sim", "bert_score", "entailment", "semantic_sets_confidence")


def routed(components: list[str], n_judges: int = 0) -> dict[str, list[str]]:
    """Which family computes each component: token scores first, then sampling scores, judges as judge_k."""
    out: dict[str, list[str]] = {"white_box": [], "black_box": [], "judges": []}
    for name in components:
        if name in WHITE_BOX:
            out["white_box"].append(name)
        elif name in BLACK_BOX:
            out["black_box"].append(name)
        else:
            raise ValueError(f"{name}: no such component")
    out["judges"] = [f"judge_{k + 1}" for k in range(n_judges)]
    return out


def normalized_weights(weights: list[float] | None, n: int) -> list[float]:
    if weights is None:
        return [1 / n] * n
    if len(weights) != n:
        raise ValueError(f"{len(weights)} weights for {n} components")
    total = sum(weights)
    if not total:
        raise ValueError("weights sum to zero")
    return [w / total for w in weights]


def ensemble_scores(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(prompt_id, ensemble_score): weighted mean over the scores that are there, clipped to [0, 1]; null without any.

    weights: (scorer, weight), a row for each component.
    """
    rows = scores.where(F.col("score").isNotNull()).join(F.broadcast(weights), "scorer")
    mean = F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight"))
    known = rows.groupBy("prompt_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("ensemble_score"))
    return scores.select("prompt_id").distinct().join(known, "prompt_id", "left")


def long_scores(wide: DataFrame, columns: list[str]) -> DataFrame:
    return wide.unpivot("prompt_id", columns, "scorer", "score")


def weight_report(weights: DataFrame) -> DataFrame:
    total = F.sum("weight").over(Window.partitionBy())
    return weights.select("scorer", F.format_number(F.col("weight") / total, 4).alias("weight")).orderBy(F.desc("weight"), "scorer")


def grid(spark: SparkSession, low: float, step: float, n: int, name: str) -> DataFrame:
    """n values low + i * step: multiplied, not accumulated."""
    return spark.range(n).select((F.lit(low) + F.col("id") * F.lit(step)).alias(name))


def counts_by_score(graded: DataFrame, score: str = "score") -> DataFrame:
    """(score, n, pos): prompts and correct ones at each distinct score."""
    return graded.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("pos"))


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(counts: DataFrame, thresholds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn of score > threshold for every row of thresholds (fixed size, sent to all tasks).

    Scores are first counted by how many thresholds lie below them, so what
    meets the thresholds is as long as they are, not as there are scores.
    """
    others = [k for k in keys or [] if k != "threshold"]
    steps = thresholds.agg(F.array_sort(F.collect_set("threshold")).alias("steps"))
    below = counts.where("score IS NOT NULL").join(F.broadcast(steps)).withColumn("below", F.size(F.filter("steps", lambda t: t < F.col("score"))))
    binned = below.groupBy(*others, "below").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    rank = steps.select(F.posexplode("steps").alias("at", "threshold"))
    over = F.col("below") > F.col("at")
    count = lambda c, x: F.sum(F.when(c, x).otherwise(0)).alias
    neg = F.col("n") - F.col("pos")
    return binned.join(F.broadcast(rank)).groupBy(*others, "threshold").agg(count(over, F.col("pos"))("tp"), count(over, neg)("fp"), count(~over, F.col("pos"))("fn"), count(~over, neg)("tn"))


def with_threshold_metrics(found: DataFrame, beta: float = 1.0) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    b = beta * beta
    recall, other = _div(tp, tp + fn), _div(tn, tn + fp)
    return found.withColumns({"precision": _div(tp, tp + fp), "recall": recall, "fbeta_score": _div((1 + b) * tp, (1 + b) * tp + b * fn + fp), "accuracy_score": _div(tp + tn, tp + fp + fn + tn), "balanced_accuracy_score": (recall + other) / 2.0})


def best_threshold(counts: DataFrame, thresholds: DataFrame, objective: str = "fbeta_score", beta: float = 1.0) -> DataFrame:
    """(threshold, value): the first of the best."""
    if objective not in WITH_THRESHOLD:
        raise ValueError(f"{objective} has no threshold")
    rows = with_threshold_metrics(confusion(counts, thresholds), beta)
    best = rows.agg(F.max(F.struct(F.col(objective).alias("value"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.col("b.value").alias("value"))


def combined(wide: DataFrame, columns: list[str], weights: DataFrame, names: list[str]) -> DataFrame:
    """Ensemble scores for every row of a table of weight vectors, counted by value: (names..., score, n, pos).

    wide: component columns and correct.  Equal component vectors are counted first.
    """
    return scored_vectors(vector_counts(wide, columns), columns, weights, names)


def vector_counts(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(columns..., n, pos): rows and correct ones of each distinct component vector."""
    return wide.groupBy(*columns).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("pos"))


def scored_vectors(vectors: DataFrame, columns: list[str], weights: DataFrame, names: list[str]) -> DataFrame:
    rows = vectors.join(F.broadcast(weights))
    used = [F.when(F.col(c).isNotNull(), F.col(w)).otherwise(0.0) for c, w in zip(columns, names)]
    value = [F.coalesce(F.col(c), F.lit(0.0)) * F.col(w) for c, w in zip(columns, names)]
    total, top = used[0], value[0]
    for u, v in zip(used[1:], value[1:]):
        total, top = total + u, top + v
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(top, total)))
    return rows.groupBy(*names, F.round(score, 12).alias("score")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where("score IS NOT NULL")


def tuned_weights_and_threshold(wide: DataFrame, columns: list[str], weights: DataFrame, names: list[str], thresholds: DataFrame, objective: str = "fbeta_score", beta: float = 1.0) -> DataFrame:
    """(names..., threshold, value): the first best cell in the order of weights, then thresholds."""
    return _best_cell(combined(wide, columns, weights, names), names, thresholds, objective, beta)


def _best_cell(counts: DataFrame, names: list[str], thresholds: DataFrame, objective: str, beta: float) -> DataFrame:
    rows = with_threshold_metrics(confusion(counts, thresholds, [*names, "threshold"]), beta)
    order = [(-F.col(c)).alias(f"o{k}") for k, c in enumerate([*names, "threshold"])]
    best = rows.agg(F.max(F.struct(F.round(objective, 12).alias("value"), *order)).alias("b"))
    return best.select(*[(-F.col(f"b.o{k}")).alias(c) for k, c in enumerate([*names, "threshold"])], F.col("b.value").alias("value"))


#: Scores are cut into this many ranges of equal width (from 0 to 1) to be ordered apart.
RANGES = 1024


def _with_before(counts: DataFrame, keys: list[str], falling: bool) -> DataFrame:
    """Adds pos_before and n_before: sums over the scores before (falling: the higher ones).

    Ranges of scores are summed up on their own, then each is moved by the sum
    of those before it: no task gets all scores of a scorer.
    """
    order = lambda c: F.desc(c) if falling else F.asc(c)
    rows = counts.withColumn("range", F.floor(F.col("score") * RANGES))
    by = [*keys, "range"]
    prior = Window.partitionBy(*keys).orderBy(order("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("n").alias("m")).select(*by, *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(f"{c}_moved") for c in ("p", "m")])
    inside = Window.partitionBy(*by).orderBy(order("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("pos", "n")}
    found = rows.withColumns(before).join(ranges, by)
    return found.withColumns({"pos_before": F.col("pos_before") + F.col("p_moved"), "n_before": F.col("n_before") + F.col("m_moved")}).drop("range", "p_moved", "m_moved")


def auc(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., roc_auc) by ranks with ties in the middle; null without both classes."""
    keys = keys or []
    rows = _with_before(counts, keys, False).withColumn("won", F.col("pos") * (F.col("n_before") - F.col("pos_before") + (F.col("n") - F.col("pos")) / 2.0))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * (F.sum("n") - F.sum("pos"))).alias("roc_auc"))


def average_precision(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., average_precision): step-wise over distinct scores, from the highest."""
    keys = keys or []
    rows = _with_before(counts, keys, True).withColumn("precision", (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n")))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos").cast("double")).alias("average_precision"))


def inverted(counts: DataFrame) -> DataFrame:
    """Counts of wrong answers by 1 - score."""
    return counts.withColumns({"score": 1.0 - F.col("score"), "pos": F.col("n") - F.col("pos")})


def log_loss(counts: DataFrame, keys: list[str] | None = None, eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col("score")))
    lost = F.col("pos") * F.ln(p) + (F.col("n") - F.col("pos")) * F.ln(1.0 - p)
    return counts.groupBy(*(keys or [])).agg((-F.try_divide(F.sum(lost), F.sum("n").cast("double"))).alias("log_loss"))


def brier(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    s = F.col("score")
    lost = F.col("pos") * (1.0 - s) * (1.0 - s) + (F.col("n") - F.col("pos")) * s * s
    return counts.groupBy(*(keys or [])).agg(F.try_divide(F.sum(lost), F.sum("n").cast("double")).alias("brier_score"))


def accuracy_by_threshold(counts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, accuracy, sample_size) of score >= threshold; null accuracy where nothing is left."""
    kept = F.col("score") >= F.col("threshold")
    rows = counts.join(F.broadcast(thresholds)).groupBy("threshold").agg(F.sum(F.when(kept, F.col("pos")).otherwise(0)).alias("pos"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("sample_size"))
    return rows.select("threshold", F.try_divide(F.col("pos").cast("double"), F.col("sample_size").cast("double")).alias("accuracy"), "sample_size")


def halton(n: int, base: int) -> list[float]:
    """The first n points of a low-discrepancy sequence."""
    out = []
    for k in range(1, n + 1):
        f, x = 1.0, 0.0
        while k:
            f /= base
            x += f * (k % base)
            k //= base
        out.append(x)
    return out


def candidate_weights(n_components: int, trials: int = 100) -> list[tuple[float, ...]]:
    """A fixed list of weight vectors that sum to one, spread out evenly: where a search begins."""
    primes = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    columns = [halton(trials, primes[k % len(primes)]) for k in range(n_components)]
    return [tuple(x / sum(row) for x in row) for row in zip(*columns)]


def neighbours(weights: tuple[float, ...], step: float) -> list[tuple[float, ...]]:
    """The weights, and what they become if ``step`` of the total (or all there is) goes from one component to another."""
    out = [weights]
    for a in range(len(weights)):
        given = min(step, weights[a])
        out += [tuple(w - given if k == a else w + given if k == b else w for k, w in enumerate(weights)) for b in range(len(weights)) if b != a and given > 0]
    return out


def searched_weights(wide: DataFrame, columns: list[str], objective: str, thresholds: DataFrame | None = None, beta: float = 1.0, trials: int = 100, rounds: int = 8, step: float = 0.2) -> tuple[list[float], float | None, float | None]:
    """(weights, threshold or None, value) of a sequential search: each list of trials depends on what the last one found.

    The first half of the trials is spread out evenly; after that the best is
    moved by ``step``, which is halved whenever no move is better.  Equal
    component vectors are counted once, before the first round, and one row of
    each round reaches the driver.  Same data, same result.
    """
    from pyspark import StorageLevel

    names = [f"w{k}" for k in range(len(columns))]
    vectors = vector_counts(wide, columns).persist(StorageLevel.DISK_ONLY)
    sign = 1.0 if OBJECTIVES[objective] else -1.0

    def best_of(rows: list[tuple[float, ...]]):
        counts = scored_vectors(vectors, columns, wide.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names)
        if thresholds is not None:
            return _best_cell(counts, names, thresholds, objective, beta).first()
        measure = {"roc_auc": auc, "average_precision": average_precision, "log_loss": log_loss, "brier_score": brier}[objective](counts, names)
        order = F.desc_nulls_last("value") if sign > 0 else F.asc_nulls_last("value")
        return measure.withColumnRenamed(objective, "value").orderBy(order, *names).first()

    try:
        best = best_of(candidate_weights(len(columns), max(1, trials // 2)))
        for _ in range(rounds):
            if best is None or best["value"] is None:
                break
            found = best_of(neighbours(tuple(best[n] for n in names), step))
            if sign * (found["value"] - best["value"]) > 1e-9:
                best = found
            else:
                step /= 2.0
    finally:
        vectors.unpersist()
    if best is None:
        return normalized_weights(None, len(columns)), None, None
    return [float(best[n]) for n in names], float(best["threshold"]) if thresholds is not None else None, best["value"]


def ranked_metrics(long_graded: DataFrame) -> DataFrame:
    """(metric, scorer, category, value) of all scorers, ascending: AUROC of being right, AUPRC of being wrong."""
    counts = long_graded.where("score IS NOT NULL").groupBy("scorer", "score").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("pos"))
    roc = auc(counts, ["scorer"]).select(F.lit("auroc").alias("metric"), "scorer", F.col("roc_auc").alias("value"))
    prc = average_precision(inverted(counts), ["scorer"]).select(F.lit("auprc").alias("metric"), "scorer", F.col("average_precision").alias("value"))
    kind = F.when(F.col("scorer").startswith("judge_"), "Judges").when(F.col("scorer").startswith("ensemble"), "Ensemble").when(F.col("scorer").isin(*BLACK_BOX), "Black-Box").when(F.col("scorer").isin(*WHITE_BOX), "White-Box").otherwise("Other")
    return roc.union(prc).withColumn("category", kind).orderBy("metric", "value", "scorer")
