"""From scores to probabilities, and how far scores are from being probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.operators.ensemble import brier, log_loss


def bins(spark: SparkSession, n: int = 10) -> DataFrame:
    """(bin, low, high): (low, high], the first one with 0."""
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), F.when(F.col("id") == 0, -1e-8).otherwise(F.col("id") / float(n)).alias("low"), ((F.col("id") + 1) / float(n)).alias("high"))


def check_inputs(graded: DataFrame, columns: list[str]) -> None:
    """Raises if a label isn't 0 or 1, or a score is outside [0, 1]."""
    bad = [F.sum((~F.col("correct").isin(0, 1)).cast("int")).alias("labels")] + [F.sum(((F.col(c) < 0) | (F.col(c) > 1)).cast("int")).alias(c) for c in columns]
    row = graded.agg(*bad).first()
    wrong = [k for k, v in row.asDict().items() if v]
    if wrong:
        raise ValueError(f"labels must be 0 or 1 and scores within [0, 1]: {', '.join(wrong)}")


def counts_by_scorer(long_graded: DataFrame) -> DataFrame:
    return long_graded.where("score IS NOT NULL").groupBy("scorer", "score").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("pos"))


def reliability(counts: DataFrame, table: DataFrame) -> DataFrame:
    """(scorer, bin, low, high, accuracy, confidence, count) of every bin; zeros where it is empty."""
    in_bin = (F.col("score") > F.col("low")) & (F.col("score") <= F.col("high"))
    rows = counts.join(F.broadcast(table), in_bin).groupBy("scorer", "bin").agg(F.sum("n").alias("count"), F.sum("pos").alias("pos"), F.sum(F.col("score") * F.col("n")).alias("s"))
    whole = counts.select("scorer").distinct().join(F.broadcast(table)).join(rows, ["scorer", "bin"], "left")
    mean = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("count").cast("double")), F.lit(0.0))
    return whole.select("scorer", "bin", "low", "high", mean("pos").alias("accuracy"), mean("s").alias("confidence"), F.coalesce("count", F.lit(0)).alias("count"))


def calibration_metrics(long_graded: DataFrame, n_bins: int = 10) -> DataFrame:
    """A row for each scorer: average confidence and accuracy, their gap, Brier score, log loss, ECE and MCE."""
    counts = counts_by_scorer(long_graded)
    bars = reliability(counts, bins(long_graded.sparkSession, n_bins))
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    total = F.sum("count")
    errors = bars.groupBy("scorer").agg(F.try_divide(F.sum(F.col("count") * gap), total.cast("double")).alias("ece"), F.max(F.when(F.col("count") > 0, gap).otherwise(0.0)).alias("mce"))
    means = counts.groupBy("scorer").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("average_confidence"), (F.sum("pos") / F.sum("n")).alias("average_accuracy"))
    means = means.withColumn("calibration_gap", F.abs(F.col("average_confidence") - F.col("average_accuracy")))
    return means.join(brier(counts, ["scorer"]), "scorer").join(log_loss(counts, ["scorer"]), "scorer").join(errors, "scorer")


class Calibrator:
    """Platt scaling or isotonic regression, one model for each score column."""

    def __init__(self, method: str = "platt"):
        if method not in ("platt", "isotonic"):
            raise ValueError("method must be platt or isotonic")
        self.method, self.models = method, {}

    def fit(self, graded: DataFrame, columns: list[str]) -> Calibrator:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import IsotonicRegression

        check_inputs(graded, columns)
        for c in columns:
            rows = graded.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("score"), F.col("correct").cast("double").alias("label"))
            if self.method == "isotonic":
                self.models[c] = IsotonicRegression(featuresCol="score").fit(rows)
            else:
                # a penalty of 1 on the squared weight, as a share of the rows
                rows = VectorAssembler(inputCols=["score"], outputCol="features").transform(rows)
                self.models[c] = LogisticRegression(regParam=1 / max(1, rows.count()), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(rows)
        return self

    def transform(self, scores: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Adds calibrated_<score> for each column."""
        if not self.models:
            raise ValueError("fit first")
        for c in columns or list(self.models):
            if c not in self.models:
                raise ValueError(f"{c} was not fitted")
            if self.method == "platt":
                m = self.models[c]
                scores = scores.withColumn(f"calibrated_{c}", 1.0 / (1.0 + F.exp(-(F.lit(float(m.coefficients[0])) * F.col(c) + F.lit(float(m.intercept))))))
            else:
                scores = scores.withColumn(f"calibrated_{c}", _interpolated(F.col(c), list(self.models[c].boundaries), list(self.models[c].predictions)))
        return scores

    def fit_transform(self, graded: DataFrame, columns: list[str]) -> DataFrame:
        return self.fit(graded, columns).transform(graded, columns)


def _interpolated(x, at: list[float], value: list[float]):
    """Linear between the model's points, flat beyond them: an array lookup, however many points there are."""
    xs, ys = F.array(*map(F.lit, map(float, at))), F.array(*map(F.lit, map(float, value)))
    k = F.size(F.filter(xs, lambda b: b <= x))
    low, high, a, b = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    return F.when(x.isNull(), None).when(k == 0, F.lit(float(value[0]))).when(k == len(at), F.lit(float(value[-1]))).otherwise(a + (b - a) * (x - low) / (high - low))
