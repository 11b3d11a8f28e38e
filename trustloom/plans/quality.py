"""Queries over graded scores: ensembles, tuning, ranking and calibration quality, code scores, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.operators import calibration as Cal
from trustloom.operators import code_scores as Code
from trustloom.operators import ensemble as E
from trustloom.plans.registry import query
from trustloom.plans.scoring import rounded
from trustloom.plans.sql import G1, GL
from trustloom.sources import bindings as B

COLUMNS = ["s1", "s2", "s3", "s4"]
WEIGHTS = [("s1", 0.4), ("s2", 0.3), ("s3", 0.2), ("s4", 0.1)]
COUNTS = f"{GL}, ct AS (SELECT scorer, score, count(*) AS n, sum(correct)::BIGINT AS pos FROM gl GROUP BY 1, 2)"


def long_graded(spark, d):
    return B.graded(spark, d).unpivot(["prompt_id", "correct"], COLUMNS, "scorer", "score")


@query("ensemble_scores", "E1 E2 E3 E4", f"WITH {G1} SELECT prompt_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.4 * s1 + 0.3 * s2 + 0.2 * s3 + 0.1 * coalesce(s4, 0)) / (0.9::DOUBLE + CASE WHEN s4 IS NULL THEN 0 ELSE 0.1 END))), 6) AS ensemble_score FROM g1")
def ensemble_scores(spark, d):
    return rounded(E.ensemble_scores(long_graded(spark, d), spark.createDataFrame(WEIGHTS, "scorer string, weight double")), "ensemble_score")


@query("weight_report", "E24 E2", "SELECT scorer, printf('%.4f', w / 2.0::DOUBLE) AS weight FROM (VALUES ('a', 1.0::DOUBLE), ('b', 0.75::DOUBLE), ('c', 0.25::DOUBLE)) t(scorer, w)")
def weight_report(spark, d):
    return E.weight_report(spark.createDataFrame([("a", 1.0), ("b", 0.75), ("c", 0.25)], "scorer string, weight double"))


THRESHOLDS = "th AS (SELECT i, i * 0.01::DOUBLE AS threshold FROM range(100) t(i))"
METRICS = "(2 * tp)::DOUBLE / nullif(2 * tp + fn + fp, 0) AS f1, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS acc, (coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2 AS bal"


@query("best_thresholds", "E5 E9 E10 E12", f"""WITH {G1}, {THRESHOLDS}, cf AS (SELECT i, threshold, sum((s1 > threshold AND correct = 1)::INT) AS tp, sum((s1 > threshold AND correct = 0)::INT) AS fp, sum((s1 <= threshold AND correct = 1)::INT) AS fn, sum((s1 <= threshold AND correct = 0)::INT) AS tn FROM g1, th GROUP BY 1, 2),
m AS (SELECT i, threshold, {METRICS} FROM cf), l AS (SELECT threshold, unnest(['fbeta_score', 'accuracy_score', 'balanced_accuracy_score']) AS objective, unnest([coalesce(f1, 0), acc, bal]) AS value FROM m)
SELECT objective, round(threshold, 6) AS threshold, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY value DESC, threshold) AS n FROM l) WHERE n = 1""")
def best_thresholds(spark, d):
    counts = E.counts_by_score(B.graded(spark, d), "s1")
    grid = E.grid(spark, 0.0, 0.01, 100, "threshold")
    out = None
    for name in ("fbeta_score", "accuracy_score", "balanced_accuracy_score"):
        row = E.best_threshold(counts, grid, name).select(F.lit(name).alias("objective"), "threshold", "value")
        out = row if out is None else out.union(row)
    return rounded(out, "threshold", "value")


@query("tuned_weights_threshold", "E6 E11", f"""WITH {G1}, w AS (SELECT i / 19.0::DOUBLE AS w1 FROM range(20) t(i)), th AS (SELECT 0.05::DOUBLE + j * 0.05::DOUBLE AS threshold FROM range(19) t(j)),
v AS (SELECT s1, s2, count(*) AS n, sum(correct) AS pos FROM g1 GROUP BY 1, 2), sc AS (SELECT w1, round((w1 * s1 + (1 - w1) * s2) / (w1 + (1 - w1)), 12) AS s, sum(n) AS n, sum(pos) AS pos FROM v, w GROUP BY 1, 2),
cf AS (SELECT w1, threshold, sum(CASE WHEN s > threshold THEN pos ELSE 0 END) AS tp, sum(CASE WHEN s > threshold THEN n - pos ELSE 0 END) AS fp, sum(CASE WHEN s > threshold THEN 0 ELSE pos END) AS fn, sum(CASE WHEN s > threshold THEN 0 ELSE n - pos END) AS tn FROM sc, th GROUP BY 1, 2),
m AS (SELECT w1, threshold, {METRICS} FROM cf)
SELECT round(w1, 6) AS w1, round(1 - w1, 6) AS w2, round(threshold, 6) AS threshold, round(bal, 6) AS value FROM m ORDER BY round(bal, 12) DESC, w1, threshold LIMIT 1""")
def tuned_weights_threshold(spark, d):
    weights = spark.range(20).select((F.col("id") / 19.0).alias("w1"), (1.0 - F.col("id") / 19.0).alias("w2"))
    out = E.tuned_weights_and_threshold(B.graded(spark, d), ["s1", "s2"], weights, ["w1", "w2"], E.grid(spark, 0.05, 0.05, 19, "threshold"), "balanced_accuracy_score")
    return rounded(out, "w1", "w2", "threshold", "value")


SIMPLEX = "w AS (SELECT i * 0.1::DOUBLE AS w1, j * 0.1::DOUBLE AS w2, (10 - i - j) * 0.1::DOUBLE AS w3 FROM range(11) a(i), range(11) b(j) WHERE i + j <= 10)"


@query("tuned_weights", "E7", f"""WITH {G1}, {SIMPLEX}, s AS (SELECT w1, w2, w3, correct, round((w1 * s1 + w2 * s2 + w3 * s3) / (w1 + w2 + w3), 12) AS s FROM g1, w), c AS (SELECT w1, w2, w3, s, count(*) AS n, sum(correct) AS pos FROM s GROUP BY 1, 2, 3, 4),
k AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY w1, w2, w3 ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c), a AS (SELECT w1, w2, w3, sum(pos * (b + (n - pos) / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * (sum(n) - sum(pos))) AS auc FROM k GROUP BY 1, 2, 3)
SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(auc, 6) AS roc_auc FROM a ORDER BY round(auc, 9) DESC, w1, w2 LIMIT 1""")
def tuned_weights(spark, d):
    ten = spark.range(11)
    weights = ten.select(F.col("id").alias("i")).join(ten.select(F.col("id").alias("j"))).where("i + j <= 10").select((F.col("i") * 0.1).alias("w1"), (F.col("j") * 0.1).alias("w2"), ((10 - F.col("i") - F.col("j")) * 0.1).alias("w3"))
    found = E.auc(E.combined(B.graded(spark, d), ["s1", "s2", "s3"], weights, ["w1", "w2", "w3"]), ["w1", "w2", "w3"])
    return rounded(found.orderBy(F.round("roc_auc", 9).desc(), "w1", "w2").limit(1), "w1", "w2", "w3", "roc_auc")


@query("searched_weights", "E8")
def searched_weights(spark, d):
    objective = "balanced_accuracy_score"
    weights, threshold, value = E.searched_weights(B.graded(spark, d), COLUMNS, objective, E.grid(spark, 0.01, 0.01, 99, "threshold"))
    return spark.createDataFrame([(*weights, threshold, value)], "w1 double, w2 double, w3 double, w4 double, threshold double, value double")


@query("ensemble_settings", "S18", "SELECT * FROM (VALUES ('exact_match', 0.75::DOUBLE, 0.4::DOUBLE), ('noncontradiction', 0.25::DOUBLE, 0.4::DOUBLE)) t(component, weight, threshold)")
def ensemble_settings(spark, d):
    import json

    from trustloom.plans.api import ScoreEnsemble

    held = json.dumps(ScoreEnsemble(["exact_match", "noncontradiction"], [3.0, 1.0], 0.4).settings())
    again = ScoreEnsemble.of_settings(json.loads(held))
    return spark.createDataFrame([(c, w, again.threshold) for c, w in zip(again.components, again.weights)], "component string, weight double, threshold double")


ASKED = ["sequence_probability", "semantic_density", "normalized_probability", "no_such_score"]


@query("scorer_names", "W13 F1", "SELECT * FROM (VALUES ('sequence_probability', true, true), ('semantic_density', true, false), ('normalized_probability', false, false), ('no_such_score', false, false)) t(name, white_box, code)")
def scorer_names(spark, d):
    from trustloom.plans.api import CodeScorer, TokenScorer

    def taken(kind, name):
        try:
            return bool(kind([name]))
        except ValueError:
            return False

    return spark.createDataFrame([(n, taken(TokenScorer, n), taken(CodeScorer, n)) for n in ASKED], "name string, white_box boolean, code boolean")


@query("ranked_metrics", "E13 E14 E16 J8 S20", f"""WITH {COUNTS}, k AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY scorer ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
  sum(n - pos) OVER w AS fp, sum(n) OVER w AS al FROM ct WINDOW w AS (PARTITION BY scorer ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT 'auroc' AS metric, scorer, 'Other' AS category, round(sum(pos * (b + (n - pos) / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * (sum(n) - sum(pos))), 6) AS value FROM k GROUP BY scorer
UNION ALL SELECT 'auprc', scorer, 'Other', round(sum((n - pos) * fp / al::DOUBLE) / sum(n - pos)::DOUBLE, 6) FROM k GROUP BY scorer""")
def ranked_metrics(spark, d):
    return rounded(E.ranked_metrics(long_graded(spark, d)), "value")


@query("accuracy_by_threshold", "E15 S20", f"""WITH {G1}, t AS (SELECT i * 0.1::DOUBLE AS threshold FROM range(10) x(i)) SELECT round(threshold, 6) AS threshold, round(avg(correct) FILTER (s2 >= threshold), 6) AS accuracy, count(*) FILTER (s2 >= threshold)::BIGINT AS sample_size FROM g1, t GROUP BY threshold""")
def accuracy_by_threshold(spark, d):
    return rounded(E.accuracy_by_threshold(E.counts_by_score(B.graded(spark, d), "s2"), E.grid(spark, 0.0, 0.1, 10, "threshold")), "threshold", "accuracy")


BINS = "bn AS (SELECT i::INT AS bin, CASE i WHEN 0 THEN -0.00000001::DOUBLE ELSE i / 10.0::DOUBLE END AS low, (i + 1) / 10.0::DOUBLE AS high FROM range(10) t(i))"
BARS = f"{COUNTS}, {BINS}, br AS (SELECT s.scorer, b.bin, b.low, b.high, coalesce(sum(c.n), 0)::BIGINT AS count, coalesce(sum(c.pos)::DOUBLE / sum(c.n), 0) AS accuracy, coalesce(sum(c.score * c.n) / sum(c.n), 0) AS confidence FROM (SELECT DISTINCT scorer FROM ct) s CROSS JOIN bn b LEFT JOIN ct c ON c.scorer = s.scorer AND c.score > b.low AND c.score <= b.high GROUP BY 1, 2, 3, 4)"


@query("reliability", "E18", f"WITH {BARS} SELECT scorer, bin, round(low, 6) + 0 AS low, round(high, 6) AS high, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence, count FROM br")
def reliability(spark, d):
    return rounded(Cal.reliability(Cal.counts_by_scorer(long_graded(spark, d)), Cal.bins(spark)), "low", "high", "accuracy", "confidence").withColumn("low", F.col("low") + 0.0)


@query("calibration_metrics", "E9 E17 E19 E23", f"""WITH {BARS}, e AS (SELECT scorer, sum(count * abs(accuracy - confidence)) / sum(count)::DOUBLE AS ece, max(CASE WHEN count > 0 THEN abs(accuracy - confidence) ELSE 0 END) AS mce FROM br GROUP BY 1),
m AS (SELECT scorer, avg(score) AS ac, avg(correct) AS aa, avg((correct - score) * (correct - score)) AS bs, -avg(CASE WHEN correct = 1 THEN ln(greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, score))) ELSE ln(1 - greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, score))) END) AS ll FROM gl GROUP BY 1)
SELECT scorer, round(ac, 6) AS average_confidence, round(aa, 6) AS average_accuracy, round(abs(ac - aa), 6) AS calibration_gap, round(bs, 6) AS brier_score, round(ll, 4) AS log_loss, round(ece, 6) AS ece, round(mce, 6) AS mce FROM m JOIN e USING (scorer)""")
def calibration_metrics(spark, d):
    out = Cal.calibration_metrics(long_graded(spark, d))
    return rounded(out, "average_confidence", "average_accuracy", "calibration_gap", "brier_score", "ece", "mce").withColumn("log_loss", F.round("log_loss", 4))


@query("platt_calibrated", "E20 E22")
def platt_calibrated(spark, d):
    return rounded(Cal.Calibrator("platt").fit_transform(B.graded(spark, d), ["s1", "s2"]), "calibrated_s1", "calibrated_s2", digits=4)


@query("isotonic_calibrated", "E21 E22")
def isotonic_calibrated(spark, d):
    return rounded(Cal.Calibrator("isotonic").fit_transform(B.graded(spark, d), ["s1", "s2"]), "calibrated_s1", "calibrated_s2")


@query("output_comparison", "F5", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS passed FROM events")
def output_comparison(spark, d):
    k, v = F.col("event_id") % 4, (F.col("event_id") % 100).cast("string")
    expected = F.concat(F.lit("total "), v, F.lit("\n1.50 2"))
    actual = F.when(k == 0, F.concat(expected, F.lit("\n"))).when(k == 1, F.concat(F.lit("total "), v, F.lit(" \n1.5 2.0"))).when(k == 2, F.concat(F.lit("total "), v)).otherwise(F.concat(F.lit("total "), v, F.lit("\n1.50 3")))
    return B.table(spark, d, "events").select("event_id", Code.output_matches(actual, expected).alias("passed"))


@query("code_overlap", "F1 F3")
def code_overlap(spark, d):
    rows = B.table(spark, d, "part").select(F.col("p_partkey").alias("prompt_id"), F.concat(F.lit("def f(x):\n    return x + "), F.col("p_size")).alias("original"), F.concat(F.lit("def g(x):\n    return "), F.col("p_size"), F.lit(" + x")).alias("sample"))
    return rounded(Code.codebleu(rows), "codebleu")


@query("code_similarity", "F1 F3")
def code_similarity(spark, d):
    size = F.col("p_size").cast("string")
    one = F.concat(F.lit("def f(x):\n    y = x + "), size, F.lit("\n    return y"))
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("def g(a):\n    b = a + "), size, F.lit("\n    return b"))).otherwise(F.concat(F.lit("def g(a):\n    return a + "), size))
    rows = B.table(spark, d, "part").select(F.col("p_partkey").alias("prompt_id"), one.alias("original"), other.alias("sample"))
    return rounded(Code.codebleu_of_python(rows), "codebleu")


GRADED = [
    (1, "class Solution:\n    def twice(self, x):\n        return x * 2", "twice", [("3", "6"), ('"a"', '"aa"')]),
    (2, "def last(x):\n    return x[0]", "last", [("[1, 1]", "1"), ("[1, 2]", "2"), ("[3, 3]", "3")]),
    (3, "print(float(input()) / 2)", None, [("3", "1.50")]),
    (4, "raise ValueError", None, [("", "")]),
]


@query("program_verdicts", "F4 F5", "SELECT * FROM (VALUES (1::BIGINT, true, NULL::DOUBLE, 2), (2, false, -2, 2), (3, true, NULL, 1), (4, false, -4, 1)) t(row_id, passed, error_code, n_run)")
def program_verdicts(spark, d):
    rows = spark.createDataFrame(GRADED, "row_id long, code string, entry string, cases array<struct<input:string,output:string>>")
    return Code.grade_programs(rows).drop("error_message").withColumn("error_code", F.col("error_code").cast("double"))


@query("program_cases", "F4")
def program_cases(spark, d):
    rows = [(1, "print(int(input()) * 2)", [("3", "6"), ("5", "10")]), (2, "print(1)", [("", "2")]), (3, "raise SystemExit(3)", [("", "")])]
    return Code.run_cases(spark.createDataFrame(rows, "row_id long, code string, cases array<struct<input:string,output:string>>"))


@query("user_functions", "F6 F7 F8", "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1")
def user_functions(spark, d):
    from trustloom.functions.udf import register

    register(spark)
    B.table(spark, d, "events").createOrReplaceTempView("scored_events")
    return spark.sql("SELECT event_type, round(root_mean_square(value), 6) AS rms FROM scored_events GROUP BY event_type")
