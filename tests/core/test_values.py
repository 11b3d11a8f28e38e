"""Hand-checked values of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.functions import text as T
from trustloom.functions import verdicts as V
from trustloom.operators import calibration as Cal
from trustloom.operators import claim_graph as G
from trustloom.operators import clustering as C
from trustloom.operators import ensemble as E
from trustloom.operators import longform as L
from trustloom.operators import token_scores as W


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, want", [("$3.134", "3"), ("the answer is 12 cookies", "12"), ("Hmmm /n perhaps 555.,7&333$5x", "555")])
def test_integer_part(spark, text, want):
    assert one(spark, T.integer_part, text) == want


@pytest.mark.parametrize("text, want", [
    ("Dr. Smith went home. He slept.", ["Dr. Smith went home.", "He slept."]), ("It costs 10.5 dollars. Really! Yes? No", ["It costs 10.5 dollars.", "Really!", "Yes?", "No"]),
    ("He lives in N.Y. Now he moved to the U.S. Fine.", ["He lives in N.Y. Now he moved to the U.S. Fine."]), ("Hello! How are you?", ["Hello!", "How are you?"]), ("", [""]),
])
def test_sentences(spark, text, want):
    assert one(spark, T.sentences, text) == want


def test_claims_bullets_questions(spark):
    assert one(spark, T.claims, "x\n### a  b\n### c\n###\n") == ["a b", "c"]
    assert one(spark, T.claims, "### None") == []
    assert one(spark, T.bullets, "- a\n  - b c\nd - e") == ["a", "b c"]
    assert one(spark, T.questions, "###a###b") == ["a", "b"]


@pytest.mark.parametrize("parser, text, want", [
    (V.ternary, "incorrect", 0.0), (V.ternary, "uncertain", 0.5), (V.ternary, "That's Right", 1.0), (V.ternary, "maybe", None), (V.binary, "uncertain", None),
    (V.continuous, "95", 0.95), (V.continuous, "95.5", None), (V.continuous, "Score 9 of 10", None), (V.likert, "5", 1.0), (V.likert, " 3 ", 0.5), (V.likert, "partially correct", 0.5), (V.likert, "completely incorrect", 0.0),
    (V.equivalence, "Equivalent", 1.0), (V.equivalence, "NOT EQUIVALENT", 0.0), (V.equivalence, "they behave the same", 1.0), (V.equivalence, "behave differently", 0.0), (V.equivalence, "?", None),
    (V.verbal_confidence, "Very good chance.", 0.8), (V.verbal_confidence, "x", None), (V.entails, "Yes.", 1.0), (V.entails, "NO", 0.0),
])
def test_verdicts(spark, parser, text, want):
    assert one(spark, parser, text) == want


def test_threshold_tuning(spark):
    graded = spark.createDataFrame(list(zip([0.1, 0.4, 0.35, 0.8], [0, 1, 0, 1])), "score double, correct int")
    best = E.best_threshold(E.counts_by_score(graded), E.grid(spark, 0.0, 0.01, 100, "threshold")).first()
    assert best.threshold == pytest.approx(0.35) and best.value == 1.0


def test_average_precision_is_stepwise(spark):
    graded = spark.createDataFrame(list(zip([0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1])), "score double, correct int")
    counts = E.counts_by_score(graded)
    assert E.average_precision(counts).first()[0] == pytest.approx(0.8333333) and E.auc(counts).first()[0] == pytest.approx(0.75)


def test_calibration_errors(spark):
    rows = [("a", s, y) for s, y in zip([0.1, 0.1, 0.9, 0.9], [0, 1, 0, 1])] + [("b", s, 0) for s in (0.1, 0.1, 0.9, 0.9)]
    got = {r.scorer: r for r in Cal.calibration_metrics(spark.createDataFrame(rows, "scorer string, score double, correct int"), 2).collect()}
    assert got["a"].ece == pytest.approx(0.4) and got["b"].mce == pytest.approx(0.9) and np.isfinite(got["b"].log_loss)


def test_calibrators_are_monotone_and_check_inputs(spark):
    rows = [(k, k / 40, int(k % 3 > 0 and k > 10)) for k in range(41)]
    df = spark.createDataFrame(rows, "prompt_id int, s double, correct int")
    for method in ("platt", "isotonic"):
        values = [r.calibrated_s for r in Cal.Calibrator(method).fit_transform(df, ["s"]).orderBy("s").collect()]
        assert all(a <= b + 1e-12 for a, b in zip(values, values[1:])) and all(0 <= v <= 1 for v in values)
    with pytest.raises(ValueError):
        Cal.Calibrator().fit(df.withColumn("s", F.col("s") * 3), ["s"])
    with pytest.raises(ValueError):
        Cal.Calibrator().transform(df)


def test_graph_edges_and_metrics(spark):
    cells = [(1, c, r, w) for c, row in enumerate([[0.8, 0.6, 0.9], [0.3, 0.7, 0.5]]) for r, w in enumerate(row)]
    cells += [(2, c, r, w) for c, row in enumerate([[0.9, 0.8, 0.7], [0.8, 0.9, 0.6], [0.7, 0.6, 0.9]]) for r, w in enumerate(row)]
    cells = spark.createDataFrame(cells, "prompt_id long, claim_idx int, resp_idx int, w double")
    sizes = spark.createDataFrame([(1, 2, 3), (2, 3, 3)], "prompt_id long, n_claims int, n_responses int")
    kept = {(r.claim_idx, r.resp_idx) for r in G.edges_of(cells).where("prompt_id = 1").collect()}
    assert (1, 0) not in kept and (1, 2) in kept
    rows = G.all_metrics(cells, sizes).collect()
    assert len(rows) == 5
    for r in rows:
        assert all(0 <= r[c] <= 1 for c in ("degree", "closeness", "harmonic", "laplacian", "betweenness", "pagerank"))
    full = [r for r in rows if r.prompt_id == 2]
    assert all(r.closeness == 1.0 and r.harmonic == 1.0 for r in full) and full[0].degree == pytest.approx(0.8)


def test_laplacian_equals_spectrum(spark):
    rng = np.random.default_rng(2)
    w = np.round(rng.uniform(0.5, 1, (3, 4)), 3)
    cells = spark.createDataFrame([(1, i, j, float(w[i, j])) for i in range(3) for j in range(4)], "prompt_id long, claim_idx int, resp_idx int, w double")
    sizes = spark.createDataFrame([(1, 3, 4)], "prompt_id long, n_claims int, n_responses int")

    def energy(keep):
        a = np.zeros((7, 7))
        a[:3, 3:] = w
        a += a.T
        a = a[np.ix_(keep, keep)]
        return (np.linalg.eigvalsh(np.diag(a.sum(1)) - a) ** 2).sum()

    whole = energy(list(range(7)))
    for r in G.laplacian(cells, sizes).collect():
        assert r.laplacian == pytest.approx((whole - energy([k for k in range(7) if k != r.claim_idx])) / whole, abs=1e-5)


def test_clusters_may_overlap(spark):
    responses = spark.createDataFrame([(1, k, t) for k, t in enumerate("abcd")], "prompt_id int, sample_idx int, text string")
    edges = spark.createDataFrame([(1, 0, 2), (1, 1, 2)], "prompt_id int, i int, j int")
    got = sorted(tuple(r)[1:] for r in C.memberships(responses, edges).collect())
    assert got == [(0, 0), (0, 2), (1, 1), (1, 2), (2, 3)]
    assert (1, 2) not in [tuple(r)[1:] for r in C.memberships(responses, edges, exclusive=True).collect()]
    p = {r.cluster_idx: r.p for r in C.cluster_probabilities(C.memberships(responses, edges)).collect()}
    assert p == {0: 0.4, 1: 0.4, 2: 0.2}


def test_entropy_of_known_clusters(spark):
    for sizes, want in (((6,), 0), ((2, 2, 1, 1), 1.329661), ((4, 2), 0.636514), ((5, 1), 0.450561), ((4, 1, 1), 0.867563)):
        df = spark.createDataFrame([(1, k, n / 6) for k, n in enumerate(sizes)], "prompt_id int, cluster_idx int, p double")
        assert C.entropy(df).first().entropy == pytest.approx(want, abs=1e-6)


def test_missing_logprobs_give_null(spark):
    tokens = spark.createDataFrame([(1, 0, 0, -0.1, [0.0]), (1, 0, 1, None, None), (2, 0, 0, -0.5, [-0.5, -1.0])], "prompt_id int, sample_idx int, token_idx int, logprob double, top array<double>")
    got = {r.prompt_id: r for r in W.single_scores(tokens).collect()}
    assert got[1].sequence_probability is None and got[2].sequence_probability == pytest.approx(np.exp(-0.5))
    assert W.top_scores(tokens).where("prompt_id = 2").first().mean_token_negentropy is None


def test_refinement(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.2), (1, 1, "b", 0.6), (2, 0, "c", 0.1)], "prompt_id int, claim_idx int, claim string, s double")
    marked = L.marked(rows, "s")
    assert [r.removed for r in marked.orderBy("prompt_id", "claim_idx").collect()] == [True, False, True]
    texts = spark.createDataFrame([(1, "a b"), (2, "c")], "prompt_id int, text string")
    assert {r.prompt_id: r.refined_response for r in L.rebuilt(marked, texts).collect()} == {1: "b", 2: "c"}
    assert {r.prompt_id: r.refined_s for r in L.refined(marked, ["s"]).collect()} == {1: 0.6, 2: None}
