import pytest

import trustloom as t
from trustloom.sources import bindings as B

RESPONSES = [(1, 0, "ab"), (1, 1, "ab"), (1, 2, "cd"), (2, 0, "xy"), (2, 1, "xy"), (2, 2, "xy")]


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame(RESPONSES, "prompt_id long, sample_idx int, text string")


def nli(pairs):
    return B.overlap_nli(pairs, B.characters)


def test_sampling_scores(responses):
    scorer = t.SamplingScorer(["semantic_negentropy", "exact_match", "noncontradiction", "semantic_sets_confidence"], nli)
    got = {r.prompt_id: r for r in scorer.score(responses).to_df().collect()}
    assert got[2].exact_match == got[2].semantic_negentropy == got[2].noncontradiction == 1.0
    assert got[1].exact_match == 0.5 and 0 < got[1].semantic_negentropy < 1 and got[1].sampled_responses == ["ab", "cd"]
    with pytest.raises(ValueError):
        t.SamplingScorer(["no_such_score"], nli)
    with pytest.raises(ValueError):
        t.SamplingScorer(["entailment"])


def test_token_and_density_scores(spark, responses):
    tokens = spark.createDataFrame([(p, s, k, -0.1 * (k + s + 1), [-0.1, -2.0]) for p, s, _ in RESPONSES for k in range(2)], "prompt_id long, sample_idx int, token_idx int, logprob double, top array<double>")
    names = ["sequence_probability", "mean_token_negentropy", "probability_margin", "monte_carlo_probability", "semantic_density", "semantic_negentropy"]
    rows = t.TokenScorer(names, nli, top_k=2).score(tokens, responses).data.collect()
    assert len(rows) == 2 and all(0 <= r[c] <= 1 for r in rows for c in names)
    assert t.EntropyScorer(nli).score(responses, tokens).data.where("prompt_id = 2").first().discrete_entropy_value == 0


def test_panel(spark):
    raw = spark.createDataFrame([(1, 0, "correct"), (1, 1, "incorrect"), (2, 0, "correct"), (2, 1, "??")], "prompt_id int, judge_id int, raw_text string")
    got = {r.prompt_id: r for r in t.JudgePanel([0, 1]).score(raw).data.collect()}
    assert (got[1].judge_1, got[1].judge_2, got[1].avg, got[1].median) == (1.0, 0.0, 0.5, 0.5) and got[2].avg is None


def test_ensemble_tunes_and_saves(spark, tmp_path):
    rows = [(k, k / 50, (k * 7 % 50) / 50, int(k > 25)) for k in range(50)]
    df = spark.createDataFrame(rows, "prompt_id int, a double, b double, correct int")
    e = t.ScoreEnsemble(["a", "b"]).tune(df, "roc_auc", weight_steps=11)
    assert e.weights == [1.0, 0.0] or e.weights[0] > 0.8
    e.tune(df, "fbeta_score", weight_steps=11)
    e.save(str(tmp_path / "e.json"))
    again = t.ScoreEnsemble.load(str(tmp_path / "e.json"))
    assert again.weights == pytest.approx(e.weights) and again.threshold == e.threshold
    assert all(0 <= r.ensemble_score <= 1 for r in again.score(df).data.collect())
    with pytest.raises(ValueError):
        t.ScoreEnsemble(["a", "b"], [1.0])


def test_long_text_and_graph(spark):
    texts = [(1, 0, "The cat sat. The dog ran."), (1, 1, "The cat sat. A bird flew."), (1, 2, "The dog ran. The cat sat.")]
    responses = spark.createDataFrame(texts, "prompt_id long, sample_idx int, text string")
    word = lambda pairs: B.overlap_nli(pairs, B.words)
    for mode in ("unit_response", "matched_unit"):
        r = t.LongTextScorer(word, mode, ["entailment"], refine_by="entailment", threshold=0.9).score(responses).data.first()
        assert 0 < r.entailment <= 1 and len(r.claims_data) == 2
    r = t.LongTextGraph(word).score(responses).data.first()
    assert 0 <= r.degree <= 1 and len(r.claims_data) == 3 and [c.original_response for c in r.claims_data] == [True, True, False]
    with pytest.raises(ValueError):
        t.LongTextScorer(word, "unit_response", ["cosine_sim"])


def test_code_scores(spark, responses):
    same = lambda pairs: pairs.selectExpr("a", "b", "'not equivalent' AS raw_text")
    got = {r.prompt_id: r for r in t.CodeScorer(["functional_equivalence_rate", "functional_sets_confidence", "codebleu"], same).score(responses).data.collect()}
    assert got[2].functional_equivalence_rate == 1.0 and got[1].functional_equivalence_rate == 0.5 and got[2].codebleu == pytest.approx(1.0)


def test_question_answers(spark):
    rows = [(1, c, q, s, "ab" if s < 2 else "cd") for c in range(2) for q in range(2) for s in range(3)]
    answers = spark.createDataFrame(rows, "prompt_id long, claim_idx int, question_idx int, sample_idx int, text string")
    r = t.LongTextQuestions(t.SamplingScorer(["exact_match"], return_responses="none"), "exact_match").score(answers).data.first()
    assert r.score == 0.5 and len(r.claims_data) == 2


def test_provider_settings_leave_out_secrets():
    from tests.core.test_api import Client
    from trustloom.sources import providers

    held = providers.saved_settings(Client(0.3))
    assert held["temperature"] == 0.3 and "api_key" not in held and "base_url" not in held
    assert providers.restored(held).temperature == 0.3


class Client:
    def __init__(self, temperature):
        self.temperature, self.api_key, self.base_url = temperature, "k", "http://localhost"


def test_prompt_styles(spark):
    from pyspark.sql import functions as F

    from trustloom.functions import prompts

    for style in prompts.DECOMPOSITION:
        prompts.decomposition(F.lit("x"), style)
    with pytest.raises(ValueError):
        prompts.decomposition(F.lit("x"), "nope")
    with pytest.raises(TypeError):
        prompts.decomposition(F.lit("x"), 3)
