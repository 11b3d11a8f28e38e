"""Cosine and token matching of claims in mode matched_unit."""

import math

import pytest

import trustloom as t
from trustloom.sources import bindings as B


def test_long_text_scorer_takes_vectors(spark):
    texts = [(1, 0, "The cat sat. The dog ran."), (1, 1, "The cat sat. A bird flew."), (1, 2, "The dog ran.")]
    responses = spark.createDataFrame(texts, "prompt_id long, sample_idx int, text string")
    vectors = {(0, 0): (1.0, 0.0), (0, 1): (0.0, 1.0), (1, 0): (1.0, 0.0), (1, 1): (-1.0, 0.0), (2, 0): (0.6, 0.8)}
    embeddings = spark.createDataFrame([(1, s, c, list(v)) for (s, c), v in vectors.items()], "prompt_id long, sample_idx int, claim_idx int, vec array<double>")
    tokens = embeddings.selectExpr("prompt_id", "sample_idx", "claim_idx", "0 AS token_idx", "vec")
    cos = lambda a, b: 0.5 + sum(x * y for x, y in zip(a, b)) / (2 * math.hypot(*a) * math.hypot(*b))
    want = [sum(max(cos(vectors[0, k], v) for (s, _), v in vectors.items() if s == n) for n in (1, 2)) / 2 for k in (0, 1)]
    word = lambda pairs: B.overlap_nli(pairs, B.words)
    scorer = t.LongTextScorer(word, "matched_unit", ["cosine_sim", "bert_score", "entailment"])
    r = scorer.score(responses, embeddings=embeddings, token_vectors=tokens).data.first()
    assert r.cosine_sim == pytest.approx(sum(want) / 2) and 0 < r.entailment <= 1
    # one token a claim: F1 is the product itself, and no match counts as 0
    assert r.bert_score == pytest.approx(((1.0 + 0.6) / 2 + (0.0 + 0.8) / 2) / 2)
    with pytest.raises(ValueError):
        scorer.score(responses, embeddings=embeddings)
    only = t.LongTextScorer(None, "matched_unit", ["cosine_sim"]).score(responses, embeddings=embeddings).data.first()
    assert only.cosine_sim == pytest.approx(r.cosine_sim)
