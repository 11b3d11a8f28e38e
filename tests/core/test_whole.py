"""Queries do the whole job: against brute force where the SQL is cut short."""

import re

import pytest

from trustloom.plans.catalog import QUERIES

#: Nine sentences, with an abbreviation and a decimal that end none.
LONG = "Dr. Green came first. The cat sat. The dog ran 2.5 miles. A bird flew. Rain fell. Snow fell. Night came. The owl woke. It was late."
TURNS = [(1, 0, "user", "Tell me"), (1, 1, "assistant", LONG), (1, 2, "assistant", "Night came. The owl woke. The cat sat. The dog slept. One. Two. Three. The moon rose."), (2, 0, "assistant", "Alone here.")]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("turns")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(str(d / "conversations.parquet"))
    return str(d)


def claims(text):
    """Sentences of TURNS by Python's own expressions."""
    return [x.replace("Dr@", "Dr.") for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text.replace("Dr.", "Dr@"))]


def share(premise, hypothesis):
    a, b = ({w for w in re.split("[^a-z]+", x.lower()) if w} for x in (premise, hypothesis))
    return (len(a & b) / len(b)) ** 0.5


def test_all_sentences_are_claims(spark, turns):
    got = {(r.sample_idx, r.claim_idx): r.claim for r in QUERIES["decomposed_responses"](spark, turns).collect()}
    assert got == {(s, k): c for s in (0, 1) for k, c in enumerate(claims(TURNS[s + 1][3]))} and len(got) == 17


def test_all_claims_are_scored(spark, turns):
    original, sampled = claims(TURNS[1][3]), claims(TURNS[2][3])
    unit = {r.claim_idx: r.entailment for r in QUERIES["unit_response"](spark, turns).collect()}
    assert unit == pytest.approx({k: share(TURNS[2][3], c) for k, c in enumerate(original)}, abs=1e-6)
    matched = {r.claim_idx: r.entailment for r in QUERIES["matched_unit"](spark, turns).collect()}
    assert matched == pytest.approx({k: max(share(o, c) for o in sampled) for k, c in enumerate(original)}, abs=1e-6)
    kept = [c for k, c in enumerate(original) if unit[k] > 0.42]
    assert QUERIES["refined_responses"](spark, turns).first().refined_response == " ".join(kept) and kept[-1] == original[7]
    assert QUERIES["graph_degree"](spark, turns).count() == QUERIES["graph_iterated"](spark, turns).count() == 9


def test_all_vectors_are_tokens(spark, tmp_path):
    unit = [(1.0, 0.0), (0.0, 1.0), (0.6, 0.8), (0.8, 0.6), (-1.0, 0.0)]
    vectors = [unit[(k * k + k // 7) % 5] for k in range(61)]
    spark.createDataFrame([(k, list(v), 3) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    first, *others = [vectors[k : k + 8] for k in range(0, 61, 8)]
    scores = []
    for o in others:
        dots = [[a[0] * b[0] + a[1] * b[1] for b in o] for a in first]
        r, p = sum(map(max, dots)) / 8, sum(map(max, zip(*dots))) / len(o)
        scores.append(2 * p * r / (p + r))
    assert len(scores) == 7 and QUERIES["bert_score"](spark, str(tmp_path)).first().bert_score == pytest.approx(sum(scores) / 7, abs=1e-6)


def test_whole_claims_are_compared(spark, turns):
    original, sampled = claims(TURNS[1][3]), claims(TURNS[2][3])
    merged = [r.claim for r in QUERIES["merged_claims"](spark, turns).where("prompt_id = 1").orderBy("claim_idx").collect()]
    assert merged == original + [c for c in sampled if c not in original] and len(merged) == 14
    assert {r.claim: r.original_response for r in QUERIES["new_claims"](spark, turns).collect()} == {c: c in original for c in sampled}
