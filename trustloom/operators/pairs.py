"""Pairs of texts that scorers compare: the joins of the engine.

Pairs are joined within a prompt only.  A provider's probabilities are looked
up by distinct pair, so a costly model is asked once for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Nli = Callable[[DataFrame], DataFrame]


def original_with_samples(responses: DataFrame) -> DataFrame:
    """(prompt_id, sample_idx, original, sample)."""
    first = responses.where("sample_idx = 0").select("prompt_id", F.col("text").alias("original"))
    rest = responses.where("sample_idx > 0").select("prompt_id", "sample_idx", F.col("text").alias("sample"))
    return first.join(rest, "prompt_id")


def ordered_pairs(responses: DataFrame) -> DataFrame:
    """(prompt_id, i, j, a, b) with i < j."""
    left = responses.select("prompt_id", F.col("sample_idx").alias("i"), F.col("text").alias("a"))
    right = responses.select(F.col("prompt_id").alias("p"), F.col("sample_idx").alias("j"), F.col("text").alias("b"))
    return left.join(right, (F.col("prompt_id") == F.col("p")) & (F.col("i") < F.col("j"))).drop("p")


def distinct_nli(pairs: DataFrame, a: str, b: str, nli: Nli) -> DataFrame:
    """Probabilities of each distinct (premise, hypothesis) of a pair, in either direction; equal texts are left out."""
    both = pairs.select(F.col(a).alias("premise"), F.col(b).alias("hypothesis")).union(pairs.select(F.col(b), F.col(a)))
    return nli(both.where("premise <> hypothesis").distinct())


def with_nli(pairs: DataFrame, a: str, b: str, nli: Nli) -> DataFrame:
    """Adds contra_ab, entail_ab, top_ab (entailment is the likeliest class), and the same for ba.

    Equal texts entail each other without being looked up.
    """
    found = distinct_nli(pairs, a, b, nli)
    rows = pairs
    for left, right, tag in ((a, b, "ab"), (b, a, "ba")):
        side = found.select(
            F.col("premise").alias("x"), F.col("hypothesis").alias("y"), F.col("p_contra").alias(f"contra_{tag}"), F.col("p_neutral").alias(f"neutral_{tag}"), F.col("p_entail").alias(f"entail_{tag}"),
            ((F.col("p_entail") > F.col("p_contra")) & (F.col("p_entail") > F.col("p_neutral"))).alias(f"top_{tag}"),
        )
        rows = rows.join(side, (F.col(left) == F.col("x")) & (F.col(right) == F.col("y")), "left").drop("x", "y")
        same = F.col(a) == F.col(b)
        rows = rows.withColumns({
            f"contra_{tag}": F.when(same, 0.0).otherwise(F.col(f"contra_{tag}")), f"neutral_{tag}": F.when(same, 0.0).otherwise(F.col(f"neutral_{tag}")),
            f"entail_{tag}": F.when(same, 1.0).otherwise(F.col(f"entail_{tag}")), f"top_{tag}": same | F.coalesce(F.col(f"top_{tag}"), F.lit(False)),
        })
    return rows


def claims_with_responses(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, claim, resp_idx, response): every claim against every response of its prompt."""
    other = responses.select("prompt_id", F.col("sample_idx").alias("resp_idx"), F.col("text").alias("response"))
    return claims.select("prompt_id", "claim_idx", "claim").join(other, "prompt_id")


def claims_with_claim_sets(claims: DataFrame, samples: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, claim, sample_idx, other): every claim against every claim of each sample."""
    other = samples.select("prompt_id", "sample_idx", F.col("claim").alias("other"))
    return claims.select("prompt_id", "claim_idx", "claim").join(other, "prompt_id")


def new_claims(sampled: DataFrame, master: DataFrame) -> DataFrame:
    """Distinct sampled claims that the master set lacks."""
    return sampled.select("prompt_id", "claim").distinct().join(master.select("prompt_id", "claim"), ["prompt_id", "claim"], "left_anti")


def flag_original(master: DataFrame, original: DataFrame) -> DataFrame:
    """Adds original_response: whether the claim's text is among the original response's."""
    known = original.select("prompt_id", "claim").distinct().withColumn("original_response", F.lit(True))
    return master.join(known, ["prompt_id", "claim"], "left").withColumn("original_response", F.coalesce("original_response", F.lit(False)))


def reuse_or_compute(pairs: DataFrame, memo: DataFrame, nli: Nli) -> DataFrame:
    """Probabilities of (premise, hypothesis) pairs: from the memo where it has them, from the provider for the rest only."""
    keys = ["premise", "hypothesis"]
    missing = pairs.select(*keys).distinct().join(memo, keys, "left_anti")
    made = nli(missing).select(*keys, "p_contra", "p_neutral", "p_entail", F.lit(False).alias("reused"))
    known = memo.select(*keys, "p_contra", "p_neutral", "p_entail", F.lit(True).alias("reused"))
    return pairs.join(known.union(made), keys, "left")


def as_matrix_cells(predictions: DataFrame, whole: bool = True) -> DataFrame:
    """Cells (prompt_id, claim_idx, resp_idx, score) of flat predictions; whole numbers."""
    score = F.col("score").cast("int") if whole else F.col("score")
    return predictions.select("prompt_id", "claim_idx", "resp_idx", score.alias("score"))


def regrouped(flat: DataFrame) -> DataFrame:
    """(prompt_id, grades): flat grades as one ordered list a prompt."""
    return flat.groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("claim_idx", "grade"))).alias("g")).select("prompt_id", F.transform("g", lambda x: x["grade"]).alias("grades"))
