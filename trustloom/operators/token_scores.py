"""Scores from token log-probabilities.

tokens: (prompt_id, sample_idx, token_idx, logprob, top array<double>), where
top holds the log-probabilities of a position's likeliest tokens.  A response
with a missing log-probability has null scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_K = 15


def sequence_scores(tokens: DataFrame, normalize: bool = True) -> DataFrame:
    """(prompt_id, sample_idx, sequence_probability, min_probability) of every response."""
    whole = F.count("*") == F.count("logprob")
    total = F.avg("logprob") if normalize else F.sum("logprob")
    return tokens.groupBy("prompt_id", "sample_idx").agg(F.when(whole, F.exp(total)).alias("sequence_probability"), F.when(whole, F.exp(F.min("logprob"))).alias("min_probability"))


def single_scores(tokens: DataFrame, normalize: bool = True) -> DataFrame:
    """Those of the original responses."""
    return sequence_scores(tokens.where("sample_idx = 0"), normalize).drop("sample_idx")


def token_entropy(top: Column) -> Column:
    """Entropy of the top probabilities, made to sum to one."""
    p = F.transform(top, F.exp)
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return -F.aggregate(F.transform(p, lambda x: x / total), F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def text_entropy(texts: DataFrame) -> DataFrame:
    """(prompt_id, entropy) of (prompt_id, text, logprob): equal texts are merged before."""
    merged = texts.groupBy("prompt_id", "text").agg(F.sum(F.exp("logprob")).alias("p"))
    sums = merged.groupBy("prompt_id").agg(F.sum("p").alias("t"))
    share = F.col("p") / F.col("t")
    return merged.join(sums, "prompt_id").groupBy("prompt_id").agg(F.abs(F.sum(share * F.ln(share))).alias("entropy"))


def negentropies(tokens: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Adds negentropy: 1 - H / ln k where a position has exactly k entries, else null."""
    return tokens.withColumn("negentropy", F.when(F.size("top") == top_k, 1.0 - token_entropy(F.col("top")) / F.ln(F.lit(float(top_k)))))


def margin(top: Column) -> Column:
    ranked = F.sort_array(top, False)
    return F.when(F.size(top) >= 2, F.exp(F.get(ranked, F.lit(0))) - F.exp(F.get(ranked, F.lit(1))))


def top_scores(tokens: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(prompt_id, mean_token_negentropy, min_token_negentropy, probability_margin) of the originals."""
    rows = negentropies(tokens.where("sample_idx = 0"), top_k)
    return rows.groupBy("prompt_id").agg(F.avg("negentropy").alias("mean_token_negentropy"), F.min("negentropy").alias("min_token_negentropy"), F.avg(margin(F.col("top"))).alias("probability_margin"))


def monte_carlo(tokens: DataFrame) -> DataFrame:
    """(prompt_id, monte_carlo_probability): mean sequence probability of original and samples; null if any is."""
    by = sequence_scores(tokens)
    return by.groupBy("prompt_id").agg(F.when(F.count("*") == F.count("sequence_probability"), F.avg("sequence_probability")).alias("monte_carlo_probability"))


def consistency_and_confidence(similarity: DataFrame, tokens: DataFrame, column: str = "cosine_sim") -> DataFrame:
    """(prompt_id, consistency_and_confidence): similarity to the samples times sequence probability."""
    return similarity.join(single_scores(tokens), "prompt_id").select("prompt_id", (F.col(column) * F.col("sequence_probability")).alias("consistency_and_confidence"))


def p_true_options(responses: DataFrame) -> DataFrame:
    """(prompt_id, options): the distinct answers that a P(True) prompt lists; none if all agree."""
    rows = responses.groupBy("prompt_id").agg(F.array_sort(F.collect_set("text")).alias("o"))
    return rows.select("prompt_id", F.when(F.size("o") > 1, F.array_join("o", " | ")).otherwise("").alias("options"))
