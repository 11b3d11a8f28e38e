"""Scores from how far samples agree with the original response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.operators.pairs import Nli, original_with_samples, with_nli


def exact_match(responses: DataFrame) -> DataFrame:
    """(prompt_id, exact_match): share of samples equal to the original."""
    return original_with_samples(responses).groupBy("prompt_id").agg(F.avg((F.col("original") == F.col("sample")).cast("double")).alias("exact_match"))


def consistency(responses: DataFrame, nli: Nli) -> DataFrame:
    """(prompt_id, noncontradiction, entailment): means over samples of both directions' mean."""
    return of_pairs(with_nli(original_with_samples(responses), "original", "sample", nli))


def of_pairs(rows: DataFrame) -> DataFrame:
    """The same of pairs with their probabilities; only those with the original are read."""
    return rows.groupBy("prompt_id").agg(
        F.avg(((1.0 - F.col("contra_ab")) + (1.0 - F.col("contra_ba"))) / 2.0).alias("noncontradiction"),
        F.avg((F.col("entail_ab") + F.col("entail_ba")) / 2.0).alias("entailment"),
    )


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """Cosine of two array<double> columns; null if either has no length."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def cosine_pairs(embeddings: DataFrame) -> DataFrame:
    """(prompt_id, sample_idx, score): (1 + cosine) / 2 of the original with each sample."""
    first = embeddings.where("sample_idx = 0").select("prompt_id", F.col("vec").alias("a"))
    rest = embeddings.where("sample_idx > 0").select("prompt_id", "sample_idx", F.col("vec").alias("b"))
    return first.join(rest, "prompt_id").select("prompt_id", "sample_idx", (0.5 + cosine(F.col("a"), F.col("b")) / 2.0).alias("score"))


def cosine_sim(embeddings: DataFrame) -> DataFrame:
    return cosine_pairs(embeddings).groupBy("prompt_id").agg(F.avg("score").alias("cosine_sim"))


def bert_score(token_vectors: DataFrame) -> DataFrame:
    """(prompt_id, bert_score): mean over samples of the F1 of greedy matching of token vectors.

    token_vectors: (prompt_id, sample_idx, token_idx, vec) of unit vectors.
    """
    a = token_vectors.where("sample_idx = 0").select("prompt_id", F.col("token_idx").alias("i"), F.col("vec").alias("a"))
    b = token_vectors.where("sample_idx > 0").select("prompt_id", "sample_idx", F.col("token_idx").alias("j"), F.col("vec").alias("b"))
    return token_f1(a.join(b, "prompt_id"), ["prompt_id", "sample_idx"]).groupBy("prompt_id").agg(F.avg("score").alias("bert_score"))


def token_f1(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., score): F1 of greedy matching of the token vectors a (by i) and b (by j) of each pair of texts."""
    cells = pairs.select(*keys, "i", "j", _dot(F.col("a"), F.col("b")).alias("c"))
    recall = cells.groupBy(*keys, "i").agg(F.max("c").alias("c")).groupBy(*keys).agg(F.avg("c").alias("r"))
    precision = cells.groupBy(*keys, "j").agg(F.max("c").alias("c")).groupBy(*keys).agg(F.avg("c").alias("p"))
    f1 = F.try_divide(2.0 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return recall.join(precision, keys).select(*keys, f1.alias("score"))
