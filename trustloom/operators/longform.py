"""Long answers: scores of their claims, what they sum to, and what is left when doubtful claims go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import text as T
from trustloom.operators.consistency import cosine, token_f1
from trustloom.operators.pairs import Nli, claims_with_claim_sets, claims_with_responses

NLI_SCORES = ("entailment", "noncontradiction", "contrasted_entailment")
MODES = {"unit_response": NLI_SCORES, "matched_unit": (*NLI_SCORES, "bert_score", "cosine_sim")}
THRESHOLD = 1 / 3


def checked(mode: str, scorers: list[str]) -> list[str]:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    bad = [s for s in scorers if s not in MODES[mode]]
    if bad:
        raise ValueError(f"{', '.join(bad)}: not scores of mode {mode}")
    return scorers


def decomposed(responses: DataFrame, split=T.sentences) -> DataFrame:
    """(prompt_id, sample_idx, claim_idx, claim)."""
    rows = responses.select("prompt_id", "sample_idx", F.posexplode(split(F.col("text"))).alias("claim_idx", "claim"))
    return rows.where(F.length("claim") > 0)


def _three(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"entailment": F.col("p_entail"), "noncontradiction": 1.0 - F.col("p_contra"), "contrasted_entailment": F.try_divide(F.col("p_entail"), F.col("p_entail") + F.col("p_contra"))})


def unit_response(claims: DataFrame, samples: DataFrame, nli: Nli) -> DataFrame:
    """(prompt_id, claim_idx, and the three scores): means over the sampled responses, which are the premises."""
    pairs = claims_with_responses(claims, samples)
    known = nli(pairs.select(T.truncated(F.col("response")).alias("premise"), F.col("claim").alias("hypothesis")).distinct())
    rows = pairs.withColumn("premise", T.truncated(F.col("response"))).join(_three(known).withColumnRenamed("hypothesis", "claim"), ["premise", "claim"])
    return rows.groupBy("prompt_id", "claim_idx").agg(*[F.avg(c).alias(c) for c in NLI_SCORES])


def unit_response_verdicts(verdicts: DataFrame) -> DataFrame:
    """The same from a judge's 0 / 1 cells (prompt_id, claim_idx, resp_idx, score): one matrix for all three scores."""
    return verdicts.groupBy("prompt_id", "claim_idx").agg(*[F.avg("score").alias(c) for c in NLI_SCORES])


def matched_unit(claims: DataFrame, sampled: DataFrame, nli: Nli) -> DataFrame:
    """Best match of a claim in each sample's claims, then the mean over samples; no match counts as 0."""
    pairs = claims_with_claim_sets(claims, sampled)
    known = nli(pairs.select(F.col("other").alias("premise"), F.col("claim").alias("hypothesis")).distinct())
    rows = pairs.join(_three(known).select(F.col("premise").alias("other"), F.col("hypothesis").alias("claim"), *NLI_SCORES), ["other", "claim"])
    best = rows.groupBy("prompt_id", "claim_idx", "sample_idx").agg(*[F.greatest(F.lit(0.0), F.max(c)).alias(c) for c in NLI_SCORES])
    return best.groupBy("prompt_id", "claim_idx").agg(*[F.avg(c).alias(c) for c in NLI_SCORES])


def matched_similarity(pairs: DataFrame, name: str) -> DataFrame:
    """The same for any similarity: pairs (prompt_id, claim_idx, sample_idx, score)."""
    best = pairs.groupBy("prompt_id", "claim_idx", "sample_idx").agg(F.greatest(F.lit(0.0), F.max("score")).alias("s"))
    return best.groupBy("prompt_id", "claim_idx").agg(F.avg("s").alias(name))


def matched_cosine(vectors: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, cosine_sim) of claims' vectors (prompt_id, sample_idx, claim_idx, vec); sample 0 is the original."""
    own = vectors.where("sample_idx = 0").select("prompt_id", "claim_idx", F.col("vec").alias("a"))
    others = vectors.where("sample_idx > 0").select("prompt_id", "sample_idx", F.col("vec").alias("b"))
    pairs = own.join(others, "prompt_id").select("prompt_id", "claim_idx", "sample_idx", (0.5 + cosine(F.col("a"), F.col("b")) / 2.0).alias("score"))
    return matched_similarity(pairs, "cosine_sim")


def matched_tokens(vectors: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, bert_score) of claims' token vectors (prompt_id, sample_idx, claim_idx, token_idx, vec)."""
    own = vectors.where("sample_idx = 0").select("prompt_id", "claim_idx", F.col("token_idx").alias("i"), F.col("vec").alias("a"))
    others = vectors.where("sample_idx > 0").select("prompt_id", "sample_idx", F.col("claim_idx").alias("other_idx"), F.col("token_idx").alias("j"), F.col("vec").alias("b"))
    return matched_similarity(token_f1(own.join(others, "prompt_id"), ["prompt_id", "claim_idx", "sample_idx", "other_idx"]), "bert_score")


def _total(how: str):
    if how not in ("mean", "min"):
        raise ValueError("aggregation must be mean or min")
    return F.avg if how == "mean" else F.min


def response_scores(claim_scores: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    f = _total(how)
    return claim_scores.groupBy("prompt_id").agg(*[f(c).alias(c) for c in columns])


def marked(claim_scores: DataFrame, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """Adds removed: whether a claim's score is not over the threshold."""
    return claim_scores.withColumn("removed", ~(F.col(column) > threshold))


def refined(rows: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    """(prompt_id, refined_<score>) over the claims that stay; null if none does."""
    f = _total(how)
    return rows.groupBy("prompt_id").agg(*[f(F.when(~F.col("removed"), F.col(c))).alias(f"refined_{c}") for c in columns])


def rebuilt(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """(prompt_id, refined_response): the kept claims in order, or the original text if none is kept."""
    kept = rows.where("NOT removed").groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("claim_idx", "claim"))).alias("c"))
    text = F.concat_ws(" ", F.transform("c", lambda x: x["claim"]))
    return originals.join(kept, "prompt_id", "left").select("prompt_id", F.when(F.col("c").isNotNull(), text).otherwise(F.col("text")).alias("refined_response"))


def claims_data(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(prompt_id, claims_data): one struct a claim, in order."""
    of = F.struct("claim_idx", "claim", "removed", *columns)
    return rows.groupBy("prompt_id").agg(F.array_sort(F.collect_list(of)).alias("claims_data"))


def merged_claims(claims: DataFrame) -> DataFrame:
    """(prompt_id, claim_idx, claim, first_sample): each distinct claim once, in order of first occurrence over samples."""
    from pyspark.sql import Window

    first = claims.groupBy("prompt_id", "claim").agg(F.min(F.struct("sample_idx", "claim_idx")).alias("at"))
    n = F.row_number().over(Window.partitionBy("prompt_id").orderBy("at")) - 1
    return first.select("prompt_id", n.alias("claim_idx"), "claim", F.col("at.sample_idx").alias("first_sample"))


def question_scores(answers: DataFrame, how: str = "mean") -> tuple[DataFrame, DataFrame]:
    """From (prompt_id, claim_idx, question_idx, score): claim scores (mean over questions), and the response's."""
    claims = answers.groupBy("prompt_id", "claim_idx").agg(F.avg("score").alias("score"))
    return claims, response_scores(claims, ["score"], how)


def question_prompt(claim: Column, several: int = 1, context: Column | None = None) -> Column:
    ask = "Write a question" if several == 1 else f"Write {several} questions, each after ###,"
    out = F.concat(F.lit(f"{ask} whose answer is stated by: "), claim)
    return F.concat(F.lit("In the context of: "), context, F.lit("\n"), out) if context is not None else out
