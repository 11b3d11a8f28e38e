"""Judges: prompts, panels of several, repeated asking, and graders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import verdicts

TEMPLATES: dict[str, Callable[[Column], Column]] = {"true_false_uncertain": verdicts.ternary, "true_false": verdicts.binary, "continuous": verdicts.continuous, "likert": verdicts.likert}

#: What a judge is asked for, by template; with the explanation it also says why.
INSTRUCTIONS = {
    "true_false_uncertain": "Say whether the proposed answer is right. Reply with one word: Correct, Incorrect or Uncertain.",
    "true_false": "Say whether the proposed answer is right. Reply with one word: Correct or Incorrect.",
    "continuous": "Say how likely the proposed answer is right. Reply with a whole number from 0 to 100.",
    "likert": "Rate the proposed answer from 1 (completely incorrect) to 5 (completely correct). Reply with the number only.",
}
EXPLAINED = " Write the reply after 'Score:' and your reasons after 'Explanation:'."


def instruction(template: str, explain: bool = False) -> str:
    if template not in INSTRUCTIONS:
        raise ValueError(f"template must be one of {', '.join(INSTRUCTIONS)}")
    return INSTRUCTIONS[template] + (EXPLAINED if explain else "")


def judge_prompt(question: Column, answer: Column, template: str = "true_false_uncertain", explain: bool = False) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit(", Proposed Answer: "), answer, F.lit(". "), F.lit(instruction(template, explain)))


def scored(raw: DataFrame, template: str = "true_false_uncertain", explain: bool = False) -> DataFrame:
    """Adds score, and explanation if asked for, to (prompt_id, judge_id, raw_text)."""
    read = TEMPLATES[template]
    if not explain:
        return raw.withColumn("score", read(F.col("raw_text")))
    parts = verdicts.structured(F.col("raw_text"))
    return raw.withColumn("score", read(parts["answer"])).withColumn("explanation", F.when(F.col("raw_text").isNotNull(), parts["explanation"]))


def panel(scores: DataFrame, judges: list) -> DataFrame:
    """judge_1.. and their avg, max, min, median by prompt; a missing score makes the four null."""
    wide = scores.groupBy("prompt_id").pivot("judge_id", judges).agg(F.first("score"))
    wide = wide.toDF("prompt_id", *[f"judge_{k + 1}" for k in range(len(judges))])
    whole = F.count("*") == F.count("score")
    four = scores.groupBy("prompt_id").agg(*[F.when(whole, f("score")).alias(name) for name, f in (("avg", F.avg), ("max", F.max), ("min", F.min), ("median", F.median))])
    return wide.join(four, "prompt_id")


def first_readable(attempts: DataFrame, parse: Callable[[Column], Column], rounds: int = 6) -> DataFrame:
    """(prompt_id, score, attempt) of the first of at most ``rounds`` replies that can be read; null if none."""
    rows = attempts.where(F.col("attempt") < rounds).withColumn("score", parse(F.col("raw_text")))
    ok = F.when(F.col("score").isNotNull(), F.struct("attempt", "score"))
    return rows.groupBy("prompt_id").agg(F.min(ok).alias("b")).select("prompt_id", F.col("b.score").alias("score"), F.col("b.attempt").alias("attempt"))


def ask_until_read(prompts: DataFrame, provider: Callable[[DataFrame, int], DataFrame], parse: Callable[[Column], Column], retries: int = 5) -> DataFrame:
    """Asks a provider (prompts, round) -> (prompt_id, raw_text) again for what couldn't be read, ``retries`` times."""
    done, left = None, prompts
    for k in range(retries + 1):
        got = provider(left, k).withColumn("score", parse(F.col("raw_text")))
        good = got.where("score IS NOT NULL") if k < retries else got
        done = good if done is None else done.union(good)
        left = left.join(got.where("score IS NULL").select("prompt_id"), "prompt_id", "left_semi")
    return done


def graded_answers(raw: DataFrame) -> DataFrame:
    """Adds grade: whether the grader said yes."""
    return raw.withColumn("grade", verdicts.says_yes(F.col("raw_text")))


def graded_claims(raw: DataFrame) -> DataFrame:
    """Adds grade and objective to (prompt_id, claim_idx, entails_text, objective_text)."""
    return raw.withColumn("grade", verdicts.says_yes(F.col("entails_text"))).withColumn("objective", verdicts.is_objective(F.col("objective_text")))
