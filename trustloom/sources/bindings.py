"""Canonical inputs of the scorers, derived from the star-schema tables.

The tables hold no model outputs, so each input is a fixed function of what
they hold: order lines stand for responses and tokens, vectors for embeddings,
assistant turns for long answers, quality labels for grades, events for judges'
verdicts.  ``overlap_nli`` is a lexical stand-in for an entailment model; the
scorers only see its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str, m: int = SAMPLES) -> DataFrame:
    """(prompt_id, sample_idx, text): orders with m + 1 lines; sample 0 is the original response."""
    w = Window.partitionBy("l_orderkey")
    order = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("n"), F.count("*").over(w).alias("c"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return rows.where(F.col("c") == m + 1).select(F.col("l_orderkey").alias("prompt_id"), (F.col("n") - 1).alias("sample_idx"), "text")


def tokens(spark: SparkSession, sf_dir: str, m: int = SAMPLES) -> DataFrame:
    """(prompt_id, sample_idx, token_idx, logprob, top array<double>): three tokens for each response of R1, from its line's rates."""
    w = Window.partitionBy("l_orderkey")
    order = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(order) - 1).alias("sample_idx"), F.count("*").over(w).alias("c"), "l_discount", "l_tax", "l_quantity").where(F.col("c") == m + 1)
    share = F.array(1.0 - F.col("l_discount"), 1.0 - F.col("l_tax"), F.col("l_quantity") / 51.0)
    picked = rows.select(F.col("l_orderkey").alias("prompt_id"), "sample_idx", "l_discount", "l_tax", F.posexplode(share).alias("token_idx", "p"))
    top = F.array(F.ln("p"), F.ln(F.col("l_discount") / 4.0 + 0.01), F.ln(F.col("l_tax") / 4.0 + 0.02))
    return picked.select("prompt_id", "sample_idx", "token_idx", F.ln("p").alias("logprob"), top.alias("top"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, sample_idx, vec): vectors of a label; the smallest vec_id is the original's."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("prompt_id"), (F.row_number().over(w) - 1).alias("sample_idx"), F.col("embedding").cast("array<double>").alias("vec"))


def long_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, sample_idx, text): a conversation's assistant turns, where there are two or more."""
    w = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = rows.select(F.col("conv_id").alias("prompt_id"), (F.row_number().over(w.orderBy("turn")) - 1).alias("sample_idx"), "text", F.count("*").over(w).alias("c"))
    return rows.where("c >= 2").drop("c")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, correct, and four component scores in [0, 1], the last one missing for some)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("prompt_id"), F.col("quality").alias("correct"),
        ((n % 97) / 96.0).alias("s1"), ((n % 53) / 52.0).alias("s2"), ((F.col("doc_id") % 31) / 30.0).alias("s3"),
        F.when(F.col("doc_id") % 5 != 0, (n % 11) / 10.0).alias("s4"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, judge_id, raw_text): events as what judges wrote, five judges' words a prompt."""
    said = F.when(F.col("event_type") == "click", F.lit("Correct.")).when(F.col("event_type") == "view", F.lit("The answer is incorrect")).when(F.col("event_type") == "purchase", F.lit(" I am NOT SURE ")).when(F.col("event_type") == "signup", F.concat(F.lit("Score: "), F.col("event_id") % 120)).otherwise(F.concat((F.col("event_id") % 7).cast("string"), F.lit(" of it")))
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).cast("long").alias("prompt_id"), (F.col("event_id") % 5).cast("int").alias("judge_id"), said.alias("raw_text"))


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda x: x != ""))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != ""))


def overlap_nli(pairs: DataFrame, split) -> DataFrame:
    """Adds p_contra, p_neutral, p_entail to (premise, hypothesis): the stand-in for a model.

    The share of the hypothesis's tokens that the premise has, by its root, is
    entailment; what is left is three parts contradiction to two parts neutral.
    """
    a, b = split(F.col("premise")), split(F.col("hypothesis"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(b).cast("double")), F.lit(0.0))
    rows = pairs.withColumn("p_entail", F.sqrt(share))
    return rows.withColumn("p_contra", (1.0 - F.col("p_entail")) * 0.6).withColumn("p_neutral", (1.0 - F.col("p_entail")) * 0.4)
