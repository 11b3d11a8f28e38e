"""Named datasets, their clean-up rules, and what is done to a loaded table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.functions import text as T

# The names of the example datasets.
NAMES = ("ai2_arc", "csqa", "gsm8k", "nq_open", "popqa", "svamp", "factscore", "hotpotqa", "simpleqa", "livecodebench", "factscore-stem-geo")


def list_datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def load(spark: SparkSession, path: str, n: int | None = None, cols: list[str] | None = None, rename: dict[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """A table (Parquet, JSON, CSV or ORC by suffix): renamed first, then cut to columns that exist, then to n rows in order."""
    kind = next((k for k in ("json", "csv", "orc") if path.rstrip("/").endswith("." + k)), "parquet")
    df = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path)
    df = df.withColumnsRenamed(rename or {})
    if cols:
        df = df.select(*[c for c in cols if c in df.columns])
    if n is not None:
        df = (df.orderBy(*order) if order else df).limit(n)
    return df


def all_splits(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: Clean-up steps by name: (column, its type, argument) -> column.
STEPS: dict[str, Callable[[Column, object, object], Column]] = {
    "digits_only": lambda c, kind, _: T.digits_only(c), "remove_spaces": lambda c, kind, _: T.without_spaces(c),
    "upper": lambda c, kind, _: T.cased(c, kind, True), "lower": lambda c, kind, _: T.cased(c, kind, False),
    "search": lambda c, kind, arg: T.search(c, *arg) if isinstance(arg, tuple) else T.search(c, arg),
}


def processed(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """Applies (step, column, argument?) in order; the column's type decides how, not its first row."""
    for name, column, *arg in steps:
        df = df.withColumn(column, STEPS[name](F.col(column), df.schema[column].dataType, arg[0] if arg else None))
    return df


def longest_by_category(df: DataFrame, category: str, text: str, key: str, most: int = 100) -> DataFrame:
    """Rows that have text; of a category with more than ``most``, the longest (ties by key)."""
    rank = F.row_number().over(Window.partitionBy(category).orderBy(F.length(text).desc(), key))
    return df.where(F.coalesce(F.length(text), F.lit(0)) > 0).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def flattened(categories: DataFrame, category: str, entities: str) -> DataFrame:
    """A row for each entity of each category, with a question about it."""
    rows = categories.select(F.col(category).alias("entity_type"), F.explode(entities).alias("entity"))
    return rows.withColumn("question", F.format_string("Tell me a bio of %s", "entity"))


def duplicated(prompts: DataFrame, count: int) -> DataFrame:
    return prompts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def batch_size(max_calls_per_min: int, count: int) -> int:
    return max(1, max_calls_per_min // count)


def batched(prompts: DataFrame, key: str, size: int) -> DataFrame:
    """Adds batch: rows in order of an integer key that counts from 0 without gaps go ``size`` to a batch."""
    return prompts.withColumn("batch", F.floor(F.col(key) / size).cast("long"))


def messages(prompt: Column, system: str = "You are a helpful assistant.") -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", prompt))


def normalized_logprobs(raw: Column) -> Column:
    """Token log-probabilities from any of three layouts of a provider's JSON; null if there are none."""
    content = F.from_json(raw, "struct<logprobs:struct<content:array<struct<token:string,logprob:double>>>>")["logprobs"]["content"]
    result = F.from_json(raw, "struct<logprobs_result:array<struct<token:string,logprob:double>>>")["logprobs_result"]
    flat = F.from_json(raw, "struct<logprobs:struct<tokens:array<string>,token_logprobs:array<double>>>")["logprobs"]
    zipped = F.zip_with(flat["tokens"], flat["token_logprobs"], lambda a, b: F.struct(a.alias("token"), b.alias("logprob")))
    return F.coalesce(content, result, zipped)


def generate(prompts: DataFrame, client: Callable[[list[str]], list[str]], count: int = 1, max_calls_per_min: int | None = None) -> DataFrame:
    """(prompt_id, sample_idx, text): a client called by batch from each task; the rate limit is shared out over tasks."""
    tasks = prompts.rdd.getNumPartitions() if max_calls_per_min else 1

    def run(frames):
        import time

        import pandas as pd

        size = batch_size(max(1, max_calls_per_min // tasks), 1) if max_calls_per_min else None
        for frame in frames:
            for k in range(0, len(frame), size or max(1, len(frame))):
                began, part = time.time(), frame.iloc[k : k + size] if size else frame
                yield pd.DataFrame({"prompt_id": part["prompt_id"], "sample_idx": part["sample_idx"], "text": client(part["prompt"].tolist())})
                if size and k + size < len(frame):
                    time.sleep(max(0.0, 61 - (time.time() - began)))

    rows = prompts.select("prompt_id", "prompt", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("sample_idx"))
    return rows.mapInPandas(run, "prompt_id long, sample_idx int, text string")


def regrouped_samples(responses: DataFrame) -> DataFrame:
    """(prompt_id, response, sampled_responses) in order of sample."""
    rows = responses.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "text"))).alias("r"))
    texts = F.transform("r", lambda x: x["text"])
    return rows.select("prompt_id", F.get(texts, F.lit(0)).alias("response"), F.slice(texts, 2, 1_000_000).alias("sampled_responses"))


#: Names that keep their last letter.
PLURALS = ("sampled_responses", "raw_sampled_responses", "claims", "sentences")


def singular(df: DataFrame) -> DataFrame:
    """Column names without their final s, as result tables have them; prompt first."""
    df = df.withColumnsRenamed({c: c[:-1] for c in df.columns if c.endswith("s") and c not in PLURALS})
    first = [c for c in ("prompt", "prompt_id") if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])
