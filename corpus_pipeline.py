"""Cleans the documents table in stages, each written as Parquet and read again by the next.

All stages but the last return the columns that they get.  Languages are
learned from the labelled documents that the stage is given; a stage's
statistics and candidates cover all of its input.

A row is known by its doc_id and its text, so rows without a doc_id go like any
other where they are near copies or leaks, and of rows that share one only
those go that are.  Rows equal in both are one document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm import byte_bpe, decontaminate, lang_id, line_dedup, near_dup
from trustloom.llm._shared import written

#: Rows that a Python step gets at once.  Whole texts travel: by Spark's 10,000 rows a batch has tens of megabytes, held by both sides.
BATCH_ROWS = 1000

#: A document goes if no learned language reaches this mean probability.
LEAST_SCORE = 0.3


def _small_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_ROWS rows, or of fewer where the session says so; the rows stay the same."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name) or 0) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _named(docs: DataFrame) -> DataFrame:
    """Columns with a prefix of their own, so that none clashes with an operator's."""
    return docs.toDF(*[f"in_{c}" for c in docs.columns])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"in_{c}").cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go."""
    _small_batches(spark)
    model = lang_id.train(docs)
    rows = _named(docs)
    found = lang_id.identify(rows, model, "in_doc_id", "in_text", tuple(c for c in rows.columns if c != "in_doc_id"))
    return _back(found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that a document with a smaller id keeps; n_chars follows the text."""
    _small_batches(spark)
    rows = _named(docs)
    found = line_dedup.dedup_lines(rows, "in_doc_id", "in_text", keep=tuple(c for c in rows.columns if c not in ("in_doc_id", "in_text")))
    found = found.withColumn("in_text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        found = found.withColumn("in_n_chars", F.length("in_text"))
    return _back(found, docs)


def _row():
    """A row's name, of its doc_id and text."""
    return F.xxhash64("doc_id", "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs but those in gone (id, row)."""
    gone = gone.toDF("__id", "__row").distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (_row() == F.col("__row")), "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (rows without an id: after all others)."""
    _small_batches(spark)
    rows = docs.select("doc_id", "text").withColumn("__row", _row())
    found = near_dup.near_duplicates(rows, width=5, percent=80, id_col="__row")
    # groups of one row have nothing to lose
    groups = written(found.where("NOT kept").select("component_id", "__row").distinct(), "near-copies")
    members = groups.union(groups.select("component_id", F.col("component_id"))).distinct()
    named = members.join(rows.select("doc_id", "__row").distinct(), "__row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
    gone = named.join(first, "component_id").where("NOT (doc_id <=> first.doc_id AND __row = first.__row)")
    return _without(docs, gone.select("doc_id", "__row"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a run of a benchmark item go."""
    _small_batches(spark)
    rows = docs.select("doc_id", "text").withColumn("__row", _row())
    found = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row_col="__row")
    return _without(docs, found.select("doc_id", "__row"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of what is left."""
    import public_tokenizers

    _small_batches(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]

#: SQL can't express identification by a trained network; the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
