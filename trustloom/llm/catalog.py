"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trustloom.llm import byte_bpe, chat_format, decontaminate, i_match, lang_id, line_dedup, near_dup, repeats, secrets, token_files
from trustloom.llm._shared import documents


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat_format.with_verdicts(chat_format.read_back(chat_format.format_turns(rows)), rows)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, sf_dir)))


def op3_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i_match.compare_edited(documents(spark, sf_dir))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.tokens_on_file(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict(documents(spark, sf_dir))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir), length=400, digest=True, shared_words=51)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), digest=True)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_secrets": op2_secrets,
    "op3_i_match": op3_i_match,
    "op4_near_dup": op4_near_dup,
    "op5_token_files": op5_token_files,
    "op6_lang_id": op6_lang_id,
    "op7_repeats": op7_repeats,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat_format.SQL,
    "op4_near_dup": near_dup.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
