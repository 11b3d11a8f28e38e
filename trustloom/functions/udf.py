"""Functions of our own by name in SQL: a scalar, an aggregate, a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf("string")
def code_text(raw: pd.Series) -> pd.Series:
    """What stands in for a user's postprocessor: the text without white space at its ends."""
    return raw.str.strip()


@F.pandas_udf(DoubleType())
def root_mean_square(x: pd.Series) -> float:
    return float((x * x).mean() ** 0.5)


@F.udtf(returnType="idx int, sentence string")
class SplitSentences:
    def eval(self, text: str):
        for k, part in enumerate((text or "").split(". ")):
            yield k, part


def register(spark: SparkSession) -> None:
    spark.udf.register("postprocess", code_text)
    spark.udf.register("root_mean_square", root_mean_square)
    spark.udtf.register("split_sentences", SplitSentences)
