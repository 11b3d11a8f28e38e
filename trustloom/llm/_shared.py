"""Places and helpers that operators share: the folder all executors see, written steps, id buckets."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    """A folder of this process, for local sessions only; it goes when the process ends."""
    place = tempfile.mkdtemp(prefix="trustloom-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    return place


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests), one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + _own_folder()
    return place.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_buckets(df: DataFrame, key: str, n: int) -> list:
    """At most n - 1 ascending cut points that deal the ids evenly; reads the id column only, returns n numbers."""
    if n < 2:
        return []
    cuts = df.select(key).approxQuantile(key, [k / n for k in range(1, n)], 0.2 / n)
    return sorted({int(x) for x in cuts})


def bucket_of(key: str, cuts: list):
    """Number of cut points that are <= the id (nulls: -1), by binary search over literals."""
    def pick(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(key) < F.lit(cuts[mid]), pick(low, mid)).otherwise(pick(mid + 1, high))

    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(pick(0, len(cuts))).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
