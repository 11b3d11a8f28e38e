"""A stream run to its end over the events table: an extension beside the batch scorers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trustloom.plans.registry import query
from trustloom.streaming import running


@query("stream_windows", "extension: watermarked windows over a stream", """WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2)
SELECT start::VARCHAR AS start, event_type, n, mean_value FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_windows(spark, d):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    place = (shared or "file:///tmp/trustloom-shared").rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a stream reads folders: the one file of the table is picked by its name
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    running.to_table(running.windowed_agreement(events), f"{place}/rows", f"{place}/state").awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n long, mean_value double").parquet(f"{place}/rows")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
