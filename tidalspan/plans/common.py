"""What the registered queries share: tables, the events as series, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalspan.operators.series import ToTimeSeries

#: Microseconds of the events' first day, which series count their seconds from.
EPOCH = 1704067200000000

EVENTS = f"e AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - {EPOCH}) / 1e6 AS t FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ((F.unix_micros("ts") - EPOCH) / 1e6).alias("t")
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "value", t)


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, value: a series of each user's events."""
    return ToTimeSeries({"value": "t"}, keys="user_id").apply(events(spark, sf_dir))


def rounded(c: str | Column, places: int = 6) -> Column:
    return F.round(c, places)


def flat(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, t, v of the samples of a series column."""
    return df.select(*keys, F.explode(column).alias("x")).select(*keys, F.col("x.time").alias("t"), rounded(F.col("x.value")).alias("v"))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local session may lack one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints/tidalspan"
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
