"""Parquet tables by name, and the interval view over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
#: Bytes up to which a side of a join is broadcast: none by what its files take, as they are compressed and rows made of rows (a recipe's kernels, an interval's
#: nodes) are not counted; only by a size that was measured while the query ran, or where a plan says so.
STATED, MEASURED = -1, 10 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # times without a zone are read as UTC
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(STATED))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(MEASURED))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task makes many or dear ones of.
TASK_ROWS = 20_000


def spread(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """df, dealt by key to tasks of about so many rows: a file of few bytes is read by one task, however many rows its rows become."""
    n = df.count()
    return df if n <= rows else df.repartition(-(-n // rows), key)


def micros(c) -> F.Column:
    """Microseconds since 1970 of a time without a zone."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, stream, id, s, e: an event is an interval on its user's lane, as many minutes long as its value."""
    ev = load(spark, sf_dir, "events")
    s = micros("ts")
    return ev.select(F.col("user_id").alias("device"), F.col("event_type").alias("stream"), F.col("event_id").alias("id"), s.alias("s"), (s + F.round(F.col("value") * MICROS_PER_MINUTE).cast("long")).alias("e"))


#: The same view in SQL.
IV = "iv AS (SELECT user_id AS device, event_type AS stream, event_id AS id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS e FROM events)"
