"""Streams over events that arrive in batches: sessions and busy time of lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespan.sources.tables import intervals
from lanespan.streaming.stateful import arrivals, busy_stretches, drained, with_end

HOUR = 3_600_000_000
BATCHES = 4


def arriving(spark: SparkSession, sf_dir: str, late: int, batches: int = BATCHES) -> tuple[DataFrame, int]:
    """device, stream, id, s, e, ts, batch: the interval view as it arrives, each interval late by less than `late` microseconds, and the number of batches. The last is an end that is no interval."""
    iv = intervals(spark, sf_dir)
    at = F.col("s") + F.pmod(F.xxhash64("id"), F.lit(late))
    span = iv.agg(F.min("s").alias("lo"), (F.max("s") + late).alias("hi")).first()
    width = max(1, -(-(span.hi - span.lo) // batches)) if span.lo is not None else 1
    rows = iv.withColumn("batch", F.expr("0") if span.lo is None else ((at - span.lo) / width).cast("int"))
    return with_end(rows.select(F.col("device").alias("lane"), "s", "e", "batch"), "batch", batches, "lane")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """lane, session_start, session_end (last event plus the gap), n as a stream: sessions come, and leave the state, when the watermark is beyond their end."""
    s = stream.withWatermark("ts", late).groupBy("lane", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("lane", F.unix_micros("w.start").alias("session_start"), F.unix_micros("w.end").alias("session_end"), "n")


def session_windows(spark: SparkSession, sf_dir: str, gap: str = "6 hours", late: int = HOUR) -> DataFrame:
    """user_id, session_start, session_end, n of all sessions of the events as they arrive."""
    rows, n = arriving(spark, sf_dir, late)
    out = drained(sessions(arrivals(rows, "batch", n), gap, f"{late} microseconds"))
    return out.where("lane >= 0").withColumnRenamed("lane", "user_id")


def running_union(spark: SparkSession, sf_dir: str, late: int = HOUR) -> DataFrame:
    """lane, s, e, n, busy: the stretches in which a lane is busy, as they close; intervals that come late fill their holes."""
    rows, n = arriving(spark, sf_dir, late)
    return drained(busy_stretches(arrivals(rows, "batch", n), f"{late} microseconds"))
