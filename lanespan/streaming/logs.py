"""Logs as tables of lines (log, offset, size, text): pages by cursor, appends within a bound, and how long nothing came.

The functions are plans over batch frames; within a stream they run in foreachBatch, as the state of a log is its offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def page(lines: DataFrame, cursors: DataFrame, most: int) -> DataFrame:
    """log, cursor, reset, offset, text: the lines from each log's cursor on, no more than `most` bytes of them but one at least.

    cursors: log, cursor. A log that ends before its cursor has shrunk, and is read from its beginning again (reset).
    """
    end = lines.groupBy("log").agg(F.max(F.col("offset") + F.col("size")).alias("end"))
    at = cursors.join(end, "log", "left").withColumn("reset", F.coalesce(F.col("end"), F.lit(0)) < F.col("cursor")).withColumn("cursor", F.when(F.col("reset"), F.lit(0)).otherwise(F.col("cursor")))
    rows = lines.join(at.select("log", "cursor", "reset"), "log").where(F.col("offset") >= F.col("cursor"))
    first = rows.groupBy("log").agg(F.min("offset").alias("first"))
    fits = (F.col("offset") == F.col("first")) | (F.col("offset") + F.col("size") <= F.col("cursor") + most)
    return rows.join(first, "log").where(fits).select("log", "cursor", "reset", "offset", "text")


def bounded(lines: DataFrame, most: int, marker: str = "[log is full]") -> DataFrame:
    """log, ord, text: lines of each log (log, ord, text) while they fit into most bytes; the first that does not becomes the marker, and none come after it."""
    size = F.octet_length("text") + 1
    upto = F.sum(size).over(Window.partitionBy("log").orderBy("ord"))
    x = lines.withColumn("__end", upto).withColumn("__begin", upto - size)
    return x.where(F.col("__begin") < most).select("log", "ord", F.when(F.col("__end") > most, F.lit(marker)).otherwise(F.col("text")).alias("text"))


def idle(events: DataFrame, keys: list[str], at: str, now: Column, timeout: int) -> DataFrame:
    """keys, last, idle, stalled: time since the last event, and whether it is beyond the timeout."""
    return events.groupBy(*keys).agg(F.max(at).alias("last")).withColumn("idle", now - F.col("last")).withColumn("stalled", F.col("idle") > timeout)


def accepted_units(rows: DataFrame, keys: list[str], unit: str, order: list[str], name: str, least: int = 3) -> DataFrame:
    """keys, units, accepted, enough: units whose names are those of the commonest sequence in their lane, of equally common ones the longest, then the smallest."""
    seq = rows.groupBy(*keys, unit).agg(F.sha2(F.concat_ws("\x1f", F.transform(F.sort_array(F.collect_list(F.struct(*order, name))), lambda x: x[name])), 256).alias("seq"), F.count(F.lit(1)).alias("n"))
    best = seq.groupBy(*keys, "seq", "n").agg(F.count(F.lit(1)).alias("units")).groupBy(*keys).agg(F.sum("units").alias("units"), F.max("units").alias("accepted"))
    return best.withColumn("enough", F.col("accepted") >= least)
