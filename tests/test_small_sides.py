"""Totals of modules are sent to the rows, and a stream over many small files takes them together."""

from pyspark.sql import functions as F

from lanespan.operators import rollups as R
from lanespan.streaming import stateful as T


def test_rows_of_a_large_module_are_not_shuffled_to_meet_its_total(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("module"), F.col("id").alias("cents"))
    x = R.module_shares(rows, "module", "cents")
    assert "strategy=broadcast" in x._jdf.queryExecution().logical().toString()
    assert x.count() == 1000


def test_small_files_of_units_are_one_batch(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 40).alias("lane"), F.col("id").alias("s"), "id", F.lit("k").alias("name"), (F.col("id") + 1).alias("e"), (F.expr("id div 40") % 2 == 0).alias("marks"), F.expr("cast(id div 134 as int)").alias("batch"))
    seen, latest = [], T.latest
    monkeypatch.setattr(T, "latest", lambda versions, keys: seen.append(versions.select("batch").distinct().count()) or latest(versions, keys))
    assert T.accepted(T.arrivals(rows, "batch", 3)).agg(F.sum("n")).first()[0] == 320
    assert seen == [1]
