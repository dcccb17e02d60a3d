"""Kernels of a capture and symbols are made by many tasks however few bytes the parts' file takes, and are never dealt by device."""

import pytest
from pyspark.sql import functions as F

from lanespan.plans.catalogue import QUERIES
from lanespan.plans.q_names import symbols
from lanespan.plans.q_phases import capture


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("parts")
    k = F.col("id")
    spark.range(60_000).select(k.alias("p_partkey"), F.concat(F.lit("name "), k % 50).alias("p_name"), (k % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(str(path / "part.parquet"))
    return str(path)


def test_one_file_is_dealt_to_tasks(spark, parts):
    assert capture(spark, parts).rdd.getNumPartitions() == 3 and symbols(spark, parts).rdd.getNumPartitions() == 3
    assert capture(spark, parts).select("device", "step").distinct().count() == 60_000


@pytest.mark.parametrize("name, keys, least", [("forward_pipeline", "[device#", 2), ("eager_drafts", "[device#", 2)])
def test_tables_of_devices_are_sent_to_the_kernels(spark, parts, name, keys, least):
    plan = QUERIES[name](spark, parts)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count(f"BroadcastHashJoin {keys}") >= least and "collect_list(s" not in plan


def test_second_of_three_launches(spark):
    """Where more than two forwards are asked for, the second start counts, not the last."""
    from lanespan.operators.phases import eager_drafts

    rows = [(0, t, 0, 100, name, s) for t in range(3) for name in ("x", "y") for s in (10, 60 + (name == "y"), 90)]
    got = eager_drafts(spark.createDataFrame(rows, "device int, step int, a long, b long, name string, s long"), forwards=3).collect()
    assert sorted((r.step, r.draft_start, r.agreeing, round(r.offset, 6)) for r in got) == [(t, 60, 2, 0.605) for t in range(3)]
