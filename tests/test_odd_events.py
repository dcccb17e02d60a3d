"""Interval queries against their SQL over events that are empty, equal, or all there is in a lane, and traces written by many tasks."""

import datetime
import random

import oracle
import pytest
from pyspark.sql import functions as F

from lanespan.operators import intervals as I
from lanespan.plans import q_sources
from lanespan.plans.catalogue import ORACLE_SQL, QUERIES

NAMES = ["busy_decomposition", "closure_violations", "gap_threshold_excluding_spans", "interval_concurrency", "interval_holes", "interval_holes_clipped_window", "interval_union_per_device", "overlap_pct_per_device"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A quarter of the events has no length, a quarter begins with another of its user, and some users have one empty event only."""
    r, rows = random.Random(7), []
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=r.randrange(3 * 86_400_000_000))
    for i in range(600):
        value = 0.0 if r.random() < 0.25 else r.random() * 90
        ts = rows[r.randrange(len(rows))][1] if rows and r.random() < 0.25 else at()
        rows.append((i, ts, i % 12, r.choice(["click", "signup", "view", "purchase", "error"]), value, "{}"))
    rows += [(1000 + i, at(), 100 + i, "signup", 0.0, "{}") for i in range(3)]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(path / "events.parquet"))
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_odd_events_match_sql(spark, odd, name):
    assert oracle.differences(spark, QUERIES[name], ORACLE_SQL[name], odd) == ""


@pytest.mark.parametrize("cell", [7, 1000])
def test_holes_do_not_depend_on_cells(spark, cell):
    r = random.Random(cell)
    df = spark.createDataFrame([(i % 2, s := r.randrange(400), s + r.randrange(4)) for i in range(80)], "device int, s long, e long")
    whole, cut = (sorted(map(tuple, I.holes(df, ["device"], cell=c).collect())) for c in (I.WHOLE, cell))
    assert whole == cut


def test_a_trace_is_one_file_however_many_tasks_there_are(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("file"), F.col("id").alias("ord"), F.struct(F.lit("X").alias("ph"), F.col("id").cast("string").alias("name")).alias("event"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        path = q_sources.trace_files(rows, "file", "ord")
    finally:
        spark.conf.unset(name)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).count() == 3
    assert q_sources.J.events(spark, path, split=512).count() == 400
