"""Windows by cell against plain windows, and how often plans read their tables."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanespan.operators import joins as J
from lanespan.operators import segments as S
from lanespan.plans.catalogue import QUERIES


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_running_values_by_cell_equal_those_by_lane(spark):
    r = random.Random(7)
    rows = [(r.choice([1, 2, None]), r.randrange(-300, 300), i, r.choice([None, 3, 5, 8])) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t long, id long, v int")
    got = S.along(df, ["k"], ["t", "id"], sums={"n": F.lit(1)}, lasts={"a": F.col("v")}, nexts={"b": F.col("v")}, befores={"c": F.col("v")}, cell=40)
    w = Window.partitionBy("k").orderBy("t", "id")
    upto, before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select("*", F.count(F.lit(1)).over(upto).alias("n"), F.last("v", True).over(upto).alias("a"), F.first("v", True).over(after).alias("b"), F.last("v", True).over(before).alias("c"))
    key = lambda x: (x.id, x.n, x.a, x.b, x.c)
    assert sorted(map(key, got.collect()), key=repr) == sorted(map(key, want.collect()), key=repr)


def test_nearest_matches_brute_force(spark):
    r = random.Random(3)
    ev = [(r.randrange(3), r.randrange(500), i) for i in range(50)]
    pr = [(r.randrange(4), r.randrange(-50, 600), i) for i in range(80)]
    got = J.nearest(spark.createDataFrame(pr, "k int, t long, probe int"), spark.createDataFrame(ev, "k int, t long, ev int"), "k", "t", "ev", cell=70)
    want = {p: min(((abs(t - at), e) for kk, t, e in ev if kk == k), default=(None, None)) for k, at, p in pr}
    assert {x.probe: (x.distance, x.nearest) for x in got.collect()} == want


def test_plans_read_their_tables_few_times(spark, sf):
    assert scans(QUERIES["nearest_match"](spark, sf)) <= 4
    assert scans(QUERIES["recursive_parent_walk"](spark, sf)) == 0  # the last round is read from the checkpoint
    assert scans(QUERIES["interval_holes"](spark, sf)) <= 8
