from pyspark.sql import functions as F

from lanespan.plans import q_segments
from lanespan.plans.catalogue import QUERIES


def test_no_template_is_left_out(spark, sf):
    steps = q_segments.in_steps(spark, sf)
    got = QUERIES["stable_position_stats_all"](spark, sf).cache()
    assert got.agg(F.sum("n")).first()[0] == steps.count() > QUERIES["stable_position_stats"](spark, sf).agg(F.sum("n")).first()[0]
    assert got.where("pos = 0").agg(F.sum("n")).first()[0] == steps.select("device", "step").distinct().count()
    assert got.select("template").distinct().count() > 20
