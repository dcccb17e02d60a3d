"""What files take tells nothing of the rows made of them: no side of a join is broadcast by it unless it is very small."""

import pytest
from pyspark.sql import functions as F

from lanespan.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("parts")
    k = F.col("id")
    text = lambda x, n: F.concat(F.lit(x), (k % n).cast("string"))
    x = spark.range(60_000).select(k.alias("p_partkey"), text("name ", 50).alias("p_name"), text("Brand#", 25).alias("p_brand"), text("TYPE ", 6).alias("p_type"), (k % 50).cast("int").alias("p_size"), (k % 1000 + 0.5).cast("double").alias("p_retailprice"))
    x.coalesce(1).write.parquet(str(path / "part.parquet"))
    return str(path)


@pytest.mark.parametrize("name", ["graph_phases", "source_resolution", "layer_marker_check"])
def test_kernels_of_all_parts_are_not_broadcast_by_the_size_of_a_file(spark, parts, name):
    plan = QUERIES[name](spark, parts)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
