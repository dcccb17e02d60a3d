"""The repair loop, and errors of what cannot be right."""

import pytest
from pyspark.sql import functions as F

from lanespan.operators import contracts as C
from lanespan.operators import origin as O
from lanespan.operators import tables as T
from lanespan.sources.repair import published


def negative(df):
    return C.violations(df, "not_negative", F.col("x") < 0, F.col("k"), F.col("x"))


def frame(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "k long, x long")


def rows(df):
    return sorted(r.x for r in df.collect())


def test_a_broken_table_is_rebuilt_once_and_kept(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    frame(spark, 1, -2).write.parquet(f"{root}/current")
    built = []
    build = lambda: built.append(1) or frame(spark, 5, 6)
    assert rows(published(spark, root, build, negative)) == [5, 6] == rows(published(spark, root, build, negative)) and built == [1]
    assert rows(spark.read.parquet(f"{root}/rejected/0")) == [-2, 1]


def test_a_missing_or_half_written_table_is_built(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert rows(published(spark, root, lambda: frame(spark, 3), negative)) == [3]
    (tmp_path / "t/current/_SUCCESS").unlink()
    assert rows(published(spark, root, lambda: frame(spark, 4), negative)) == [4]


def test_a_hopeless_table_is_kept_apart_and_raises(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    frame(spark, -1).write.parquet(f"{root}/current")
    with pytest.raises(ValueError, match="not_negative 0: -7"):
        published(spark, root, lambda: frame(spark, -7), negative)
    assert not (tmp_path / "t/current").exists() and rows(spark.read.parquet(f"{root}/rejected/1")) == [-7]


def test_a_window_beyond_the_kernels_is_an_error(spark):
    k = spark.createDataFrame([(0, 1, i, i + 1, "a") for i in range(5)] + [(1, 1, i, i + 1, "a") for i in range(3)], "device int, stream int, s long, e long, name string")
    assert O.window(k, 1, 4, {}).count() == 4 + 2
    assert O.window(k.where("device = 0"), 1, 4, {}, strict=True).count() == 4
    with pytest.raises(Exception, match="device 1 has only 3 kernels"):
        O.window(k, 1, 4, {}, strict=True).collect()


ORIGIN = "region string, seq long, module string, operator_name string, duration_us double, duration_avg_us double, start_ns long, end_ns long, stream int, layer_id int, unit_position string, unit_id string, unit_variant string, function_introduction string"


def test_units_without_fields_or_time_are_errors(spark):
    row = lambda layer, end: ("r", 1, "m/attn", "k", 1.0, None, 0, end, 1, layer, "", "", "", "")
    positions = spark.createDataFrame([(1, "p", "i", "v"), (2, "p", None, "v")], "layer_id int, p_position string, p_id string, p_variant string")
    one = lambda layer, end: spark.createDataFrame([row(layer, end)], ORIGIN)
    assert T.enriched(one(1, 10), [], positions, strict=True).first().unit_id == "i"
    with pytest.raises(Exception, match="unit_id"):
        T.enriched(one(2, 10), [], positions, strict=True).collect()
    with pytest.raises(Exception, match="no time"):
        T.enriched(one(1, 0), [], positions, strict=True).collect()
