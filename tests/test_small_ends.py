"""Operators that no query reaches, each by itself."""

import pytest
from pyspark.sql import functions as F

from lanespan.functions import kernels as K
from lanespan.operators import checks as C
from lanespan.operators import contracts as T
from lanespan.operators import document as D
from lanespan.operators import intervals as I
from lanespan.operators import rollups as R
from lanespan.sources import capture as M


def test_total_row(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 3, 0.5)], "k string, n long, x double")
    assert sorted(map(tuple, R.with_total(df, ["k"], "all", "n", "x").collect())) == [("a", 1, 2.0), ("all", 4, 2.5), ("b", 3, 0.5)]


def test_clip(spark):
    df = spark.createDataFrame([(0, 5), (4, 12), (20, 30)], "s long, e long")
    assert sorted(map(tuple, I.clip(df, F.lit(3), F.lit(10)).collect())) == [(3, 5), (4, 10)]


def test_column_before(spark):
    assert T.column_before(spark, ["a", "b", "c"], "a", "b").count() == 0
    assert T.column_before(spark, ["a", "x", "b"], "a", "b").count() == 1 == T.column_before(spark, ["a"], "a", "b").count()


def test_conflicts(spark):
    make = lambda rows: spark.createDataFrame(rows, "key string, value string")
    a, b = make([("x", "1"), ("y", "2"), ("z", None), ("only", "3")]), make([("x", "1"), ("y", "9"), ("z", "4"), ("other", "5")])
    assert sorted(map(tuple, M.conflicts(a, b).collect())) == [("y", "2", "9", "conflict"), ("z", None, "4", "conflict")]
    assert {r.key: r.status for r in M.conflicts(a, b, missing=True).collect()} == {"y": "conflict", "z": "conflict", "only": "only_captured", "other": "only_declared"}


def test_unsupported_leaves(spark):
    df = spark.createDataFrame([("m/self_attn", "ATTN core"), ("m/mlp_up", "gate"), ("m/a1", "x")], "module string, text string")
    assert [r.module for r in C.unsupported_leaves(df, "module", ["text"]).collect()] == ["m/mlp_up"]


def test_profile_of():
    categories, pairs = K.profile_of({"categories": [{"label": "L", "key": "k", "any": ["x"]}], "include_universal": False, "simplify": [["a", "b"]]})
    assert categories == [("L", "k", ["x"], False)] and pairs[-1] == ("a", "b")
    with pytest.raises(ValueError, match="text"):
        K.profile_of({"categories": [{"label": "L", "key": "k", "any": []}]})


def test_ordered_distinct(spark):
    assert spark.range(1).select(D.ordered_distinct(F.array(*map(F.lit, "babca"))).alias("x")).first().x == ["b", "a", "c"]
