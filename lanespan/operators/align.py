"""Alignment of two captures of the same workload, layer by layer and launch by launch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.functions.rules import first_match
from lanespan.operators import joins as J
from lanespan.operators import rollups as R
from lanespan.operators import segments as S


LAYER = ["layer"]


def family(name: str, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern is in the name, else the identifier before < or (, of 80 letters at most."""
    own = F.left(F.regexp_extract(F.col(name), r"^(?:void\s+)?([^<(]*)", 1), F.lit(80))
    return F.coalesce(first_match([{"match": {name: p}, "label": x} for p, x in rules], "label"), own) if rules else own


def normalized(name: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(name), r"^void\s+|\(anonymous namespace\)::|<unnamed>::", ""), r"\s+", "")


def layered(kernels: DataFrame, anchor: str, layers: int, per_layer: int, rules: list[tuple[str, str]]) -> DataFrame:
    """device, pass, layer, place, name, family, duration of the kernels of complete passes."""
    rows = S.anchor_blocks(kernels.withColumn("id", F.col("e")), F.col("name").contains(anchor), ["device"], layers, per_layer)
    rows = S.numbered(rows, ["device", "pass", "layer"], ["s", "e", "name"], "place")
    return rows.select("device", "pass", "layer", "place", "name", normalized("name").alias("plain"), family("name", rules).alias("family"), ((F.col("e") - F.col("s")) / 1000.0).alias("us"))


def chosen_pass(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pass of right (device, pass) whose layers differ least in numbers of kernels from left's one pass, then the nearest to 16, then the first."""
    n = lambda x, c: x.groupBy("device", "pass", "layer").agg(F.count(F.lit(1)).alias(c))
    a = n(left, "na").select("layer", "na")
    both = n(right, "nb").join(a, "layer", "left").na.fill(0, ["na"])
    off = both.groupBy("device", "pass").agg(F.sum(F.abs(F.col("na") - F.col("nb"))).alias("off"))
    return off.orderBy("off", F.abs(F.col("pass") - 16), "pass", "device").limit(1).select("device", "pass")


def launches(left: DataFrame, right: DataFrame, keys: list[str] = LAYER) -> DataFrame:
    """keys, k, names, status and difference of times of launches in the same place; tails without a partner are left out. place may be a struct."""
    side = lambda x, n: x.select(*keys, F.col("place").alias("at"), *[F.col(c).alias(f"{c}_{n}") for c in ("name", "plain", "family", "us")])
    a, b = side(left, "a"), side(right, "b")
    z = J.zipped(a.withColumnRenamed("at", "at_a"), b.withColumnRenamed("at", "at_b"), keys, ["at_a"], ["at_b"], "inner")
    status = F.when(F.col("plain_a") == F.col("plain_b"), "same_order_exact_name").when(F.col("family_a") == F.col("family_b"), "same_order_family").otherwise("same_order_mismatch")
    return z.select(*keys, "k", "name_a", "name_b", status.alias("status"), (F.col("us_b") - F.col("us_a")).alias("delta_us"))


def matches(left: DataFrame, right: DataFrame, keys: list[str] = LAYER) -> DataFrame:
    """keys, n_left, matched, paired, match_rate over all of left."""
    n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    m = launches(left, right, keys).groupBy(*keys).agg(F.count_if(F.col("status") != "same_order_mismatch").alias("matched"), F.count(F.lit(1)).alias("paired"))
    return n.join(m, keys, "left").na.fill(0, ["matched", "paired"]).withColumn("match_rate", F.col("matched") / F.col("n_left"))


def summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """layer, n_left, matched, match_rate over all of left, and the likeness of the families of both."""
    out = matches(left, right).drop("paired")
    return out.join(R.jaccard(left, right, "layer", "family").select("layer", "jaccard"), "layer", "left")
