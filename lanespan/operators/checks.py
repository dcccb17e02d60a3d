"""Validation as queries: a check gives a row with its id, the rows it looked at, and how many violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(check_id: str, rows: DataFrame, violation: Column) -> DataFrame:
    """check_id, n_rows, n_violations. A null verdict is a violation."""
    bad = F.coalesce(violation, F.lit(True))
    return rows.agg(F.lit(check_id).alias("check_id"), F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_violations"))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def closure(rows: DataFrame, whole: str, parts: list[str], tolerance: float) -> Column:
    """True where parts do not add up to the whole, beyond a share of it."""
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return F.abs(total - F.col(whole)) > F.abs(F.col(whole)) * tolerance


def missing(needed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return needed.select(key).distinct().join(there.select(key).distinct(), key, "left_anti")


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: what only one of both has; empty if they are equal."""
    return missing(a, b, key).withColumn("side", F.lit("left")).unionByName(missing(b, a, key).withColumn("side", F.lit("right")))


def spread(rows: DataFrame, variant: str, position: list[str], most: float) -> DataFrame:
    """variant, low, high, beyond: numbers of rows of a variant's positions, and whether they differ by more than a share of the highest."""
    n = rows.groupBy(variant, *position).agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy(variant).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return out.withColumn("beyond", (F.col("high") - F.col("low")) > F.col("high") * most)


def coverage(rows: DataFrame, group: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """group, n, and for each pattern the share of rows that it is found in."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col(text).rlike(p), F.lit(False)).cast("int")).alias(name) for name, p in patterns.items()])


def name_status(used: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """name, n, status of used names (name, n) by a vocabulary (name, kind): known, deprecated (kind alias), unknown, or unused."""
    status = F.when(F.col("kind").isNull(), "unknown").when(F.col("n").isNull(), "unused").when(F.col("kind") == "alias", "deprecated").otherwise("known")
    return used.join(vocabulary, "name", "full").select("name", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def unsupported_leaves(rows: DataFrame, module: str, evidence: list[str]) -> DataFrame:
    """The rows of which no word (of more than two letters) of the module's last part stands in their evidence; modules without such words are left out."""
    words = F.filter(F.split(F.substring_index(module, "/", -1), "[^A-Za-z0-9]+"), lambda w: F.length(w) > 2)
    text = F.lower(F.concat_ws(" ", *evidence))
    return rows.where((F.size(words) > 0) & ~F.exists(words, lambda w: text.contains(F.lower(w))))


def matching(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The rows of which the columns, joined by blanks, hold the text, whatever its case; all rows if it is blank."""
    t = text.strip().lower()
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(t)) if t else rows
