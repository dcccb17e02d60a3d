"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows are merged in three steps: within each input task, within salted digest groups, and over the salts. Every
step groups by the digest *and* the whole normalised text, so that texts meet only when their content is equal.
Only digests that hold a large share of the rows are salted; their number is bounded by the inverse of that share.
Groups without salt are whole after the second step, so the third is for salted ones. Rows then find their group by
the digest where one text alone has it, and by the digest and the text where several have (with 320 bits, none yet).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import stash, without

#: A digest with more than this share of all rows is hot. At most 1 / HOT_SHARE digests can be.
HOT_SHARE = 1 / 1024
SALTS = 64


def digest(norm):
    """What texts meet by: equal for equal texts, and a group by itself for any other."""
    return F.concat_ws("-", F.sha2(norm, 256), F.hex(F.xxhash64(norm)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE, salts: int = SALTS, key=digest) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_key.

    Texts are equal when identical after deletion of every character of [\\x20\\x09-\\x0D]. Of equal texts the one with
    the most code points stays, then the smallest id. Null texts count as empty; empty texts are equal to each other.
    Null ids lose every tie. Rows that repeat an id and its text are separate members of the group, of which one stays.
    An empty table gives an empty result. Other columns of docs are not read, so their names cannot clash.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(raw, r"[\x20\x09-\x0D]+", "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(raw).alias("chars"), norm.alias("norm"))
    rows = rows.select("doc_id", "chars", "norm", F.sha2("norm", 256).alias("text_sha256"), key(F.col("norm")).alias("key"), F.monotonically_increasing_id().alias("row_key"))
    rows = stash(rows)

    least = max(64, int(rows.count() * hot_share) + 1)
    hot = rows.groupBy("key").count().where(F.col("count") >= least).select("key", F.lit(True).alias("hot"))
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")
    salted = (
        rows.join(F.broadcast(hot), "key", "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_key"), F.lit(salts))).otherwise(F.lit(0)))
        .groupBy("key", "text_sha256", "hot", "salt", "norm")
        .agg(best, F.count(F.lit(1)).alias("n"))
        .select("key", "text_sha256", "hot", F.when(F.col("hot"), F.col("norm")).alias("norm"), "best", "n")
    )
    salted = stash(salted)
    merged = salted.where("hot").groupBy("key", "text_sha256", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("n")).drop("norm")
    groups = salted.where("hot is null").select("key", "text_sha256", "best", "n").unionByName(merged)
    groups = stash(groups.select("key", "text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row_key").alias("keep_key"), F.col("n").alias("group_size")))
    shared = stash(groups.groupBy("key").count().where("count > 1").select("key"))

    members = rows.select("doc_id", "row_key", "key")
    large = F.broadcast(groups.where(F.col("group_size") >= least))  # no more than 1 / hot_share
    small = groups.where(F.col("group_size") < least)
    if shared.limit(1).count() == 0:
        found = members.join(large, "key").unionByName(members.join(F.broadcast(hot), "key", "left_anti").join(small, "key"))
    else:  # a group is told by the text of the row it keeps
        text = rows.select(F.col("row_key").alias("keep_key"), F.col("norm"))
        told = groups.join(text, "keep_key")
        found = rows.select("doc_id", "row_key", "key", "norm").join(told, ["key", "norm"]).drop("norm")
    return found.select("doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_key")).alias("kept"), "text_sha256", "row_key")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. Rows that repeat an id are told apart by their text."""
    found = stash(exact_dedup(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"))
    twice = stash(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    out = without(docs, found.where("not kept").join(twice, "doc_id", "left_anti").select("doc_id"), id_col)
    if twice.limit(1).count() == 0:
        return out
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)
    kept = found.where("kept").join(twice, found["doc_id"].eqNullSafe(twice["doc_id"]), "left_semi").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept"), F.lit(True).alias("__stays"))
    again = twice.select(F.col("doc_id").alias("__again"))
    some = docs.join(again, docs[id_col].eqNullSafe(again["__again"]), "left_semi").withColumn("__sha", sha)
    some = some.join(kept, some[id_col].eqNullSafe(kept["__id"]) & (some["__sha"] == kept["__kept"])).dropDuplicates(["__id", "__sha"]).select(*docs.columns)
    return out.join(again, docs[id_col].eqNullSafe(again["__again"]), "left_anti").unionByName(some)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM t
"""


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")
