"""Mixing sources to target weights by capped water-filling.

Targets: all sources share the total by weight; a source that would exceed max_epochs times its size is clamped
there and its excess is shared again, until no source is above. Each round is one aggregate over the table of
sources. Sampling: every document of a source is taken floor(target / size) times as a whole; the rest of the target
is filled by a seeded order of the documents, the last of which is taken in part. The order is cut into buckets by
the high digits of the seeded key, sized so that a bucket holds about BUCKET rows however large its source is; only
sums by bucket and the one bucket that the cut falls into are ever put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanespan.llm.common import stash

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET = 512
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weight: str = "weight", size: str = "size", max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes with a column target. Sources without words get 0; if all are clamped, what is left is given to none."""
    # The level of a source is what a unit of weight may get before the source is full; a source is clamped when the
    # common level passes its own. Only one-row sums come to the driver.
    full = F.col(size) * F.lit(float(max_epochs))
    total = sizes.agg(F.sum(size)).first()[0] or 0
    level = 0.0
    while True:
        below = full / F.col(weight) > F.lit(level)
        clamped, weights = sizes.agg(F.sum(F.when(~below, full)), F.sum(F.when(below, F.col(weight)))).first()
        if not weights:
            break
        new = (total - (clamped or 0)) / weights
        if new <= level:
            break
        level = new
    return sizes.withColumn("target", F.least(full, F.lit(float(level)) * F.col(weight)))


def ranked(sources: DataFrame, weights: tuple) -> DataFrame:
    """sources (source, size, rows) with a weight by code point order, null last.

    Distinct names are dealt to ranges; ranks are counted within a range and shifted by the rows of those before it.
    """
    dealt = stash(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("shift"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    rank = dealt.withColumn("rank", rank).join(before, "part")
    return rank.select("source", "size", "rows", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") + F.col("shift")) % len(weights) + 1).cast("int")).alias("weight"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket: int = BUCKET, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, whole (full passes), part (words of the partial pass), and with_text the text.

    Null texts have no words and are taken 0 times; null is a source of its own and sorts last. Rows that repeat an id
    are separate documents; their order among each other follows their size. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *([F.col(text_col).alias("text")] if with_text else []))
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = stash(rows.withColumn("row_key", F.monotonically_increasing_id()))
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    sources = stash(targets(stash(ranked(sources, weights)), max_epochs=max_epochs))
    plan = sources.select(
        F.col("source").alias("of"), F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long").alias("whole"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket)).cast("long").alias("buckets"),
    )
    plan = plan.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    # The plan has one row for a source. With few sources it is sent to all; beyond that the join is by source, and adaptive execution splits hot ones.
    few = sources.count() <= 100_000
    joined = rows.join(F.broadcast(plan) if few else plan, rows["source"].eqNullSafe(plan["of"]))
    joined = joined.withColumn("slot", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(float(2**32))))

    sums = joined.groupBy("of", "slot").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("buckets").alias("buckets"))
    # A source has rows / bucket slots; they are summed in groups of 1,024 first, so that no window holds more than their root or so.
    sums = sums.withColumn("group", F.floor(F.col("slot") / 1024))
    tops = sums.groupBy("of", "group").agg(F.sum("words").alias("w"))
    tops = tops.select(F.col("of").alias("of2"), F.col("group").alias("g2"), (F.sum("w").over(Window.partitionBy("of").orderBy("group")) - F.col("w")).alias("base"))
    start = sums.join(tops, F.col("of").eqNullSafe(F.col("of2")) & (F.col("group") == F.col("g2")))
    start = start.withColumn("before", F.col("base") + F.sum("words").over(Window.partitionBy("of", "group").orderBy("slot")) - F.col("words"))
    cut = start.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    cut = cut.select(F.col("of").alias("cut_of"), F.col("slot").alias("cut_slot"), F.col("before").alias("cut_before"))
    none = start.where((F.col("before") >= F.col("rest")) & (F.col("words") > 0)).groupBy("of").agg(F.min("slot").alias("none_from")).select(F.col("of").alias("none_of"), "none_from")
    ends = cut.join(none, F.col("cut_of").eqNullSafe(F.col("none_of")), "full").select(F.coalesce("cut_of", "none_of").alias("end_of"), "cut_slot", "cut_before", "none_from", F.lit(True).alias("ended"))
    ends = stash(ends)
    placed = joined.join(F.broadcast(ends) if few else ends, F.col("of").eqNullSafe(F.col("end_of")), "left")
    in_cut = F.coalesce(F.col("slot") == F.col("cut_slot"), F.lit(False))
    after = F.coalesce(F.col("slot") > F.col("cut_slot"), F.col("slot") >= F.col("none_from"), F.lit(False))
    order = Window.partitionBy("of", "slot").orderBy("key", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("cut_before") - F.coalesce(F.sum("size").over(order), F.lit(0))))
    outside = placed.where(~in_cut).withColumn("part", F.when(after | (F.col("rest") <= 0), F.lit(0)).otherwise(F.col("size")))
    both = outside.unionByName(placed.where(in_cut).withColumn("part", part))
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), "whole", F.col("part").cast("long").alias("part"), *(["text"] if with_text else []))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: doc_id, source, copy (from 1), n_words, text, a row for each time that a document is taken; what is not taken has none.

    Full passes give the text as it is; of a partial pass that ends within a document its first words are given, with one
    blank between them. Words add up to what mix() states.
    """
    rows = mix(docs, with_text=True, **options).where("taken > 0")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = F.col("whole") + (F.col("part") > 0).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    last = cut & (F.col("copy") == F.col("copies"))
    head = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.greatest(F.lit(1), F.col("part")).cast("int")), " ")
    return rows.select("doc_id", "source", "copy", F.when(last, F.col("part")).otherwise(F.col("size")).alias("n_words"), F.when(last, head).otherwise(F.col("text")).alias("text"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM t GROUP BY source),
w AS (SELECT source, source_size, CAST(CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS full_size FROM s),
r AS (
  SELECT full_size / weight AS ratio, rk2,
         (sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY rk2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY rk2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
  FROM (SELECT *, row_number() OVER (ORDER BY full_size / weight, source) AS rk2 FROM w)),
l AS (SELECT coalesce(arg_min(lam, rk2), 0) AS level FROM r WHERE lam < ratio),
p AS (SELECT source, source_size, least(full_size, level * weight) AS target FROM w, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM p),
d AS (
  SELECT doc_id, size, source_size, target, whole, CAST(round(target) AS BIGINT) - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM d
"""


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
