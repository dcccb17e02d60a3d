"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and all others as
named users; system turns stay system turns. The mask marks what the assistant says, with its end mark. A row holds a
part of PART turns, so a conversation of any length stays in bounded rows; most conversations are one part. What is
said cannot forge a mark: `<|` in texts and names gets a backslash between its signs (one more, if there are some), and
so does `|>` in names. Taking one backslash out of each such place gives the words again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART = 256
END = "<|end|>"


def no_opening(c):
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def no_marks(c):
    return F.regexp_replace(no_opening(c), r"\|(\\*)>", r"|$1\\>")


def in_parts(rows: DataFrame, part: int) -> DataFrame:
    """rows with the number of their part: a conversation's turns in order, `part` each.

    Turns are counted by cells of turn numbers, so that only the rows of a cell are put in order; where numbers are
    missing or repeat, a cell has more rows than others and is sorted by one task, which may spill.
    """
    cells = rows.groupBy("conv_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.col("cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("conv_id").alias("of"), F.col("cell").alias("at"), F.coalesce(before, F.lit(0)).alias("before"))
    # Of a conversation in one cell nothing comes before; the others are joined by cell.
    rank = F.row_number().over(Window.partitionBy("conv_id", "cell").orderBy("turn", "speaker", "said")) - 1
    ranked = rows.withColumn("rank", rank).join(cells.where("before > 0"), F.col("conv_id").eqNullSafe(F.col("of")) & F.col("cell").eqNullSafe(F.col("at")), "left")
    return ranked.withColumn("part", F.floor((F.coalesce("before", F.lit(0)) + F.col("rank")) / part)).drop("of", "at", "before", "rank", "cell")


def rotate(turns: DataFrame, part: int = PART, system: str = "system", conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, participant and part: conv_id, perspective, part, n_turns, text, mask, n_masked.

    Turns are in order of turn, speaker and text, nulls first; those that repeat are each rendered. A part holds the next
    `part` of them, whatever their numbers. Null texts are empty; null speakers are unnamed users and no perspective, nor
    is the system. A conversation without participants has no rows. Null conversation ids are one conversation. Masks
    are spans begin-end of code points in text, joined by commas. Extra columns are not read.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(speaker_col).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("said"))
    people = rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != system)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    rows = in_parts(rows.withColumn("cell", F.floor(F.col("turn") / part)), part)
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns"))
    each = parts.join(people, parts["conv_id"].eqNullSafe(people["of"]))

    def piece(t):
        who = F.when(t["speaker"] == F.col("perspective"), F.lit("assistant")).when(t["speaker"] == system, F.lit("system")).when(t["speaker"].isNull(), F.lit("user"))
        head = F.concat(F.lit("<|"), who.otherwise(F.concat(F.lit("user name="), no_marks(t["speaker"]))), F.lit("|>"))
        return F.struct(head.alias("head"), no_opening(t["said"]).alias("said"), F.coalesce(t["speaker"] == F.col("perspective"), F.lit(False)).alias("own"))

    each = each.withColumn("pieces", F.transform("turns", piece))
    size = lambda p: F.length(p["head"]) + F.length(p["said"]) + len(END) + 1
    each = each.withColumn("sizes", F.transform("pieces", size))

    def span(p, i):
        before = F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.length(p["head"])
        return F.when(p["own"], F.concat(before.cast("string"), F.lit("-"), (before + F.length(p["said"]) + len(END)).cast("string")))

    said = F.transform("pieces", lambda p: F.concat(p["head"], p["said"], F.lit(END + "\n")))
    masked = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + F.when(p["own"], F.length(p["said"]) + len(END)).otherwise(0))
    return each.select("conv_id", "perspective", F.col("part").cast("long"), F.size("pieces").cast("long").alias("n_turns"), F.concat_ws("", said).alias("text"), F.concat_ws(",", F.transform("pieces", span)).alias("mask"), masked.alias("n_masked"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS said,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1) // 256 AS part,
         regexp_replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') AS name
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS me FROM t WHERE role <> 'system'),
x AS (
  SELECT t.*, me, '<|' || CASE WHEN role = me THEN 'assistant' WHEN role = 'system' THEN 'system' WHEN role IS NULL THEN 'user' ELSE 'user name=' || name END || '|>' AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 8) OVER (PARTITION BY conv_id, me, part ORDER BY turn NULLS FIRST, role NULLS FIRST, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b
  FROM x)
SELECT conv_id, me AS perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
       string_agg(head || said || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, said) AS text,
       coalesce(string_agg(CASE WHEN role = me THEN CAST(CAST(b AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b + length(said) + 7 AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, said), '') AS mask,
       CAST(sum(CASE WHEN role = me THEN length(said) + 7 ELSE 0 END) AS BIGINT) AS n_masked
FROM y GROUP BY conv_id, me, part
"""


def query(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
