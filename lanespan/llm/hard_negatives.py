"""Hard-negative mining by Kronecker-packed products.

Scores are integer inner products. Several candidates' components of one dimension are made non-negative by a bias and
laid into separate fields of one wide integer; an anchor's biased component is multiplied with it once, and the sum over
the dimensions holds all their biased scores side by side, as fields are wide enough for the largest. What the biases
add is known from the sums of components, so exact scores are read off the fields.

Rows are dealt to blocks, and each cell of an anchors' block and a candidates' block is one group of bounded size, which
gives a few best rows for each of its anchors: first the nearest of the same label, then, within the window of scores
that each positive opens, the best of other labels. Ranks over the cells follow in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanespan.llm.common import stash

#: Anchors and candidates of a cell, on average.
ANCHORS, CANDIDATES = 2048, 4096
#: Candidates that share a wide integer.
FIELDS = 512
POSITIVES = NEGATIVES = 5
#: Negatives score from LEAST to MOST hundredths of the positive's score.
LEAST, MOST = 80, 100
SCALE = 256


class Packed:
    """Candidates, in order of label, as wide integers: one for each dimension and FIELDS candidates."""

    def __init__(self, v: np.ndarray, bias: int, bits: int):
        self.bias, self.bytes = bias, -(-bits // 8)
        self.sums = v.sum(axis=1)
        biased = (v + bias).astype("<u8")
        fields = np.zeros((*biased.T.shape, self.bytes), np.uint8)  # little-endian, as wide as a biased score
        n = min(self.bytes, 8)
        fields[:, :, :n] = biased.T.copy().view(np.uint8).reshape(*biased.T.shape, 8)[:, :, :n]
        self.cuts = range(0, len(v), FIELDS)
        self.wide = [[int.from_bytes(fields[d, lo : lo + FIELDS].tobytes(), "little") for d in range(v.shape[1])] for lo in self.cuts]
        self.n = len(v)

    def scores(self, anchor: np.ndarray, k: int) -> np.ndarray:
        """Exact scores of the k-th wide integers' candidates."""
        own = (anchor + self.bias).tolist()
        total = sum(a * w for a, w in zip(own, self.wide[k], strict=True))
        lo, hi = self.cuts[k], min(self.cuts[k] + FIELDS, self.n)
        raw = np.frombuffer(total.to_bytes((hi - lo) * self.bytes, "little"), np.uint8).reshape(hi - lo, self.bytes)
        field = np.zeros((hi - lo, 8), np.uint8)
        field[:, : self.bytes] = raw[:, :8]
        # sum((a + bias) * (c + bias)) = a.c + bias * (sum(a) + sum(c)) + dimensions * bias * bias
        return field.view("<i8").ravel() - self.bias * (int(anchor.sum()) + self.sums[lo:hi]) - len(anchor) * self.bias**2


def first_rows(score: np.ndarray, vec: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by score, the highest first, then by id, null ids last."""
    if len(score) > n:
        edge = np.partition(score, len(score) - n)[len(score) - n]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((vec[at], ~known[at], -score[at]))[:n]]


class Cell:
    """The rows of a cell that may be among an anchor's first."""

    SCHEMA = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, other long, other_id long, score long"
    NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

    def __init__(self, bias: int, bits: int, first: int, least: int, most: int):
        self.bias, self.bits, self.first, self.least, self.most = bias, bits, first, least, most

    def matrix(self, table: pa.Table) -> np.ndarray:
        v = table["v"].combine_chunks()
        return v.flatten().to_numpy().reshape(len(v), -1)

    def run(self, table: pa.Table) -> pa.Table:
        """table: anchors (asks is true; positives null, or their keys, ids and scores) and candidates."""
        asks = table["asks"].combine_chunks()
        left, right = table.filter(asks), table.filter(pc.invert(asks))
        out: list[list] = [[] for _ in self.NAMES]
        if left.num_rows and right.num_rows:
            right = right.sort_by("label")
            label, key = right["label"].to_numpy(), right["key"].to_numpy()
            known = right["vec_id"].is_valid().to_numpy()
            vec = right["vec_id"].fill_null(0).to_numpy()
            packed = Packed(self.matrix(right), self.bias, self.bits)
            spans = [(label[lo], label[min(lo + FIELDS, len(label)) - 1]) for lo in packed.cuts]
            for row, v in zip(left.select(["key", "vec_id", "label", "positives"]).to_pylist(), self.matrix(left), strict=True):
                same, wanted = row["label"], row["positives"]
                use = [k for k, (a, b) in enumerate(spans) if (a <= same <= b if wanted is None else not a == same == b)]
                if not use:
                    continue
                at = np.concatenate([np.arange(packed.cuts[k], min(packed.cuts[k] + FIELDS, len(label))) for k in use])
                score = np.concatenate([packed.scores(v, k) for k in use])
                ok = (label[at] == same) & (key[at] != row["key"]) if wanted is None else label[at] != same
                at, score = at[ok], score[ok]
                for p in [None] if wanted is None else wanted:
                    if p is None:
                        a, s = at, score
                    else:
                        inside = (self.least * p["score"] <= 100 * score) & (100 * score <= self.most * p["score"])
                        a, s = at[inside], score[inside]
                    top = first_rows(s, vec[a], known[a], self.first)
                    of = (p["other"], p["other_id"], p["score"]) if p else (None, None, None)
                    for i in top.tolist():
                        values = (row["key"], row["vec_id"], *of, int(key[a[i]]), int(vec[a[i]]) if known[a[i]] else None, int(s[i]))
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(self.NAMES, out, strict=True)})


def components(rows: DataFrame, vector_col: str, scale: int):
    """Each component times scale, rounded down."""
    return rows.withColumn("v", F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)))


def hard_negatives(
    rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: int = ANCHORS, candidates: int = CANDIDATES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a column over id, embedding and label. Rows with a null label, a null vector, or a null or non-finite
    component take no part. A score is the inner product of two vectors' components times scale, rounded down; shorter
    vectors are filled up with zeros. An anchor's positives are the first rows of its label other than itself, by score, the
    highest first, then by id; each positive's negatives are the first rows of other labels that score from least to
    most hundredths of it. Rows are told apart by themselves, so repeated ids are other rows, and a repeated anchor has
    its rows twice; null ids are never anchors unless is_anchor says so, and lose ties. Without rows, or without two
    labels, the result is empty. Scores that may not fit a long raise an error. Other columns are not read.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = components(rows.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(fine), "x", scale)
    rows = stash(rows.select("vec_id", "label", "anchor", "v", F.monotonically_increasing_id().alias("key")))
    far = F.greatest(F.abs(F.array_min("v")), F.abs(F.array_max("v")))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("asked"), F.max(F.size("v")).alias("size"), F.max(far).alias("far"), F.min(F.array_min("v")).alias("low")).first()
    size, bias = facts.size or 0, facts.far or 0
    bits = max(1, (max(1, size) * (2 * bias) ** 2).bit_length())
    if bits > 63:
        raise ValueError("scores of these vectors may not fit a long")
    blocks = max(1, -(-facts.asked // anchors)), max(1, -(-facts.n // candidates))
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v")))
    rows = rows.withColumn("v", padded)

    def placed(df: DataFrame, own: int) -> DataFrame:
        """Rows once for each cell of their block's row or column."""
        across = F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - own] - 1)))
        return df.withColumn("mine", F.pmod(F.xxhash64("key"), F.lit(blocks[own])).cast("int")).withColumn("other", across).withColumnRenamed("mine", f"b{own}").withColumnRenamed("other", f"b{1 - own}")

    kind = "array<struct<other:bigint,other_id:bigint,score:bigint>>"
    right = placed(rows.select("key", "vec_id", "label", "v", F.lit(None).cast(kind).alias("positives"), F.lit(False).alias("asks")), 1)

    def ranked(left: DataFrame, first: int, by: list[str]) -> DataFrame:
        cell = Cell(bias, bits, first, least, most)
        cells = placed(left.withColumn("asks", F.lit(True)), 0).unionByName(right).groupBy("b0", "b1")
        found = cells.applyInArrow(lambda table: cell.run(table), Cell.SCHEMA)
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("other_id").asc_nulls_last(), "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)

    asking = rows.where("anchor").select("key", "vec_id", "label", "v")
    near = ranked(asking.withColumn("positives", F.lit(None).cast(kind)), positives, ["anchor"])
    lists = stash(near.groupBy("anchor").agg(F.collect_list(F.struct("other", "other_id", "score")).alias("positives")))
    found = ranked(asking.join(lists, asking["key"] == lists["anchor"]).drop("anchor"), negatives, ["anchor", "positive"])
    return found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The exercise's labels: every seventh row's label is moved on by one.
MOVED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"

ORACLE = f"""
WITH fine AS (
  SELECT vec_id, {MOVED} AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.expr(MOVED))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
