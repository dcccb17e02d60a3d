"""Rollups with explicit totals, shares, rankings and multiset comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.operators.joins import sent
from lanespan.sources.scratch import cut


def with_total(df: DataFrame, keys: list[str], label: str, *sums: str) -> DataFrame:
    """df and one row more, whose first key is label, whose other keys are null, and whose sums are those of all rows."""
    total = df.agg(*[F.sum(c).alias(c) for c in sums])
    cols = [F.lit(label).alias(keys[0]), *[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys[1:]], *sums]
    return df.select(*keys, *sums).unionByName(total.select(*cols))


def kept_zero(found: DataFrame, names: list[str], key: str, **zero) -> DataFrame:
    """A row for each name in their order, ord; names without rows get zero values."""
    spark = found.sparkSession
    all_ = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"ord long, {key} string")
    out = F.broadcast(all_).join(found, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in zero.items()})


def first_seen(df: DataFrame, keys: list[str], order: list[str], **aggs: Column) -> DataFrame:
    """Sums by keys with `first`, the smallest order key, by which the groups are in order of appearance."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"), *[a.alias(n) for n, a in aggs.items()])


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, with rank. The plan keeps k rows a group on each task before the shuffle (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def jaccard(a: DataFrame, b: DataFrame, group: str, member: str) -> DataFrame:
    """group, shared, total, jaccard of the multisets of members: sums of least and of greatest counts; 1 if both are empty."""
    n = [x.groupBy(group, member).agg(F.count(F.lit(1)).alias(c)) for x, c in ((a, "na"), (b, "nb"))]
    both = n[0].join(n[1], [group, member], "full").na.fill(0, ["na", "nb"])
    out = both.groupBy(group).agg(F.sum(F.least("na", "nb")).alias("shared"), F.sum(F.greatest("na", "nb")).alias("total"))
    return out.withColumn("jaccard", F.when(F.col("total") == 0, 1.0).otherwise(F.col("shared") / F.col("total")))


def path_rollup(leaves: DataFrame, levels: list[str], own: str) -> DataFrame:
    """path, level, inclusive: for each prefix of the levels the sum of what lies below it and its own."""
    out = leaves.rollup(*levels).agg(F.sum(own).alias("inclusive"), F.grouping_id().alias("g"))
    depth = F.lit(len(levels)) - F.bit_count("g")
    return out.where("g < " + str(2 ** len(levels) - 1)).select(F.concat_ws("/", *levels).alias("path"), depth.cast("long").alias("level"), "inclusive")


def ranked_shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, total, pct of all, rank by total (ties by key). Only one row a key is ranked."""
    a = rows.groupBy(key).agg(F.sum(value).alias("total"))
    whole = F.sum("total").over(Window.partitionBy(F.lit(0)))
    return a.select(key, "total", (F.col("total") * 100.0 / whole).alias("pct"), F.row_number().over(Window.orderBy(F.desc("total"), key)).cast("long").alias("rank"))


def module_shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with own_share of their module's total, and module_share of the module in all. Sums combine before the shuffle, where a window over a hot module would not."""
    t = rows.groupBy(key).agg(F.sum(value).alias("__total"))
    t = t.withColumn("__whole", F.sum("__total").over(Window.partitionBy(F.lit(0))))
    x = rows.join(sent(cut(t)), key)
    return x.withColumns({"own_share": F.col(value) * 100.0 / F.col("__total"), "module_share": F.col("__total") * 100.0 / F.col("__whole")}).drop("__total", "__whole")


def dual_shares(rows: DataFrame, key: str, value: str, wall: Column) -> DataFrame:
    """key, value's sum, duration_pct of a wall span (an aggregate of all rows) and share_pct of all values."""
    a = rows.groupBy(key).agg(F.sum(value).alias(value))
    span = rows.agg(wall.alias("__wall"), F.sum(value).alias("__whole"))
    x = a.crossJoin(F.broadcast(span))  # one row
    return x.select(key, value, (F.col(value) * 100.0 / F.col("__wall")).alias("duration_pct"), (F.col(value) * 100.0 / F.col("__whole")).alias("share_pct"))


def indexed(groups: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """A number from 1 for each of a few groups, in order, nulls last."""
    return groups.withColumn(name, F.row_number().over(Window.orderBy(*[F.asc_nulls_last(c) for c in order])).cast("long"))


def top_listed(counts: DataFrame, group: str, member: str, n: str, k: int) -> DataFrame:
    """group, listed: its k most frequent members as member:n, the most frequent first, joined by ;."""
    top = top_k(counts, [group], [F.desc(n), member], k)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", member, n))), lambda x: F.concat_ws(":", x[member], x[n]))
    return top.groupBy(group).agg(F.array_join(texts, ";").alias("listed"))


def operator_table(rows: DataFrame, keys: list[str], value: str, share: Column, first: str) -> DataFrame:
    """keys, the value's sum, n, mean of the shares that are not 0, and the first row."""
    return rows.groupBy(*keys).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"), F.avg(F.nullif(share, F.lit(0))).alias("mean_share"), F.min(first).alias("first"))
