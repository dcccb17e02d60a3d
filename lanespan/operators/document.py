"""What the analysis document and its views are made of: keys, shares, rankings, labels and choices, as frames and expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The classes of operators and their labels, in the order of the document.
CLASSES = {"core": "核心计算", "communication": "通信", "auxiliary": "辅助算子"}
# The pattern row's unit, and labels of durations.
PATTERN = "__pattern_total__"
CYCLE, MEAN_UNIT, UNIT = "结构周期耗时", "平均结构单元耗时", "结构单元耗时"
# Names under which a number of samples is told, in order of precedence.
SAMPLE_KEYS = ["accepted_unit_count", "accepted_full_template_sample_count", "accepted_occurrence_count", "accepted_sample_count", "accepted_samples"]
SAMPLE_BLOCKS = ["sampling", "stable_statistics", "stable_aggregation", "stable_stats"]


def filled(c) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def stage_key(position: Column, unit: Column, variant: Column, name: Column) -> Column:
    """position::unit::variant::name without empty parts; the pattern's rows go by their bare name."""
    return F.when(F.coalesce(unit == PATTERN, F.lit(False)), name).otherwise(F.concat_ws("::", filled(position), filled(unit), filled(variant), filled(name)))


def class_shares(rows: DataFrame, total: float | Column, keys: list[str] | None = None) -> DataFrame:
    """keys, ord, name, count, duration, duration_pct of the unit's wall span, and share_pct of the three classes together; classes without operators too."""
    keys = keys or []
    sums = [F.struct(F.lit(i).alias("ord"), F.lit(label).alias("name"), F.count_if(F.col("category") == c).alias("count"), F.sum(F.when(F.col("category") == c, F.coalesce("duration", F.lit(0.0))).otherwise(0.0)).alias("duration")) for i, (c, label) in enumerate(CLASSES.items(), 1)]
    whole = F.sum(F.when(F.col("category").isin(*CLASSES), F.coalesce("duration", F.lit(0.0))).otherwise(0.0)).alias("whole")
    g = rows.groupBy(*keys).agg(F.array(*sums).alias("x"), whole).select(*keys, "whole", F.explode("x").alias("x")).select(*keys, "x.*", "whole")
    total = F.lit(total) if not isinstance(total, Column) else total
    share = F.when(F.col("whole") > 0, F.col("duration") / F.col("whole") * 100).otherwise(0.0)
    return g.select(*keys, "ord", "name", "count", "duration", (F.col("duration") / total * 100).alias("duration_pct"), share.alias("share_pct"))


def folded(rows: DataFrame, name: str, order: str, sums: list[str]) -> DataFrame:
    """One row a name over all regions, in the order in which names appear first."""
    g = rows.groupBy(name).agg(F.min(order).alias("__first"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums])
    return g.withColumn("ord", F.row_number().over(Window.orderBy("__first"))).drop("__first")  # a row a class


def renumbered(rows: DataFrame, groups: str, order: list[str], kind: str = "kind") -> DataFrame:
    """rows with number: plain rows count on over all groups (in their order), pattern rows count as P1, P2, ... on, totals have none."""
    n = rows.groupBy(groups, kind).agg(F.count(F.lit(1)).alias("n"))
    before = n.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(kind).orderBy(groups).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    k = F.row_number().over(Window.partitionBy(groups, kind).orderBy(*order)) + F.col("base")
    return rows.join(before, [groups, kind]).withColumn("k", k).withColumn("number", F.when(F.col(kind) == "row", F.col("k").cast("string")).when(F.col(kind) == "pattern", F.concat(F.lit("P"), F.col("k").cast("string")))).drop("k", "base")


def primary_duration(variants: Column, layers: Column, mean: Column, total: Column) -> Column:
    """struct(label, duration, heterogeneous): a cycle of several variants counts as a whole, several layers of one variant by their mean (the total by the layers where none is told), one layer as it is."""
    mean = F.coalesce(mean, F.when(layers > 0, total / layers))
    several = F.coalesce(variants > 1, F.lit(False))
    label = F.when(several, CYCLE).when(layers > 1, MEAN_UNIT).otherwise(UNIT)
    value = F.when(~several & (layers > 1), F.coalesce(F.nullif(mean, F.lit(0.0)), total)).otherwise(total)
    return F.struct(label.alias("label"), value.alias("duration"), several.alias("heterogeneous"))


def kernel_table(rows: DataFrame, pattern_us: float | Column, most: int, keys: list[str] | None = None) -> DataFrame:
    """keys, rank, name, modules, duration, pct, overlap_pct, n: kernels by their time; overlap is weighted by duration, modules are listed by what they contribute."""
    keys = keys or []
    part = rows.groupBy(*keys, "name", "module").agg(F.sum("duration").alias("d"), F.sum(F.col("duration") * F.coalesce("overlap_pct", F.lit(0.0))).alias("w"), F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.when(F.coalesce(F.col("module") != "", F.lit(False)), F.struct((-F.col("d")).alias("neg"), "module"))))
    g = part.groupBy(*keys, "name").agg(F.sum("d").alias("duration"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.array_join(F.transform(listed, lambda x: x["module"]), "、").alias("modules"))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("duration"), "name"))).where(F.col("rank") <= most)
    total = F.lit(pattern_us) if not isinstance(pattern_us, Column) else pattern_us
    overlap = F.when(F.col("duration") != 0, F.col("w") / F.col("duration")).otherwise(0.0)
    return g.select(*keys, "rank", "name", "modules", "duration", (F.col("duration") / total * 100).alias("pct"), overlap.alias("overlap_pct"), "n")


def best_shares(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, operators, max_mfu, max_mbu; values that are missing count as 0."""
    return rows.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("operators"), F.max(F.coalesce("mfu", F.lit(0.0))).alias("max_mfu"), F.max(F.coalesce("mbu", F.lit(0.0))).alias("max_mbu"))


def hot_order(keys: list[str]):
    """Longest first, then by time and index."""
    return Window.partitionBy(*keys).orderBy(F.desc("duration"), "start", "idx")


def view_rank(keys: list[str], by_time: bool):
    """Rank in a view: of all operators by start and index; of one category by duration, the longest first, then by start."""
    order = [F.col("start"), F.col("idx")] if by_time else [F.desc("duration"), F.col("start"), F.col("idx")]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def natural(c: Column) -> list[Column]:
    """Sort keys of names that end in a number: the name before it, then the number by its value."""
    return [F.regexp_extract(c, r"^(.*?)(\d*)$", 1), F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("long"), F.lit(-1))]


def chosen_device(anchors: DataFrame, per_forward: int) -> DataFrame:
    """The device (device, n) whose anchors are whole forwards, of these that with most anchors, and of equal ones the first."""
    exact = (F.col("n") % per_forward == 0) & (F.col("n") > 0)
    return anchors.agg(F.max(F.struct(exact.alias("exact"), F.col("n").alias("n"), (-F.col("device")).alias("neg"))).alias("x")).where("x is not null").select((-F.col("x.neg")).alias("device"), "x.n", "x.exact")


def prefix_total(columns: list[str], prefix: str) -> Column:
    """Sum of the column of that name and of those that begin with it and _."""
    own = [F.coalesce(F.col(c), F.lit(0)) for c in columns if c == prefix or c.startswith(f"{prefix}_")]
    return reduce(lambda a, b: a + b, own, F.lit(0))


def above(rows: DataFrame, keys: list[str], value: str, least: float = 0.5) -> DataFrame:
    """keys, total: groups whose total is no less than least."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("total")).where(F.col("total") >= least)


def dispatch_cache(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, kernel, file_line, function, submodules, layers, launches, total_us, resolved: once for each kernel name. Rows have ord; what is told first counts, a location being told where it is not empty."""
    keys = keys or []
    told = F.min(F.when(F.coalesce(F.col("file_line") != "", F.lit(False)), F.struct("ord", "file_line", "function")))
    parts = F.array_sort(F.collect_set(F.struct(F.col("sub_ord"), "submodule")))
    first = rows.withColumn("sub_ord", F.min("ord").over(Window.partitionBy(*keys, "kernel", "submodule")))
    g = first.groupBy(*keys, "kernel").agg(told.alias("t"), F.transform(parts, lambda x: x["submodule"]).alias("submodules"), F.countDistinct("layer").alias("layers"), F.count(F.lit(1)).alias("launches"), F.round(F.sum("time_us"), 3).alias("total_us"), F.min(F.struct("ord", "function")).alias("f"))
    return g.select(*keys, "kernel", F.coalesce("t.file_line", F.lit("")).alias("file_line"), F.coalesce("t.function", "f.function").alias("function"), "submodules", "layers", "launches", "total_us", F.col("t").isNotNull().alias("resolved"))


def repeating_label(unit: Column, parts: Column, told: Column) -> Column:
    """A unit's own text, else the descriptions of its parts joined by +, else what is told, else one complete repeating unit."""
    some = F.filter(parts, lambda x: F.coalesce(x != "", F.lit(False)))
    return F.coalesce(filled(unit), F.when(F.size(some) > 0, F.array_join(some, " + ")), filled(told), F.lit("one complete repeating unit"))


def peak_label(told: Column, tflops: Column) -> Column:
    return F.coalesce(told, F.when(tflops.isNotNull(), F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", tflops), r"0+$", ""), r"\.$", ""), F.lit(" TFLOPS/GPU effective dense peak"))))


def sample_count(stats: Column, manifest: dict[str, Column]) -> Column:
    """The number of samples: of the sidecar, then of the manifest's blocks in order, the first key that tells one. All are maps of text to numbers; null if none tells."""
    sources = [stats, *[manifest[b] for b in SAMPLE_BLOCKS if b in manifest]]
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for m in sources for k in SAMPLE_KEYS]).cast("long")


def ordered_distinct(values: Column) -> Column:
    """Values of an array, each where it stands first."""
    return F.array_distinct(values)


def dispatch_frame(chain: Column, wanted: str) -> Column:
    """Of a chain of frames file.py(12): name the last whose file holds the wanted text, else the last that names a place, else the last."""
    names_place = lambda x: x.rlike(r"^.+?\(\d+\):\s*.+$")
    own = F.filter(chain, lambda x: names_place(x) & F.regexp_extract(x, r"^(.+?)\(\d+\):", 1).contains(wanted)) if wanted else F.array().cast("array<string>")
    last = lambda a: F.get(a, F.size(a) - 1)
    return F.coalesce(last(own), last(F.filter(chain, names_place)), last(chain))


def operator_json(index: Column, name: Column, category: Column, module: Column, key: Column, start: Column, duration: Column, mfu: Column, mbu: Column) -> Column:
    """An operator of the document as JSON; missing values are left out."""
    fields = {"index": index, "name": name, "category": category, "module": module, "stageKey": key, "startNs": start, "durationUs": duration, "mfu": mfu, "mbu": mbu}
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
