"""Capture metadata: attribute rows made into commands and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def argv(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """process, argv of rows PROCESS_n:COMMAND and PROCESS_n:ARGUMENT_i; arguments end before the first number that is missing."""
    process = F.regexp_extract(name, r"^PROCESS_(\d+):", 1)
    index = F.when(F.col(name).endswith(":COMMAND"), F.lit(-1)).otherwise(F.regexp_extract(name, r":ARGUMENT_(\d+)$", 1).try_cast("int"))
    x = rows.where(process != "").select(process.cast("long").alias("process"), index.alias("i"), F.col(value).alias("v")).where("i is not null")
    place = F.sum((F.col("i") >= 0).cast("int")).over(Window.partitionBy("process").orderBy("i"))
    x = x.withColumn("place", place - 1).where("i < 0 or i = place")
    return x.groupBy("process").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda a: a["v"]).alias("argv"))


def server_args(text, keys: list[str]):
    """Values of key=value pairs in a printed object, as text without quotes; null where a key is absent or None."""
    out = []
    for k in keys:
        v = F.trim(F.regexp_extract(text, rf"\b{k}=('[^']*'|\"[^\"]*\"|[^,()]+)", 1))
        out.append(F.nullif(F.nullif(F.regexp_replace(v, "^['\"]|['\"]$", ""), F.lit("")), F.lit("None")).alias(k))
    return out


def conflicts(captured: DataFrame, declared: DataFrame, key: str = "key", value: str = "value", missing: bool = False) -> DataFrame:
    """key, captured, declared, status where both are present and differ (conflict); with missing those too that one side lacks, if the other has a value."""
    a, b = (x.select(key, F.col(value).alias(n), F.lit(True).alias(f"__{n}")) for x, n in ((captured, "captured"), (declared, "declared")))
    status = F.when(F.col("__captured").isNull(), "only_declared").when(F.col("__declared").isNull(), "only_captured").otherwise("conflict")
    both = a.join(b, key, "full" if missing else "inner").where(~F.col("captured").eqNullSafe(F.col("declared")))
    return both.select(key, "captured", "declared", status.alias("status"))
