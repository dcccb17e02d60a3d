"""CSV tables and JSON sidecars as packages hold them: byte-order marks, blanks around names, cells beyond the header, files that may be missing or broken."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells beyond the header that a row may have; more are an error.
BEYOND = 64
#: Sidecars are configuration; larger files are none.
SIDECAR_BYTES = 16_000_000


def _raw(spark: SparkSession, path: str, width: int) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(width))
    return spark.read.schema(schema).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s﻿]+|\s+$", "")


def fields(spark: SparkSession, path: str) -> list[str]:
    """The header of a CSV file, without a byte-order mark and blanks around names."""
    first = spark.read.option("multiLine", True).option("escape", '"').csv(path).limit(1).collect()
    return [(x or "").lstrip("﻿").strip() for x in first[0]] if first else []


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows by the header's names, as trimmed text. Cells beyond the header belong to the last column, joined by the commas that cut them; missing cells are null. Rows that repeat the header are headers of further files."""
    names = fields(spark, path)
    if not names:
        return spark.createDataFrame([], "none string").drop("none")
    n = len(names)
    raw = _raw(spark, path, n + BEYOND + 1)
    cell = lambda i: trimmed(F.col(f"c{i}"))
    rest = F.concat_ws(",", *[F.col(f"c{i}") for i in range(n - 1, n + BEYOND)])
    last = F.when(F.col(f"c{n + BEYOND}").isNotNull(), F.raise_error(F.lit(f"more than {BEYOND} cells beyond the header")).cast("string")).otherwise(F.when(F.col(f"c{n - 1}").isNotNull(), trimmed(rest)))
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & cell(i).eqNullSafe(F.lit(name))
    return raw.where(~same).select(*[cell(i).alias(x) for i, x in enumerate(names[:-1])], last.alias(names[-1]))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def sidecar(spark: SparkSession, path: str | None, strict: bool = False) -> dict:
    """A JSON object out of a file; empty where it is missing or no object, an error then if strict."""
    if path and exists(spark, path):
        row = spark.read.format("binaryFile").load(path).where(F.col("length") <= SIDECAR_BYTES).select("content").first()
        try:
            data = json.loads(bytes(row["content"]).decode("utf-8-sig")) if row else None
        except ValueError:
            data = None
        if isinstance(data, dict):
            return data
    if strict:
        raise ValueError(f"no JSON object in {path}")
    return {}


def artifact(spark: SparkSession, root: str, configured: str | None, name: str) -> str | None:
    """Where a package's file is: in the package by its name, in its metadata folder, then where it was configured, relative to the package or absolute; None if nowhere."""
    base = (configured or "").rpartition("/")[2]
    options = [f"{root}/{x}" for x in dict.fromkeys([name, f"metadata/{name}", *([base, f"metadata/{base}"] if base else [])])]
    if configured:
        options += [configured if configured.startswith("/") or ":" in configured else f"{root}/{configured}"]
    return next((p for p in options if exists(spark, p)), None)


def environment(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """key, value out of an environment table: only the rows that hold one are read, items are cut at ; and at their first =, and the last of equal keys stays."""
    item = F.posexplode(F.split(F.col(value), ";")).alias("at", "item")
    some = rows.where(F.col(name).isin("DeviceEnvironment", "Environment")).select(F.col(name).alias("of"), item)
    x = some.where(F.instr("item", "=") > 1).select(F.substring_index("item", "=", 1).alias("key"), F.expr("substring(item, instr(item, '=') + 1)").alias("value"), F.struct((F.col("of") == "Environment").alias("o"), "at").alias("ord"))
    return x.groupBy("key").agg(F.max_by("value", "ord").alias("value"))
