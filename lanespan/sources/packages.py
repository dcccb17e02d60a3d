"""Packages of result tables: discovery, safe import of archives, fingerprints, layout."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of the tables of a package, spelled as they are in the files.
SUFFIXES = ["_origin_table.csv", "_opreator_table.csv", "_core_compute_table.csv", "_auxiliary_operator_table.csv", "_op_classification_table.csv", "_stage_table.csv"]
LARGEST = 100 << 30


def prefixes(names: list[str]) -> list[str]:
    """Prefixes for which all tables are there."""
    found = {n.removesuffix(s) for n in names for s in SUFFIXES if n.endswith(s)}
    return sorted(p for p in found if all(p + s in names for s in SUFFIXES))


def table_sets(files: DataFrame) -> DataFrame:
    """prefix, complete over a frame of file names (name)."""
    suffix = F.get(F.array_sort(F.filter(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.col("name").endswith(s))), F.lit(0))
    x = files.withColumn("suffix", suffix).where("suffix is not null")
    return x.groupBy(F.expr("left(name, length(name) - length(suffix))").alias("prefix")).agg((F.size(F.collect_set("suffix")) == len(SUFFIXES)).alias("complete"))


def unpack(archive: str, into: str, largest: int = LARGEST) -> Path:
    """Extract an archive and return the folder that holds its tables. Links, absolute paths, ways out of the folder and too much data are refused."""
    target = Path(into)
    with zipfile.ZipFile(archive) as z:
        if sum(i.file_size for i in z.infolist()) > largest:
            raise ValueError("the archive is too large")
        for i in z.infolist():
            p = PurePosixPath(i.filename.replace("\\", "/"))
            if p.is_absolute() or ".." in p.parts or re.match(r"^[A-Za-z]:", i.filename):
                raise ValueError(f"a path leads out of the archive: {i.filename}")
            if (i.external_attr >> 16) & 0o170000 == 0o120000:
                raise ValueError(f"a link in the archive: {i.filename}")
        z.extractall(target)
    roots = sorted({Path(d) for d, _, names in os.walk(target) if prefixes(names)})
    if len(roots) != 1:
        raise ValueError(f"{len(roots)} folders of the archive hold complete tables")
    return roots[0]


def fingerprint(path: str) -> dict:
    """Size, and digest of the first MiB."""
    with open(path, "rb") as f:
        return {"bytes": os.path.getsize(path), "sha256_head": hashlib.sha256(f.read(1 << 20)).hexdigest()}


def fingerprints(spark: SparkSession, glob: str) -> DataFrame:
    """The same for files in any store that Spark reads."""
    b = spark.read.format("binaryFile").load(glob)
    return b.select("path", F.col("length").alias("bytes"), F.sha2(F.substring("content", 1, 1 << 20), 256).alias("sha256_head"), "modificationTime")


def newest(files: DataFrame, suffixes: list[str]) -> str | None:
    """Path of the newest file with the first suffix that any has."""
    rank = F.coalesce(*[F.when(F.col("path").endswith(s), F.lit(i)) for i, s in enumerate(suffixes)])
    r = files.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc("modificationTime"), "path").select("path").first()
    return r[0] if r else None


def laid_out(root: str, trace: str | None = None) -> dict[str, list[str]]:
    """Move a package's files into csv, xlsx, metadata and trace; again does nothing more. Returns what lies where."""
    base = Path(root)
    kinds = {".csv": "csv", ".xlsx": "xlsx", ".json": "metadata"}
    for d in ("csv", "xlsx", "metadata", "trace"):
        (base / d).mkdir(parents=True, exist_ok=True)
    for p in sorted(base.iterdir()):
        if p.is_file() and p.suffix in kinds:
            p.replace(base / kinds[p.suffix] / p.name)
    if trace and not (base / "trace" / Path(trace).name).exists():
        shutil.copy2(trace, base / "trace")
    return {d: sorted(x.name for x in (base / d).iterdir()) for d in ("csv", "xlsx", "metadata", "trace")}
