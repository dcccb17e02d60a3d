"""Kernel activity out of SQLite exports, as a Python data source that reads ranges of rows of a device and a window of time."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KERNELS, STRINGS = "CUPTI_ACTIVITY_KIND_KERNEL", "StringIds"
#: Columns a capture may lack, with what stands for them.
OPTIONAL = {"gridX": "1", "gridY": "1", "gridZ": "1", "blockX": "1", "blockY": "1", "blockZ": "1", "streamId": "0", "correlationId": "NULL", "demangledName": "NULL"}


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def columns_of(con: sqlite3.Connection, table: str) -> list[str]:
    return [r[1] for r in con.execute(f'PRAGMA table_info("{table}")')]


def missing_tables(path: str, needed: tuple = (KERNELS, STRINGS)) -> list[str]:
    with opened(path) as con:
        there = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
    return [t for t in needed if t not in there]


#: Rows of the file, in the order of their ids, that a task reads.
ROWS = 2_000_000


class Rows(InputPartition):
    """Rows whose ids lie from lo to hi; all rows where there are no ids."""

    def __init__(self, lo: int | None = None, hi: int | None = None):
        self.lo, self.hi = lo, hi


class KernelReader(DataSourceReader):
    """where: conditions and their values, answered by the file.

    They are options and not filters pushed by the optimizer: Spark 4.1 keeps one reader for a loaded frame, so what one plan of the
    frame pushes would stay for its other plans.
    """

    def __init__(self, path: str, where: list[tuple[str, int]], rows: int):
        self.path, self.where, self.rows = path, where, rows

    def partitions(self):
        with opened(self.path) as con:
            try:
                lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {KERNELS}").fetchone()
            except sqlite3.OperationalError:  # a table without ids, or a view
                return [Rows()]
        return [Rows(k, min(k + self.rows - 1, hi)) for k in range(lo, hi + 1, self.rows)] if lo is not None else [Rows()]

    def read(self, part: Rows):
        with opened(self.path) as con:
            there = columns_of(con, KERNELS)
            graph = next((c for c in ("graphId", "graphNodeId") if c in there), "NULL")
            own = [c if c in there else d for c, d in OPTIONAL.items()]
            asked = [*self.where, *([("rowid >= ?", part.lo), ("rowid <= ?", part.hi)] if part.lo is not None else [])]
            where = f"WHERE {' AND '.join(c for c, _ in asked)}" if asked else ""
            yield from con.execute(f"SELECT start, end, deviceId, shortName, {graph}, {', '.join(own)} FROM {KERNELS} {where}", [v for _, v in asked])


class KernelSource(DataSource):
    """format("kernel_sqlite"), options path, device, since and until (only kernels that overlap [since, until)), and rows. A partition for each range of row ids, in no order. The file must be readable on the executors."""

    @classmethod
    def name(cls) -> str:
        return "kernel_sqlite"

    def schema(self) -> str:
        return "start long, end long, device int, short_id long, graph_id long, " + ", ".join(f"{c} long" for c in OPTIONAL)

    def reader(self, schema) -> KernelReader:
        asked = {"device": "deviceId = ?", "since": "end > ?", "until": "start < ?"}
        where = [(c, int(self.options[n])) for n, c in asked.items() if self.options.get(n) is not None]
        return KernelReader(self.options["path"], where, int(self.options.get("rows", ROWS)))


class DictionaryReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, part):
        with opened(self.path) as con:
            yield from con.execute(f"SELECT id, value FROM {STRINGS}")


class DictionarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strings_sqlite"

    def schema(self) -> str:
        return "id long, value string"

    def reader(self, schema) -> DictionaryReader:
        return DictionaryReader(self.options["path"])


def kernels(spark: SparkSession, path: str, device: int | None = None, name_mode: str = "short", window: tuple[int, int] | None = None, rows: int = ROWS) -> DataFrame:
    """Kernels with name (short, or demangled where there is one), device, stream, s, e, name, short_name and geometry.

    A kernel without an entry in the dictionary keeps a null name. A device, and a window [since, until) that kernels have to overlap, are looked up in the file.
    """
    if gone := missing_tables(path):
        raise ValueError(f"tables are missing: {', '.join(gone)}")
    for source in (KernelSource, DictionarySource):
        spark.dataSource.register(source)
    read = spark.read.format("kernel_sqlite").option("path", path).option("rows", str(rows))
    options = ({"device": device} if device is not None else {}) | (dict(zip(("since", "until"), window, strict=True)) if window else {})
    k = read.options(**{n: str(v) for n, v in options.items()}).load()
    d = spark.read.format("strings_sqlite").option("path", path).load()
    short, long = (d.select(F.col("id").alias(f"{n}_k"), F.col("value").alias(f"{n}_name")) for n in ("short", "long"))
    out = k.join(short, F.col("short_id") == F.col("short_k"), "left").join(long, F.col("demangledName") == F.col("long_k"), "left")
    name = F.coalesce("long_name", "short_name") if name_mode == "demangled" else F.col("short_name")
    return out.select("device", F.col("streamId").alias("stream"), F.col("start").alias("s"), F.col("end").alias("e"), name.alias("name"), "short_name", F.col("long_name").alias("demangled"), "graph_id", "gridX", "gridY", "gridZ", "blockX", "blockY", "blockZ", F.col("correlationId").alias("correlation"))


def for_alignment(spark: SparkSession, path: str, device: int) -> DataFrame:
    """Kernels of a device that have a demangled name, by start and end: name, s, e, stream and place k from 1."""
    k = kernels(spark, path, device, "demangled").where("demangled is not null")
    place = F.row_number().over(Window.partitionBy("device").orderBy("s", "e", "name"))
    return k.select(F.col("demangled").alias("name"), "s", "e", "stream", place.alias("k"))
