"""Streams with state of their own: tails of logs, stretches of busy time, and the units that follow a template.

State is kept for each key by Spark (RocksDB), written with every micro-batch, and found again by whatever executor
goes on. It is bounded: a log's is five numbers, a lane's the stretches that an interval could still reach, a lane's open unit
the rows since its last marker. Streams run until all input that is there is used up; what a watermark still holds back
then comes out by a last row in a far future, on a key of its own.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lanespan.sources.scratch import cut, folder

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKER = "[log is full]"
#: Bytes of the units' table that a micro-batch takes. Files are as many as tasks and may be small, and each batch writes the state of all partitions.
BYTES = 128 << 20
#: Microseconds that the last row of a stream lies behind all others.
FAR = 10 * 365 * 86_400_000_000


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings that a stream takes when it starts."""
    before = {n: spark.conf.get(n, None) for n in values}
    for n, v in values.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def new_folder(spark: SparkSession) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def arrivals(df: DataFrame, batch: str, batches: int) -> DataFrame:
    """df as a stream: the rows of batch 0, 1, ... arrive one micro-batch after the other. They are computed once, by many tasks; a batch is one file, so that no batch takes part of another."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df = cut(df)
    for k in range(batches):
        df.where(F.col(batch) == k).drop(batch).repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop(batch).schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, mode: str = "append", by_clock: bool = False) -> DataFrame:
    """Run a stream over all that is there into a table of the shared folder, and read that. In update mode the table holds each row's versions by `batch`. State that expires by the clock (by_clock) would have batches without data run for ever, so it has none."""
    spark, root = stream.sparkSession, new_folder(stream.sparkSession)
    schema = stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True)
    with settings(spark, **{STORE: ROCKS, NO_DATA: "false" if by_clock else "true"}):
        if mode == "append":
            writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
        else:
            schema = schema.add("batch", "long")
            write = lambda df, k: df.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{root}/out/of={k}")  # noqa: E731  a batch that is tried again writes its own folder again
            writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out").select(*schema.names)


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each row of an update stream's table."""
    rest = [c for c in versions.columns if c not in (*keys, "batch")]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__x")).select(*keys, "__x.*")


class Tail(StatefulProcessor):
    """Lines of a log that were not given yet, poll by poll, within a bound.

    A poll sees a log as it is: its size (end) and its lines. If the log is smaller than what was read, it was begun
    again: so is reading, as the next epoch. Of an epoch's lines come those that fit into `most` bytes, then a marker, then no more.
    A log that is not polled for `expiry` milliseconds of processing time is forgotten.
    """

    SCHEMA = "log string, epoch long, offset long, text string"

    def __init__(self, most: int, expiry: int):
        self.most, self.expiry = most, expiry

    def init(self, handle) -> None:
        ttl = {"ttlDurationMs": self.expiry} if self.expiry else {}
        self.state = handle.getValueState("log", "epoch long, cursor long, seen long, kept long, full boolean", **ttl)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        epoch, cursor, seen, kept, full = self.state.get() if self.state.exists() else (0, 0, 0, 0, False)
        got = pd.concat(list(rows)).sort_values(["poll", "offset"], kind="stable", na_position="first")
        out = []
        for _, poll in got.groupby("poll", sort=True):
            end = int(poll["end"].max())
            if end < seen:
                epoch, cursor, kept, full = epoch + 1, 0, 0, False
            seen = end
            for offset, size, text in zip(poll["offset"], poll["size"], poll["text"], strict=True):
                if pd.isna(offset) or offset < cursor:
                    continue
                cursor = int(offset) + int(size)
                if not full:
                    full = kept + int(size) > self.most
                    kept += int(size)
                    out.append((key[0], epoch, int(offset), MARKER if full else text))
                    full |= kept >= self.most
        self.state.update((epoch, cursor, seen, kept, full))
        yield pd.DataFrame(out, columns=["log", "epoch", "offset", "text"])

    def close(self) -> None:
        pass


def tail(polls: DataFrame, most: int, expiry: int = 0) -> DataFrame:
    """log, epoch, offset, text as a stream, of a stream of polls (log, poll, end, offset, size, text; offset is null where a poll saw an empty log)."""
    return polls.groupBy("log").transformWithStateInPandas(Tail(most, expiry), Tail.SCHEMA, "append", "processingTime" if expiry else "none")


def tail_of(polls: DataFrame, most: int) -> DataFrame:
    """The same of a batch: an epoch begins where a poll sees less than the one before, and gives the lines beyond what its polls saw before."""
    from lanespan.operators.segments import along
    from lanespan.streaming.logs import bounded

    seen = polls.groupBy("log", "poll").agg(F.max("end").alias("end"))
    seen = along(seen, ["log"], ["poll"], befores={"before": F.col("end")})
    shrunk = F.coalesce((F.col("end") < F.col("before")), F.lit(False))
    seen = along(seen.withColumn("shrunk", shrunk), ["log"], ["poll"], sums={"epoch": F.col("shrunk").cast("long")})
    at = seen.select("log", "poll", "epoch", F.when(F.col("shrunk"), 0).otherwise(F.coalesce("before", F.lit(0))).alias("cursor"))
    lines = polls.join(at, ["log", "poll"]).where("offset >= cursor")
    # bounded() adds a line break to each text; a line's size is given here, so it works on a stand-in of that size.
    lines = lines.select(F.struct("log", "epoch").alias("log"), F.col("offset").alias("ord"), "text", F.expr("repeat('x', cast(size - 1 as int))").alias("sized"))
    kept = bounded(lines.select("log", "ord", F.col("sized").alias("text")), most, MARKER).withColumnRenamed("text", "got")
    out = kept.join(lines, ["log", "ord"])
    return out.select("log.log", "log.epoch", F.col("ord").alias("offset"), F.when(F.col("got") == MARKER, F.lit(MARKER)).otherwise(F.col("text")).alias("text"))


class Busy(StatefulProcessor):
    """Maximal busy stretches of a lane, as a sorted set that late intervals still join; a stretch is given when the watermark is beyond its end."""

    SCHEMA = "lane long, s long, e long, n long, busy long"

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "s long", "e long, n long, busy long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held = sorted((s[0], *x) for s, x in self.open.iterator())
        new = sorted((int(s), int(e)) for b in rows for s, e in zip(b["s"], b["e"], strict=True) if e > s)
        merged: list[list[int]] = []
        for s, e, n, busy in sorted([*held, *((s, e, 1, e - s) for s, e in new)]):
            if merged and s <= merged[-1][1]:
                last = merged[-1]
                merged[-1] = [last[0], max(last[1], e), last[2] + n, last[3] + busy]
            else:
                merged.append([s, e, n, busy])
        before, after = {x[0]: tuple(x[1:]) for x in held}, {x[0]: tuple(x[1:]) for x in merged}
        for s in before.keys() - after.keys():
            self.open.removeKey((s,))
        for s, x in after.items():
            if before.get(s) != x:
                self.open.updateValue((s,), x)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if after:
            self.handle.registerTimer(self.due(min(x[0] for x in after.values())))
        yield pd.DataFrame(columns=["lane", "s", "e", "n", "busy"]).astype("int64")

    @staticmethod
    def due(end: int) -> int:
        """Milliseconds at which nothing that starts at `end` microseconds can come any more."""
        return end // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now, out, left = timerValues.getCurrentWatermarkInMs(), [], []
        for (s,), (e, n, busy) in sorted(self.open.iterator()):
            if self.due(e) <= now:
                out.append((key[0], s, e, n, busy))
            else:
                left.append(e)
        for x in out:
            self.open.removeKey((x[1],))
        if left:
            self.handle.registerTimer(self.due(min(left)))
        yield pd.DataFrame(out, columns=["lane", "s", "e", "n", "busy"])

    def close(self) -> None:
        pass


def busy_stretches(rows: DataFrame, late: str) -> DataFrame:
    """lane, s, e, n, busy as a stream: what islands() gives for lane, s, e of a stream with a column ts, the time s. An interval may come late by `late`."""
    return rows.withWatermark("ts", late).groupBy("lane").transformWithStateInPandas(Busy(), Busy.SCHEMA, "append", "eventTime")


def with_end(rows: DataFrame, batch: str, batches: int, lane: str) -> tuple[DataFrame, int]:
    """Rows in batches, with a last one that takes the watermark beyond all of them, and the number of batches. Its lane is -1 and its interval is empty."""
    far = rows.agg(F.max(F.greatest("s", "e")).alias("s")).select(F.lit(-1).cast("long").alias(lane), (F.col("s") + FAR).alias("s"))
    far = far.withColumns({"e": F.col("s"), batch: F.lit(batches)}).withColumn("ts", F.timestamp_micros("s"))
    return rows.withColumn("ts", F.timestamp_micros("s")).select(*far.columns).unionByName(far.where("s is not null")), batches + 1


class Units(StatefulProcessor):
    """Rows of a lane in order, cut into units by markers; a unit is given when the next marker ends it, each row with a digest of the unit's names, its template."""

    SCHEMA = "lane long, unit long, template string, pos long, d long"

    def init(self, handle) -> None:
        self.unit = handle.getValueState("unit", "number long, names string, at long, id long")
        self.rows = handle.getListState("rows", "d long")

    def handleInputRows(self, key, rows, timerValues):
        import hashlib

        import pandas as pd

        number, names, at, id_ = self.unit.get() if self.unit.exists() else (-1, "", None, None)
        got = pd.concat(list(rows)).sort_values(["s", "id"], kind="stable")
        held = [r[0] for r in self.rows.get()] if self.rows.exists() else []
        out = []
        for s, i, name, e, marks in zip(got["s"], got["id"], got["name"], got["e"], got["marks"], strict=True):
            if at is not None and (s, i) < (at, id_):
                raise ValueError(f"lane {key[0]}: a row came after one that is later in order")
            at, id_ = int(s), int(i)
            if marks:
                if number >= 0:
                    digest = hashlib.sha256(names.encode()).hexdigest()
                    out += [(key[0], number, digest, p, d) for p, d in enumerate(held)]
                number, names, held = number + 1, "", []
            if number >= 0:
                names += ">" * bool(held) + name
                held.append(int(e) - int(s))
        self.unit.update((number, names, at, id_))
        self.rows.put([(d,) for d in held]) if held else self.rows.clear()
        yield pd.DataFrame(out, columns=["lane", "unit", "template", "pos", "d"])

    def close(self) -> None:
        pass


def units(rows: DataFrame) -> DataFrame:
    """lane, unit, template, pos, d as a stream, of a stream of lane, s, id, name, e and marks (whether a unit begins with the row). Batches have to come in order of time."""
    return rows.groupBy("lane").transformWithStateInPandas(Units(), Units.SCHEMA, "append", "none")


def template_stats(written: DataFrame) -> DataFrame:
    """template, pos, n, low, high, mean as a stream, of a stream of units' rows: counts, bounds and means are the state, no unit is kept."""
    d = F.col("d")
    return written.groupBy("template", "pos").agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("low"), F.max(d).alias("high"), F.avg(d).alias("mean"))


def accepted(rows: DataFrame) -> DataFrame:
    """template, pos, n, low, high, mean of all units that the stream of rows has closed: one stream cuts the units, a second follows its table."""
    spark, out = rows.sparkSession, drained(units(rows))
    path = out.inputFiles()[0].rpartition("/")[0] if out.inputFiles() else None
    if path is None:
        return spark.createDataFrame([], "template string, pos long, n long, low long, high long, mean double")
    table = spark.readStream.schema(out.schema).option("maxBytesPerTrigger", BYTES).parquet(path)
    return latest(drained(template_stats(table), "update"), ["template", "pos"])
