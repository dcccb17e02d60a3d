"""Helpers shared by the training-data operators.

Words are defined on bytes: every byte of a non-ASCII UTF-8 character is a word byte, so ASCII rules
can be applied to the encoded text without decoding it.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte table that lower-cases A-Z and nothing else.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with every ASCII byte that is neither a letter nor a digit made a blank.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+; bytes.split() breaks at exactly these six bytes."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    return text.translate(ALNUM).split()


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; a local one is set only where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        root = os.path.join(tempfile.gettempdir(), "lanespan-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    _SCRATCH.append(f"{root.rstrip('/')}/lanespan-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


#: Folders that this process has made.
_SCRATCH: list[str] = []


def sweep(spark: SparkSession, needed: DataFrame | None = None) -> None:
    """Delete the scratch folders made so far, but for those that `needed` reads. Results that were not written yet are lost, so this is for a caller who has written them."""
    reads = needed.inputFiles() if needed is not None else []
    # Broadcast tables and plans of what was written are garbage in the driver; its heap gives their room back before it takes more.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(_SCRATCH):
        if not any(path.rpartition("/")[2] in f for f in reads):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            _SCRATCH.remove(path)


#: Shards of the packed operators: a shard holds what SHARD_CHARS characters of text give, however many there are.
SHARD_CHARS = 24_000_000


def shards_for(chars: int) -> int:
    """Shards grow with the text. A block sends a row to each shard that it has entries for, so no more rows than it has entries."""
    return int(max(8, chars // SHARD_CHARS))


def stash(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and the rows are fixed from here on.

    Meanwhile Arrow batches are small, as rows here hold whole texts and packed arrays. What was shuffled for it is deleted
    at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = {c: spark.conf.get(c) for c in (ARROW_ROWS, CLEAN)}
    spark.conf.set(ARROW_ROWS, str(min(int(before[ARROW_ROWS]) if int(before[ARROW_ROWS]) > 0 else BATCH_ROWS, BATCH_ROWS)))
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; known keeps those that were met."""
    import xxhash

    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; unpack() needs their kinds."""
    import struct

    import zstandard

    head = struct.pack(f"<{len(arrays)}Q", *(a.nbytes for a in arrays))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import struct

    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, struct.unpack_from(f"<{len(kinds)}Q", raw), strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def sent(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df, sent to all executors if it has no more than so many rows; else its joins are shuffled."""
    return F.broadcast(df) if rows <= most else df


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: of each node of the undirected edges, the smallest node that it is connected with.

    Each round hangs every node on its smallest neighbour, follows these pointers to their roots by doubling, and
    contracts the edges to roots; what connects roots is the next round's graph, at most half as large in nodes and most
    often all but empty. Self-loops and repeated edges do no harm.
    """
    left = stash(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x < y").distinct())
    labels = None
    while left.limit(1).count():
        ways = left.select(F.col("x").alias("node"), F.col("y").alias("near")).unionByName(left.select(F.col("y").alias("node"), F.col("x").alias("near")))
        up = stash(ways.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("root")))
        while True:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = stash(up.join(step, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            up = new.select("node", "root")
            if new.where("moved").limit(1).count() == 0:
                break
        ends = [up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "xy"]
        left = left.join(ends[0], "x").join(ends[1], "y").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y"))
        left = stash(left.where("x < y").distinct())
        if labels is None:
            labels = up.select("node", F.col("root").alias("label"))
        else:
            higher = up.select(F.col("node").alias("label"), F.col("root").alias("higher"))
            labels = stash(labels.join(higher, "label", "left").select("node", F.coalesce("higher", "label").alias("label")))
    if labels is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("label")).limit(0)
    return labels


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, least: int) -> DataFrame:
    """rows joined with their group's columns. Groups of at least so many rows are few, and are sent to all executors; the others are joined by key."""
    large = F.broadcast(groups.where(F.col(size) >= least))
    return rows.join(large, keys).unionByName(rows.join(large.select(*keys), keys, "left_anti").join(groups.where(F.col(size) < least), keys))


#: Ids of rows to drop are sent to all executors up to this number; beyond it the rows are joined by id.
SENT_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not among gone (one column); null ids stay. With few ids the texts stay where they are."""
    gone = stash(gone.select(F.col(gone.columns[0]).alias("__gone")).where("__gone is not null").distinct())
    return docs.join(sent(gone, gone.count(), SENT_IDS), docs[id_col] == gone["__gone"], "left_anti")
