"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's bits lie on a ring of bits + 1 segments. If two fingerprints differ in no more than `bits` bits, some
segment begins a chain whose first k segments differ in at most k * bits / (bits + 1) bits, rounded down, for every k: the first
is equal, the first two differ in one bit at most, the first three in two, and so on. Pairs are looked for along these
chains, from every segment on, and only what keeps within the budget all the way round is compared as a whole.

Fingerprints are classes; equal ones are linked without a comparison. At the first step those with the same first
segment meet. Where more than CROWD[0] of them have it, they go on to the next step: each stands under its first two
segments and asks for those that its second segment, as it is or with a bit changed, leads to; likewise for three
segments, the last step, where a crowd is bounded by what the bits left can tell apart. A pair whose chains differ is asked for by one
of its two sides. So the work of a fingerprint stays within bounds whatever segment is frequent, and no pair is left out.
A task gives the links of what it compared as a forest, one row for each fingerprint at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import FOLD, connected, sent, stash, with_group, without

SHINGLE, BITS, SEED = 3, 3, 42
#: Fingerprints with a first segment, and with the first two, beyond which the next segment is looked at.
CROWD = (128, 1024)
#: Questions to one place that go to one task; with more, what stands there is sent to several.
ASKERS = 20_000
#: Rows of a task's group, on average.
SHARD_ROWS = 40_000
SENT_KEYS = 100_000
HOT_SHARE = 1 / 1024


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is in more than half of the XXH64 hashes of the shingles, repeats included; 0 without words."""
    import xxhash

    words = text.translate(FOLD).split()
    if not words:
        return 0
    line, n = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[: len(words) - n]]).tolist()
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(line[lo:hi], seed) for lo, hi in zip(begins, (ends[n - 1 :] - 1).tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def widths(bits: int, first: int = 0) -> list[int]:
    """Bits of the segments, from the ring's segment `first` on."""
    m = bits + 1
    all_ = [64 * (k + 1) // m - 64 * k // m for k in range(m)]
    return all_[first:] + all_[:first]


def turned(f, first: int, bits: int):
    """The fingerprint (a column), turned so that segment `first` comes first."""
    s = sum(widths(bits)[:first])
    return f if s == 0 else F.shiftleft(f, s).bitwiseOR(F.shiftrightunsigned(f, 64 - s))


def flips(width: int, most: int) -> list[tuple[int, int]]:
    """Masks of a segment with at most so many bits, and their number of bits."""
    return [(sum(1 << p for p in at), k) for k in range(most + 1) for at in combinations(range(width), k)]


class Finder:
    """Compares what stands under a key with what asks for it."""

    def __init__(self, bits: int):
        self.bits = bits

    def within(self, first: int, diff: np.ndarray) -> np.ndarray:
        """Which differences of turned fingerprints keep to the budget along the chain, and as a whole."""
        left, used = np.arange(len(diff)), 0
        for k, w in enumerate(widths(self.bits, first), 1):
            used += w
            left = left[np.bitwise_count(diff[left] >> np.uint64(64 - used)) <= k * self.bits // (self.bits + 1)]
        return left

    def links(self, first: int, stand: tuple[np.ndarray, np.ndarray], ask: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of turned fingerprints that are near: stand is (key, turned), ask is (key, turned, bits spent)."""
        order = np.lexsort((stand[1], stand[0]))
        key, there = stand[0][order], stand[1][order]
        lo, hi = np.searchsorted(key, ask[0], "left"), np.searchsorted(key, ask[0], "right")
        longest = np.argsort(lo - hi, kind="stable")
        lo, hi, own, spent = lo[longest], hi[longest], ask[1][longest], ask[2][longest]
        for d in range(int((hi - lo).max(initial=0))):
            n = int(np.searchsorted(lo - hi, -d))  # those that have a d-th partner stand first
            other = there[lo[:n] + d]
            ok = self.within(first, own[:n] ^ other)
            ok = ok[(spent[ok] > 0) | (own[ok] < other[ok])]  # what has spent nothing is asked for by both sides
            if len(ok):
                yield own[ok], other[ok]

    def forest(self, table: pa.Table) -> pa.Table:
        """a, b: links that connect all that is near within the group."""
        first, key, turn = table["first"].to_numpy(), table["key"].to_numpy(), table["turned"].to_numpy().view(np.uint64)
        asks, spent = table["asks"].to_numpy(), table["spent"].to_numpy()
        tree = Forest()
        for f in np.unique(first).tolist():
            here = first == f
            stand, ask = here & (asks != 1), here & (asks != 0)
            s = np.uint64(sum(widths(self.bits)[:f]))
            for a, b in self.links(f, (key[stand], turn[stand]), (key[ask], turn[ask], spent[ask])):
                tree.add(*((x << (np.uint64(64) - s) | x >> s if s else x) for x in (a, b)))
        a, b = tree.links()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


class Forest:
    """Links, kept as no more than there are ends."""

    MOST = 500_000

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.n += len(a)
        if self.n > self.MOST:
            self.parts = [self.links()]
            self.n = min(len(self.parts[0][0]), self.MOST // 2)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each end with the smallest that it is connected with, by doubling."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        a, b = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(ends))
        while True:
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
            while True:
                new = root[root]
                if np.array_equal(new, root):
                    break
                root = new
        own = np.flatnonzero(root != np.arange(len(ends)))
        return ends[own], ends[root[own]]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def near(classes: DataFrame, bits: int = BITS, crowd: tuple[int, int] = CROWD, askers: int = ASKERS) -> DataFrame:
    """a, b: pairs of the distinct fingerprints fp that differ in no more than `bits` bits, enough to connect all that such pairs connect."""
    if not 1 <= bits <= 7:
        raise ValueError("bits has to be from 1 to 7")
    finder, m = Finder(bits), bits + 1
    head = lambda k: F.element_at(F.array(*[F.lit(64 - sum(widths(bits, f)[:k])) for f in range(m)]), F.col("first") + 1)
    key = lambda k: F.call_function("shiftrightunsigned", F.col("turned"), head(k))
    ring = F.array(*[F.struct(F.lit(f).alias("first"), turned(F.col("fp"), f, bits).alias("turned")) for f in range(m)])
    stand = classes.select(F.inline(ring)).withColumn("key", key(1))
    ask, found = None, []
    for step in range(1, min(3, m) + 1):
        at = ["first", "key"]
        crowds = None
        if step < min(3, m):
            sizes = stand.groupBy(*at).count()
            crowds = stash(sizes.where(F.col("count") > crowd[step - 1]).select(*at))
            n_crowds = crowds.count()
            crowds = sent(crowds, n_crowds, SENT_KEYS) if n_crowds else None
        calm = [x if crowds is None or x is None else x.join(crowds, at, "left_anti") for x in (stand, ask)]
        found.append(compared(*calm, finder, askers))
        if crowds is None:
            break
        stand = stash(stand.join(crowds, at, "left_semi").select("first", "turned").withColumn("key", key(step + 1)))
        asked = ask.join(crowds, at, "left_semi") if ask is not None else stand.withColumn("asked", key(1)).withColumn("spent", F.lit(0))
        if ask is not None:
            asked = asked.withColumnRenamed("key", "asked")
        ask = stash(asked.select("first", "turned", "asked", "spent", F.inline(ways(step, bits))).where(bound(step, bits)).select("first", "turned", *asked_for(step, bits)))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def ways(step: int, bits: int):
    """What a chain's next segment may differ in: the masks of the widest segment, by their bits."""
    return F.array(*[F.struct(F.lit(mask).cast("long").alias("mask"), F.lit(n).alias("more"), F.lit(mask & -mask).cast("long").alias("low")) for mask, n in flips(max(widths(bits)), (step + 1) * bits // (bits + 1))])


def next_width(step: int, bits: int):
    return F.element_at(F.array(*[F.lit(widths(bits, f)[step]) for f in range(bits + 1)]), F.col("first") + 1)


def own_segment(step: int, bits: int):
    """The segment after the first `step` ones of the turned fingerprint."""
    shift = F.element_at(F.array(*[F.lit(64 - sum(widths(bits, f)[: step + 1])) for f in range(bits + 1)]), F.col("first") + 1)
    whole = F.call_function("shiftrightunsigned", F.col("turned"), shift)
    return whole.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), next_width(step, bits)) - 1)


def bound(step: int, bits: int):
    """Masks within the segment and the budget; of a pair that was equal so far, the side whose lowest changed bit is 0 asks."""
    inside = F.col("mask") < F.call_function("shiftleft", F.lit(1).cast("long"), next_width(step, bits))
    afford = F.col("spent") + F.col("more") <= (step + 1) * bits // (bits + 1)
    mine = (F.col("spent") > 0) | (F.col("more") == 0) | (own_segment(step, bits).bitwiseAND(F.col("low")) == 0)
    return inside & afford & mine


def asked_for(step: int, bits: int) -> list:
    """key, spent: the place that is asked for and the bits by which it differs."""
    place = F.call_function("shiftleft", F.col("asked"), next_width(step, bits)).bitwiseOR(own_segment(step, bits).bitwiseXOR(F.col("mask")))
    return [place.alias("key"), (F.col("spent") + F.col("more")).cast("int").alias("spent")]


def compared(stand: DataFrame, ask: DataFrame | None, finder: Finder, askers: int) -> DataFrame:
    """Links between what stands and what asks; without ask, everything that stands asks for its like."""
    rows = stand.select("first", "key", "turned", F.lit(2 if ask is None else 0).alias("asks"), F.lit(0).alias("spent"), F.lit(0).cast("long").alias("salt"))
    if ask is not None:
        busy = stash(ask.groupBy("first", "key").count().where(F.col("count") > askers).select("first", "key", F.ceil(F.col("count") / askers).alias("salts")))
        few = sent(busy, busy.count(), SENT_KEYS)
        one = F.coalesce("salts", F.lit(1))
        spread = rows.join(few, ["first", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("salts")
        asking = ask.join(few, ["first", "key"], "left").select("first", "key", "turned", F.lit(1).alias("asks"), "spent", F.pmod(F.xxhash64("turned"), one).alias("salt"))
        rows = spread.unionByName(asking)
    rows = stash(rows)
    shards = max(64, rows.count() // SHARD_ROWS)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("first", "key", "salt"), F.lit(shards)).cast("int"))
    return stash(dealt.groupBy("shard").applyInArrow(lambda table: finder.forest(table), "a long, b long"))


def simhash(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", crowd: tuple[int, int] = CROWD, askers: int = ASKERS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, the smallest id that links reach.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; texts of fewer words than a shingle are one as a whole. Null, empty
    and blank texts have the fingerprint zero and are linked like any other. Rows that repeat are linked by their equal
    fingerprints, however many there are. Null ids sort last: a component of them alone has a null id. An empty table
    gives an empty result. Other columns are not read.
    """
    people = stash(fingerprints(docs, shingle, id_col, text_col))
    classes = stash(people.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("members")))
    label = connected(near(classes.select("fp"), bits, crowd, askers)).withColumnRenamed("node", "fp")
    both = classes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = both.groupBy("label").agg(F.min("low").alias("component_id"))
    named = stash(both.join(lowest, "label").select("fp", "members", "component_id"))
    least = max(64, int(people.count() * HOT_SHARE) + 1)
    return with_group(people, named, ["fp"], "members", least).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns. Rows of an id that has any kept row stay; null ids stay."""
    found = simhash(docs, bits, shingle, id_col, text_col)
    return without(docs, found.where("component_id <> doc_id").select("doc_id"), id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))
