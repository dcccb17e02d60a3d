"""N-gram Jaccard join by vertical partitioning.

A text's set holds the hashes of its word n-grams; the global order of n-grams is that of their hashes. The order is cut
into fragments, as many as the size class of a set demands: two sets that are similar enough differ in no more
than `slack` n-grams, so in no more fragments than that, and all their other fragments are equal.

1. Texts with equal sets form one class, and classes are what is joined.
2. Each class has a token for each of its fragments. A shard finds which tokens more than one class has. A class
   needs at least (fragments - slack) such tokens; all others can have no partner and go. A set whose n-grams fall
   into too few fragments for that has tokens for its first n-grams in the global order too (prefix filtering).
3. Each class left is verified with the smallest class of each of its tokens. Linked classes are connected.
4. What shares tokens but is not connected yet is verified in blocks of classes. Blocks of large families hold sets of about
   one size, and meet those only whose sizes allow a link. Sets are sent to the pairs of blocks in rounds, each of which
   takes a bounded share of the disk, however large a family is. The order of n-grams is cut into vertical
   fragments; a task has one fragment of a pair of blocks, counts the partial overlaps in it and lets those pairs go
   whose sets differ there by more than they may as a whole. Partial counts are then dealt out by pair and summed. Blocks
   that one component fills are not paired with each other, so a large group of near copies costs no square of its
   size; only links come out.

Where the links of each row are asked for, 3 is left out and 4 compares all classes that tokens connect, whatever
component they are in: every link is verified and counted, and a group of near copies costs the square of its classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import FOLD, connected, mix64, pack, sent, shards_for, starts, stash, unpack, with_group, without, word_hashes

SHINGLE, PERCENT = 3, 90
BLOCK = 512
#: Vertical fragments of the order of n-grams in which overlaps are counted apart.
FRAGMENTS = 4
SLICE = 8192
#: Bytes of sets that a round of comparisons sends at least.
LEAST_ROUND = 256 << 20
SENT_ROWS = 400_000
HOT_SHARE = 1 / 1024
RATIO = 2**0.5


def slack(n: int, percent: int) -> int:
    """N-grams by which a set of n may differ, both ways together, from one with percent of their union in common."""
    return n * (100 - percent) // percent


def shingle_set(text: bytes, k: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words are one shingle as a whole, none are an empty set."""
    h = word_hashes(text.translate(FOLD).split(), known)
    if not len(h):
        return h
    n = min(k, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix64(acc + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; 0, 0 is the empty set."""
    import xxhash

    if not len(s):
        return 0, 0
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (d & (1 << 64) - 1, d >> 64))


def size_classes(n: int, percent: int) -> list[int]:
    """The size class of n, and the next if a partner may be in it: class q has sizes from RATIO ** q up to RATIO ** (q + 1)."""
    q = int(np.floor(np.log(n) / np.log(RATIO) + 1e-9))
    most = n * 100 // percent
    return list(range(q, int(np.floor(np.log(max(n, most)) / np.log(RATIO) + 1e-9)) + 1))


def fragments_of(q: int, percent: int) -> int:
    spread = 1.5 if percent >= 85 else 1.15
    return int(spread * slack(int(np.ceil(RATIO ** (q + 1))), percent)) + 2


def tokens_of(s: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """For each size class of the set: its tokens, and how many of them a partner shares at least."""
    n, out = len(s), []
    free = slack(n, percent)
    if not free:  # only an equal set is similar enough
        return out
    mixed = mix64(s)
    for q in size_classes(n, percent):
        k = np.uint64(fragments_of(q, percent))
        f = (s >> np.uint64(32)) * k >> np.uint64(32)
        at = starts(f)
        seed = np.uint64(q * 2 + 1) << np.uint64(40)
        own = mix64(np.add.reduceat(mixed, at) + mix64(f[at] + seed))
        need = len(own) - free
        if need < 1:
            prefix = s[: n - -(-n * percent // 100) + 1]
            own = np.concatenate([own, mix64(prefix ^ (seed + np.uint64(1)))])
        out.append((np.unique(own), max(1, need)))
    return out


class Cutter:
    """Rows of a partition: one for each text, and for each shard the tokens of the classes met."""

    def __init__(self, k: int, percent: int, shards: int):
        self.k, self.percent, self.shards = k, percent, shards

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = {}, set()
        tokens, keys, needs, size = [], [], [], 0
        for b in batches:
            ids = b.column(0)
            rows = []
            for t in b.column(1).to_pylist():
                s = shingle_set(t or b"", self.k, known)
                key = set_key(s)
                rows.append((len(s), *key))
                if key not in met:
                    met.add(key)
                    for own, need in tokens_of(s, self.percent):
                        tokens.append(own)
                        keys.append(key[0])
                        needs.append(need)
                        size += len(own)
                if len(known) > 300_000:
                    known.clear()
            yield self.batch(ids, n=[r[0] for r in rows], k1=[r[1] for r in rows], k2=[r[2] for r in rows])
            if size > 1_500_000:
                yield from self.flush(ids, tokens, keys, needs)
                tokens, keys, needs, size = [], [], [], 0
                met.clear()
        if tokens:
            yield from self.flush(ids, tokens, keys, needs)

    def flush(self, ids: pa.Array, tokens: list, keys: list, needs: list) -> Iterator[pa.RecordBatch]:
        token = np.concatenate(tokens)
        of = np.repeat(np.arange(len(keys)), [len(t) for t in tokens])
        key, need = np.array(keys, np.int64), np.array(needs, np.int32)
        order = np.argsort(token, kind="stable")
        token, of = token[order], of[order]
        at = starts(token)
        n = np.diff(np.append(at, len(token)))
        # A token that several classes of this block have is known to be shared; one of them goes to the shard for the others' sake.
        several = np.repeat(n > 1, n)
        if several.any():
            o = of[several]
            yield self.batch(ids.slice(0, 0), token=token[several].view(np.int64), k1=key[o], need=need[o])
        first, several = of[at], n > 1
        shard = ((token[at] >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        cuts = starts(shard)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
            used, local = np.unique(first[lo:hi], return_inverse=True)
            yield self.batch(ids.slice(0, 0), shard=[int(shard[lo])], payload=[pack(token[at][lo:hi], local.astype(np.uint32), several[lo:hi].astype(np.uint8), key[used], need[used])])

    COLUMNS = {"n": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "token": pa.int64(), "need": pa.int32(), "shard": pa.int32(), "payload": pa.binary()}
    SCHEMA = "n long, k1 long, k2 long, token long, need int, shard int, payload binary"

    def batch(self, ids: pa.Array, **columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        own = ids if len(ids) == rows and "n" in columns else pa.nulls(rows, ids.type)
        return pa.RecordBatch.from_arrays([own, *(pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in self.COLUMNS.items())], names=["doc_id", *self.COLUMNS])


def met_in_shard(table: pa.Table) -> pa.Table:
    """The rows of the shard that hold no packed tokens as they are, and a row for each token and class that shared_tokens finds."""
    plain = table.filter(table["payload"].is_null()).select(["doc_id", "n", "k1", "k2", "token", "need"])
    found = shared_tokens(table["payload"].drop_null().to_pylist())
    none = {c: pa.nulls(found.num_rows, plain.schema.field(c).type) for c in ("doc_id", "n", "k2")}
    return pa.concat_tables([plain, pa.table({**{c: found[c] for c in found.column_names}, **none}).select(plain.column_names)])


def shared_tokens(payloads: list[bytes]) -> pa.Table:
    """token, k1, need of the tokens that classes of several blocks of the shard have."""
    if not payloads:
        return pa.table({"token": pa.array([], pa.int64()), "k1": pa.array([], pa.int64()), "need": pa.array([], pa.int32())})
    parts = [unpack(p, "<u8", "<u4", "u1", "<i8", "<i4") for p in payloads]
    token = np.concatenate([p[0] for p in parts])
    key = np.concatenate([p[3][p[1]] for p in parts])
    need = np.concatenate([p[4][p[1]] for p in parts])
    told = np.concatenate([p[2] for p in parts])
    order = np.lexsort((key, token))
    token, key, need, told = token[order], key[order], need[order], told[order]
    at = starts(token)
    n = np.diff(np.append(at, len(token)))
    varied = np.maximum.reduceat(key, at) != np.minimum.reduceat(key, at)
    keep = np.repeat(varied | (np.maximum.reduceat(told, at) > 0), n) & (told == 0)
    return pa.table({"token": token[keep].view(np.int64), "k1": key[keep], "need": need[keep]})


def similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def partial_overlaps(sets: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right, count: places of pairs and the n-grams they share in a fragment (sets), for those pairs that do not differ
    there by more than their sizes as a whole allow. Pairs of one side are not looked at if there are two."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    here = np.bincount(of, minlength=len(sets))
    grams = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(of) else np.zeros(0, np.int64)
    seen = np.bincount(grams)
    place = np.cumsum(seen > 1) - 1
    keep = seen[grams] > 1
    of, grams = of[keep], place[grams[keep]]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    shared = int((seen > 1).sum())
    for lo in range(0, shared, SLICE):  # bounds the memory of the product only
        on = (grams >= lo) & (grams < lo + SLICE)
        part = np.zeros((len(sets), min(SLICE, shared - lo)), np.float32)
        part[of[on], grams[on] - lo] = 1
        overlap += part @ part.T
    overlap = overlap.astype(np.int64)
    total = sizes[:, None] + sizes[None, :]
    most = total - 2 * -(-percent * total // (100 + percent))  # the difference of sets that are just similar enough
    ok = here[:, None] + here[None, :] - 2 * overlap <= most
    ok &= np.triu(np.ones_like(ok), 1) if sides.min() == sides.max() else (sides[:, None] < sides[None, :])
    left, right = np.nonzero(ok)
    return left, right, overlap[left, right]


def summed_overlaps(parts: list[tuple], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right, count: the pairs that every fragment let pass, with the sum of their partial overlaps."""
    keys = np.concatenate([p[0].astype(np.int64) * n + p[1] for p in parts])
    key, at, passed = np.unique(keys, return_inverse=True, return_counts=True)
    count = np.bincount(at, np.concatenate([p[2] for p in parts]), len(key)).astype(np.int64)
    key, count = key[passed == len(parts)], count[passed == len(parts)]
    return key // n, key % n, count


def near_pairs(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> np.ndarray:
    """Which places have similar sets, as a symmetric matrix without its diagonal, by the two steps above."""
    sizes = np.array([len(s) for s in sets])
    cuts = [np.split(s, np.searchsorted(s, EDGES)) for s in sets]
    parts = [partial_overlaps([c[f] for c in cuts], sizes, sides, percent) for f in range(FRAGMENTS)]
    left, right, count = summed_overlaps(parts, len(sets))
    near = np.zeros((len(sets), len(sets)), bool)
    ok = 100 * count >= percent * (sizes[left] + sizes[right] - count)
    near[left[ok], right[ok]] = near[right[ok], left[ok]] = True
    return near


#: Where the fragments after the first begin in the order of hashes.
EDGES = np.array([(f << 64) // FRAGMENTS for f in range(1, FRAGMENTS)], np.uint64)


def verified_in_fragments(held: DataFrame, percent: int) -> DataFrame:
    """pair, keys, sizes, sides, groups, left, right: similar classes of each pair of blocks, as places in keys.

    held: pair, side, k1, members, part, n, grams. Each class is cut into its fragments, which go to (pair, fragment); what is
    counted there goes to the pair.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            grams = [np.split(g, np.searchsorted(g, EDGES)) for g in (np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist())]
            rest = table.drop_columns(["grams"])
            for f in range(FRAGMENTS):
                own = rest.append_column("fragment", pa.array([f] * len(grams), pa.int32())).append_column("grams", pa.array([g[f].tobytes() for g in grams], pa.binary()))
                yield from own.to_batches()

    def partial(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("k1", "ascending")])
        sizes, sides = table["n"].to_numpy(), table["side"].to_numpy()
        left, right, count = partial_overlaps([np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()], sizes, sides, percent)
        first = table["fragment"][0].as_py() == 0
        people = [table["k1"].to_numpy(), sizes, table["members"].to_numpy(), table["part"].to_numpy()] if first else [np.zeros(0, np.int64)] * 4
        data = pack(left.astype(np.uint16), right.astype(np.uint16), count.astype(np.uint32), *(p.astype(np.int64) for p in people))
        return pa.table({"pair": table["pair"][:1], "fragment": table["fragment"][:1], "classes": pa.array([table.num_rows], pa.int32()), "counts": pa.array([data], pa.binary())})

    cuts = held.mapInArrow(cut, "pair long, side int, k1 long, members long, part long, n long, fragment int, grams binary")
    return cuts.groupBy("pair", "fragment").applyInArrow(partial, "pair long, fragment int, classes int, counts binary")


COUNTS = ("<u2", "<u2", "<u4", "<i8", "<i8", "<i8", "<i8")


def similar_of(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of similar classes of a pair of blocks out of its partial counts, and all its classes' keys, members and parts."""
    parts = [unpack(x, *COUNTS) for x in table.sort_by("fragment")["counts"].to_pylist()]
    keys, sizes, members, groups = parts[0][3:]
    left, right, count = summed_overlaps([p[:3] for p in parts], len(keys))
    ok = 100 * count >= percent * (sizes[left] + sizes[right] - count)
    return left[ok], right[ok], keys, members, groups


def matrix(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    near = np.zeros((n, n), bool)
    near[left, right] = near[right, left] = True
    return near


def merges(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that near connects, one less than the places of each component."""
    out, left = [], np.ones(len(near), bool)
    for i in range(len(near)):
        todo = [i] if left[i] else []
        left[i] = False
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & left).tolist()
            left[new] = False
            out += [(x, j) for j in new]
            todo += new
    return out


def block_links(sets: list[np.ndarray], groups: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places of similar sets, enough to connect all that are; pairs within a group, or of one side if there are two, are not looked at."""
    near = near_pairs(sets, sides, percent)
    return merges(near & (groups[:, None] != groups[None, :]))


def ngram_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, the smallest id that links reach; with_links adds n_links, the number of other rows it is linked with.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Two rows are linked when the intersection of their sets is at
    least percent of the union. Null and empty texts have empty sets and are linked with nothing, not with each other.
    Rows that repeat are linked by their equal sets. Null ids sort last. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = shards_for(chars)
    cutter = Cutter(shingle, percent, shards)
    cut = rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(cutter.run, f"doc_id {kind}, {Cutter.SCHEMA}")
    # Packed tokens take more room than the texts, so they are shuffled and never written besides; rows of texts and single tokens go with them, dealt evenly.
    shard = F.coalesce("shard", F.pmod(F.xxhash64("doc_id", "k1", "token"), F.lit(shards)).cast("int"))
    cut = stash(cut.withColumn("shard", shard).groupBy("shard").applyInArrow(met_in_shard, f"doc_id {kind}, n long, k1 long, k2 long, token long, need int"))
    people = cut.where("n is not null").select("doc_id", "n", "k1", "k2")
    keys = ["k1", "k2"]
    classes = stash(people.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("members"), F.max("n").alias("n")))

    shared = stash(cut.where("token is not null").select("token", "k1", "need").distinct())
    for _ in range(2):  # what falls short of partners goes, and with it its tokens
        enough = shared.groupBy("k1", "need").agg(F.count(F.lit(1)).alias("got")).where("got >= need").select("k1", "need")
        left = shared.select("token", "k1", "need").join(enough, ["k1", "need"])
        ends = left.groupBy("token").agg(F.min("k1").alias("first"), F.max("k1").alias("last")).where("first <> last").select("token", "first")
        shared = stash(left.join(ends, "token").select("token", "k1", "need", "first"))
    pairs = stash(shared.where("first <> k1").select(F.col("first").alias("a"), F.col("k1").alias("b")).distinct())
    if pairs.limit(1).count() == 0:
        return labelled(people, classes, None, keys, classes.select("k1", F.lit(0).cast("long").alias("links")).limit(0) if with_links else None)

    families = connected(pairs)
    wanted = stash(families.select(F.col("node").alias("k1")).join(classes, "k1").select("k1", "k2", "low"))
    n_wanted = wanted.count()
    want = wanted.select("low", F.col("k1").alias("key")).withColumn("__want", F.lit(True))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            out = []
            for t, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(t or b"", shingle, known)
                if set_key(s)[0] == key:
                    out.append((key, len(s), s.tobytes()))
                if len(known) > 300_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["k1", "n", "grams"])

    texts = rows.join(sent(want, n_wanted, SENT_ROWS), F.col("doc_id").eqNullSafe(F.col("low"))).select(F.col("text").cast("binary"), "key")
    sets = stash(texts.mapInArrow(sets_of, "k1 long, n long, grams binary").dropDuplicates(["k1"]), "none")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            ok = []
            for x, y in zip(c["ga"], c["gb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(similar(len(x), len(y), both, percent))
            yield pa.RecordBatch.from_arrays([pa.array(c["a"], pa.int64()), pa.array(c["b"], pa.int64())], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    if with_links:
        more, counts = all_links(families, classes, sets, percent, chars)
        return labelled(people, classes, more, keys, counts)

    side = {x: sets.select(F.col("k1").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}")) for x in "ab"}
    close = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    links = stash(pairs.join(side["a"], "a").join(side["b"], "b").where(close).select("a", "b", "ga", "gb").mapInArrow(verified, "a long, b long"))
    part = connected(links).select(F.col("node").alias("k1"), F.col("label").alias("part"))

    members = families.select(F.col("node").alias("k1"), F.col("label").alias("family")).join(part, "k1", "left").withColumn("part", F.coalesce("part", "k1"))
    open_ = members.groupBy("family").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("family")
    members = stash(members.join(open_, "family").join(classes.select("k1", "n"), "k1"))
    # Components of more than half a block have blocks of their own; the others share blocks.
    sizes = members.groupBy("family", "part").agg(F.count(F.lit(1)).alias("same"))
    full = F.when(F.col("same") > BLOCK // 2, F.col("part"))
    placed, block = in_blocks_by_size(members.join(sizes, ["family", "part"]).select("family", "part", "k1", "n", full.alias("full"), F.lit(1).cast("long").alias("members")), percent)

    def in_blocks(table: pa.Table) -> pa.Table:
        left, right, k, _, groups = similar_of(table, percent)
        apart = groups[left] != groups[right]
        got = merges(matrix(len(k), left[apart], right[apart]))
        return pa.table({"a": pa.array([int(k[i]) for i, _ in got], pa.int64()), "b": pa.array([int(k[j]) for _, j in got], pa.int64())})

    more = in_rounds(placed, block, sets, percent, chars, in_blocks, "a long, b long")
    return labelled(people, classes, stash(links.unionByName(more)), keys)


def in_blocks_by_size(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """members with their block, and the blocks: family, full, block, low and high (sizes of sets), grams. members: family, part, full, k1, n, members.

    What has more classes than a block (a family's, or those of a component that fills blocks alone) is parted by the size of
    their sets before it is dealt to blocks, so that most blocks cannot hold partners of each other.
    """
    width = max(100 / percent, 1.1)
    rows = members.withColumn("unit", F.xxhash64("family", F.coalesce("full", "family"), F.col("full").isNull()))
    rows = rows.join(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("all")), "unit")
    rows = rows.withColumn("at", F.xxhash64("unit", F.when(F.col("all") > BLOCK, F.floor(F.log("n") / F.log(F.lit(width)))).otherwise(0)))
    cells = rows.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cells"))
    placed = rows.join(cells, "at").withColumn("block", F.xxhash64("at", F.pmod(F.xxhash64("k1"), F.col("cells"))))
    placed = stash(placed.select("family", "full", "part", "k1", "n", "members", "block"))
    block = placed.groupBy("family", "full", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("grams"))
    return placed, stash(block)


def in_rounds(placed: DataFrame, block: DataFrame, sets: DataFrame, percent: int, chars: int, found, schema: str) -> DataFrame:
    """What `found` finds in the partial counts of each pair of blocks that may hold similar sets. Blocks that one component fills do not meet.

    A round sends no more bytes of sets than half the characters of the input, or LEAST_ROUND.
    """
    ends = {x: block.select("family", *[F.col(c).alias(f"{c}{x}") for c in ("full", "block", "low", "high", "grams")]) for x in "ab"}
    fit = (F.col("higha") * 100 >= F.col("lowb") * percent) & (F.col("highb") * 100 >= F.col("lowa") * percent)
    meet = ends["a"].join(ends["b"], "family").where((F.col("blocka") <= F.col("blockb")) & fit & ~F.coalesce(F.col("fulla") == F.col("fullb"), F.lit(False)))
    meet = stash(meet.withColumn("pair", F.xxhash64("blocka", "blockb", F.lit(2))).select("pair", "blocka", "blockb", "gramsa", "gramsb"))
    sent_bytes = 8 * (meet.agg(F.sum(F.col("gramsa") + F.when(F.col("blocka") < F.col("blockb"), F.col("gramsb")).otherwise(0))).first()[0] or 0)
    rounds = max(1, -(-sent_bytes // max(LEAST_ROUND, chars // 2)))
    out = []
    for r in range(rounds):
        own = meet.where(F.pmod("pair", F.lit(rounds)) == r)
        sides = own.select("pair", F.col("blocka").alias("block"), F.lit(0).alias("side")).unionByName(own.where("blocka <> blockb").select("pair", F.col("blockb").alias("block"), F.lit(1).alias("side")))
        held = placed.select("block", "k1", "part", "members").join(sides, "block").join(sets, "k1").select("pair", "side", "k1", "members", "part", "n", "grams")
        out.append(stash(verified_in_fragments(held, percent).groupBy("pair").applyInArrow(found, schema)))
    return reduce(DataFrame.unionByName, out)


def all_links(families: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, chars: int) -> tuple[DataFrame, DataFrame]:
    """a, b: links that connect all that are linked; k1, links: the rows of other classes that a class is linked with.

    All pairs of a family's classes whose sizes allow a link are compared, in pairs of blocks. A link is counted where it is found, for both ends.
    """
    members = families.select(F.col("node").alias("k1"), F.col("label").alias("family")).join(classes.select("k1", "members", "n"), "k1")
    none = F.lit(None).cast("long")
    placed, block = in_blocks_by_size(stash(members.select("family", F.lit(0).cast("long").alias("part"), "k1", "n", none.alias("full"), "members")), percent)

    def in_blocks(table: pa.Table) -> pa.Table:
        left, right, k, rows, _ = similar_of(table, percent)
        n = np.bincount(left, rows[right], len(k)).astype(np.int64) + np.bincount(right, rows[left], len(k)).astype(np.int64)
        got, on = merges(matrix(len(k), left, right)), np.flatnonzero(n)
        a, b = [int(k[i]) for i, _ in got] + k[on].tolist(), [int(k[j]) for _, j in got] + [None] * len(on)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([None] * len(got) + n[on].tolist(), pa.int64())})

    found = in_rounds(placed, block, sets, percent, chars, in_blocks, "a long, b long, links long")
    return found.where("b is not null").select("a", "b"), found.where("b is null").groupBy(F.col("a").alias("k1")).agg(F.sum("links").alias("links"))


def labelled(people: DataFrame, classes: DataFrame, links: DataFrame | None, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Each row's smallest connected id, by its class and the class's component, and with counts its number of links."""
    if links is None:
        named = classes.withColumn("component", F.col("low"))
    else:
        label = connected(links)
        both = classes.join(label, classes["k1"] == label["node"], "left").withColumn("label", F.coalesce("label", "k1"))
        lowest = both.where("node is not null").groupBy("label").agg(F.min("low").alias("lowest"))
        named = both.join(lowest, "label", "left").withColumn("component", F.coalesce("lowest", "low")).select(*classes.columns, "component")
    own = []
    if counts is not None:
        own = ["n_links"]
        named = named.join(counts, "k1", "left").withColumn("n_links", F.col("members") - 1 + F.coalesce("links", F.lit(0))).drop("links")
    named = stash(named)
    least = max(64, int(people.count() * HOT_SHARE) + 1)
    filled = with_group(people.where("n > 0"), named.select(*keys, "members", "component", *own), keys, "members", least)
    empty = people.where("n = 0").withColumn("component", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long"))
    out = filled.select("doc_id", "n", "component", *own).unionByName(empty.select("doc_id", "n", "component", *own))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), *own)


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns. Ids have to be unique; null ids stay."""
    found = ngram_join(docs, shingle, percent, id_col, text_col)
    return without(docs, found.where("component_id <> doc_id").select("doc_id"), id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_links=True)
