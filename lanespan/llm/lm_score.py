"""Language-model scores by an interpolated modified Kneser-Ney bigram model.

Words and the words before them, their contexts, are both known by 64-bit hashes. All that is known of a predicted word
meets in one shard, and all that is known of a context in another:

1. A pass over the texts cuts them into blocks and sends, for each block and shard, the counts of (word, context) in the
   order of their hashes, and which documents of the block hold them.
2. Each shard merges its blocks into sorted arrays, finds the blocks' pairs in them by binary search, and stores the
   counts with the places of the blocks' pairs. For each context it met it asks that context's shard, telling its sums.
3. Context shards add up these sums and answer. Sums over all shards give the discounts; nothing else is gathered.
4. Each shard's stored arrays are inflated straight into a file of the task and mapped into memory from there, beside
   which a worker still holds one shard's packed blocks and scores; with its contexts' sums it returns sums by document.

A few words may hold a large part of all tokens. Those that a sample finds are dealt to sub-shards by context; the
sample only balances the work, as any list gives the same scores. A frequent context is added up within each shard first.
"""

from __future__ import annotations

import copy
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import FOLD, pack, shards_for, starts, stash, unpack

BLOCK_TOKENS, BLOCK_DOCS = 3_000_000, 1 << 14
HOT_SHARE, HOT_PARTS, HOT_SAMPLE = 1 / 200, 32, 4000
FOLDS = 10


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


#: A text's words hold no blank, so these are no words.
END, START = b" end", b" start"


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hashes, in their order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def hot_parts(shards: int) -> int:
    """Sub-shards of a hot word: they grow with the shards, as its pairs do."""
    return max(HOT_PARTS, shards // 8)


def block_payloads(texts: list[bytes], held: np.ndarray, shards: int, hot: list[int]) -> Iterator[tuple[int, bytes]]:
    """shard, counts and holders of one block."""
    number: dict[bytes, int] = {END: 0, START: 1}
    tokens, lengths = [], []
    for t in texts:
        found = [number.setdefault(w, len(number)) for w in t.translate(FOLD).split()]
        found.append(0)
        tokens.extend(found)
        lengths.append(len(found))
    hashes = np.fromiter(map(word_hash, number), np.uint64, len(number))
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    hashes = hashes[order]
    word = rank[np.array(tokens, np.int64)]
    del tokens, number
    doc = np.repeat(np.arange(len(texts)), lengths)
    context = np.empty(len(word), np.int64)
    context[1:] = word[:-1]
    context[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = rank[1]
    wide, deep = len(hashes).bit_length(), len(texts).bit_length()
    pair = word << wide | context
    del word, context
    if 2 * wide + deep < 64:
        key = np.sort(pair << deep | doc)
        first = starts(key)
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        pair, doc = key >> deep, (key & ((1 << deep) - 1)).astype(np.uint16)
        del key
    else:  # one huge text of very many words
        order = np.lexsort((doc, pair))
        pair, doc = pair[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]))
        count = np.diff(np.append(first, len(pair)))
        pair, doc = pair[first], doc[first].astype(np.uint16)
    train = np.where(held[doc], 0, count)
    first = starts(pair)
    holders = np.diff(np.append(first, len(pair)))
    trained = np.add.reduceat(train, first) if len(first) else train
    pair = pair[first]
    before, parts = hashes[pair & ((1 << wide) - 1)], hot_parts(shards)
    shard = shard_of(hashes, shards)[pair >> wide]
    for i, h in enumerate(hot):
        at = int(np.searchsorted(hashes, np.uint64(h)))
        if at < len(hashes) and hashes[at] == np.uint64(h):
            lo, hi = np.searchsorted(pair, [at << wide, (at + 1) << wide])
            shard[lo:hi] = shards + i * parts + (before[lo:hi] % np.uint64(parts)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(holders)])
    by_shard = np.argsort(shard, kind="stable")
    cuts = starts(shard[by_shard])
    for lo, hi in zip(cuts, np.append(cuts[1:], len(by_shard)), strict=True):
        rows = by_shard[lo:hi]
        words = pair[rows] >> wide
        f = starts(words)
        n = holders[rows]
        at = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield int(shard[rows[0]]), pack(hashes[words[f]], np.diff(np.append(f, len(words))).astype(np.uint32), before[rows], trained[rows].astype(np.uint32), n.astype(np.uint32), doc[at], count[at].astype(np.uint32))


BLOCK = ("<u8", "<u4", "<u8", "<u4", "<u4", "<u2", "<u4")
STORED = ("<u8", "<u4", "<u4", "<u4", "<u4", "<i8", "<u4", "<u4", "<u4", "<u2", "<u4")
ASKED, TOLD = ("<u8", "<u8", "<u4", "<u4", "<u4"), ("<u8", "<u4", "<u4", "<u4")


def shard_model(shard: int, blocks: list[int], payloads: list[bytes], shards: int) -> Iterator[tuple]:
    """Rows (kind, toward, payload, hot, sums): what is stored, what is asked of context shards, and the shard's own sums."""
    parts = [unpack(p, *BLOCK) for p in payloads]
    words = np.unique(np.concatenate([p[0] for p in parts]))
    contexts = np.unique(np.concatenate([p[2] for p in parts]))
    wide = len(contexts).bit_length()
    place = np.concatenate([np.repeat(np.searchsorted(words, p[0]), p[1]) << wide | np.searchsorted(contexts, p[2]) for p in parts])
    pair, place = np.unique(place, return_inverse=True)
    count = np.bincount(place, np.concatenate([p[3] for p in parts]), len(pair)).astype(np.int64)
    word, context = pair >> wide, pair & ((1 << wide) - 1)
    del pair
    total = np.bincount(word, count, len(words)).astype(np.int64)
    before = np.bincount(word[count > 0], minlength=len(words))
    # Places rise within a block, so their differences are small; at a new block they wrap round.
    steps = np.diff(place.astype(np.uint32), prepend=np.uint32(0))
    held = [np.concatenate([p[i] for p in parts]) for i in (4, 5, 6)]
    yield 0, -1, pack(total.astype(np.uint64), before.astype(np.uint32), np.bincount(word, minlength=len(words)).astype(np.uint32), context.astype(np.uint32), count.astype(np.uint32), np.array(blocks, np.int64), np.array([len(p[2]) for p in parts], np.uint32), steps, *held), None, None
    del parts, held, steps, place
    sums = [np.bincount(context, w, len(contexts)).astype(np.int64) for w in (count, count == 1, count == 2, count > 2)]
    to = shard_of(contexts, shards)
    cuts = starts(to)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(to)), strict=True):
        yield 1, int(to[lo]), pack(contexts[lo:hi], sums[0][lo:hi].astype(np.uint64), *(x[lo:hi].astype(np.uint32) for x in sums[1:])), None, None
    hot = (shard - shards) // hot_parts(shards) if shard >= shards else -1
    yield 2, -1, None, hot, [int(total.sum()), int(before.sum()), int((total > 0).sum()), *(int((count == k).sum()) for k in range(1, 5)), *(int((before == k).sum()) for k in range(1, 5))]


def answers(payloads: list[bytes]) -> Iterator[bytes]:
    """To each that asks, the sums of its contexts over all shards."""
    asked = [unpack(p, *ASKED) for p in payloads]
    contexts = np.unique(np.concatenate([a[0] for a in asked]))
    at = [np.searchsorted(contexts, a[0]) for a in asked]
    sums = [np.bincount(np.concatenate(at), np.concatenate([a[i] for a in asked]), len(contexts)) for i in range(1, 5)]
    for x in at:
        yield pack(*(s[x].astype(k) for s, k in zip(sums, TOLD, strict=True)))


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the numbers of counts 1 to 4; usual values where these are missing."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True))])


class Totals:
    """What scoring needs besides the shards: numbers of tokens, words and pairs, discounts, and totals of hot words. Sums of contexts belong to a shard, which knows them by their places."""

    def __init__(self, tokens: int, words: int, pairs: int, n: list[int], m: list[int], classes: dict[int, tuple], hot: dict[int, tuple[int, int]]):
        self.tokens, self.words, self.pairs, self.hot = tokens, words, pairs, hot
        self.high, self.low = discounts(n), discounts(m)
        self.context = np.zeros((max(classes, default=-1) + 2, 4))  # the last is of a context that was never seen
        for c, x in classes.items():
            self.context[c] = x
        rest = max(0, words - m[0] - m[1])
        self.spare = (self.low[1] * m[0] + self.low[2] * m[1] + self.low[3] * rest) / max(1, pairs)

    def lower(self, before: np.ndarray) -> np.ndarray:
        """Probability by the number of contexts a word is seen in; the discounted mass goes to all words and one unknown alike."""
        kept = np.maximum(before - self.low[np.minimum(before, 3)], 0) / max(1, self.pairs)
        return kept + (self.spare if self.pairs else 1.0) / (self.words + 1)

    def within(self, context: np.ndarray) -> Totals:
        """The same, with the sums of a shard's contexts by place."""
        own = copy.copy(self)
        own.context = context
        return own

    def higher(self, count: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        c, n1, n2, n3 = self.context[context].T
        seen = np.maximum(c, 1)
        kept = np.maximum(count - self.high[np.minimum(count, 3)], 0) / seen
        return np.where(c > 0, kept + (self.high[1] * n1 + self.high[2] * n2 + self.high[3] * n3) / seen * lower, lower)


def mapped(data: bytes, f, kinds: tuple) -> list[np.ndarray]:
    """Packed arrays, inflated into a file and mapped from it."""
    import io
    import struct

    import zstandard

    zstandard.ZstdDecompressor().copy_stream(io.BytesIO(data), f)
    f.flush()
    f.seek(0)
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, struct.unpack(f"<{len(kinds)}Q", f.read(at)), strict=True):
        out.append(np.memmap(f, kind, "r", at, (size // np.dtype(kind).itemsize,)) if size else np.zeros(0, kind))
        at += size
    return out


def score_shard(shard: int, stored: bytes, told: list[bytes], t: Totals, shards: int) -> Iterator[tuple[int, bytes]]:
    """block, sums by document (documents, base score, score, known tokens)."""
    with tempfile.TemporaryFile() as f:  # gone with the task, whatever becomes of it
        total, before, n_pairs, context, count, blocks, entries, steps, holders, doc, times = mapped(stored, f, STORED)
        # Answers come in the order of context shards, so in that of the shard's contexts.
        answered = [unpack(p, *TOLD) for p in told]
        own = t.within(np.stack([np.concatenate([a[i] for a in answered]).astype(np.float64) for i in range(4)], axis=1))
        c, b = total.astype(np.int64), before.astype(np.int64)
        if shard >= shards:
            hot_total, hot_before = t.hot[(shard - shards) // hot_parts(shards)]
            c, b = np.full(len(c), hot_total), np.full(len(b), hot_before)
        of_word = np.repeat(np.arange(len(c)), n_pairs)
        score = np.log10(own.higher(count.astype(np.int64), context, t.lower(b)[of_word]))
        base = np.log10((c + 0.1) / (t.tokens + 0.1 * (t.words + 1)))
        kinds = (base[of_word], score, (c > 0)[of_word].astype(float))
        place = np.cumsum(steps, dtype=np.uint32)
        ends = np.cumsum(entries, dtype=np.int64)
        stops = np.concatenate([[0], np.cumsum(holders, dtype=np.int64)])
        for block, lo, hi in zip(blocks.tolist(), ends - entries, ends, strict=True):
            pair = np.repeat(place[lo:hi], holders[lo:hi])
            d, n = doc[stops[lo] : stops[hi]], times[stops[lo] : stops[hi]]
            sums = [np.bincount(d, x[pair] * n) for x in kinds]
            docs = np.flatnonzero(np.bincount(d))
            yield block, pack(docs.astype(np.uint16), *(s[docs] for s in sums))


def crc_mod(c, n: int):
    return F.crc32(c.cast("string").cast("binary")) % n


def hot_words(docs: DataFrame, text_col: str) -> list[int]:
    """Hashes of words that hold at least HOT_SHARE of a sample's tokens; there are no more than 1 / HOT_SHARE."""
    rows = docs.count()
    some = docs.sample(min(1.0, HOT_SAMPLE / max(1, rows)), seed=7).select(F.explode(F.split(F.col(text_col), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    counts = some.groupBy("w").count()
    n = counts.agg(F.sum("count")).first()[0] or 0
    found = [r[0].encode().translate(FOLD) for r in counts.where(F.col("count") >= max(100, n * HOT_SHARE)).select("w").collect()]
    return sorted({word_hash(w) for w in [*found, END]})


def lm_scores(docs: DataFrame, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities; the perplexity is 10 ** (-score / n_tokens).

    The model is counted over all rows that are not held out (crc32 of the id as text divisible by folds); null ids are
    not held out. Null texts count as empty and have the end token only. Rows that repeat are each counted and scored.
    Without training rows all words are unknown and have the same probability. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_mod(F.col(id_col), folds) == 0, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = shards_for(2 * chars)  # pairs take more room than words
    hot = hot_words(rows, "text")
    of_docs = {"block": pa.int64(), "local": pa.int32(), "doc_id": None, "held": pa.bool_(), "n_tokens": pa.int64()}
    doc_type = f"block long, local int, doc_id {kind.simpleString()}, held boolean, n_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's payloads by shard, and its documents by a negative number of the block."""
        part, seq = TaskContext.get().partitionId(), 0
        texts, ids, held, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal texts, ids, held, size, seq
            if texts:
                block = part << 20 | seq
                seq += 1
                id_type = ids[0].type
                own = pa.chunked_array(ids).combine_chunks()
                n, lengths = len(texts), [len(t.split()) + 1 for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([-1 - block] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), own, pa.array(held), pa.array(lengths)], names=names)
                for s, payload in block_payloads(texts, np.array(held), shards, hot):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([payload], pa.binary()), pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, id_type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64())], names=names)
                texts, ids, held, size = [], [], [], 0

        names = ["shard", "payload", *of_docs]
        for b in batches:
            column, flags = b.column(2).to_pylist(), b.column(1).to_pylist()
            for i, t in enumerate(column):
                if len(texts) >= BLOCK_DOCS or size > 5.5 * BLOCK_TOKENS:
                    yield from flush()
                texts.append(t)
                held.append(flags[i])
                ids.append(b.column(0).slice(i, 1))
                size += len(t)
        yield from flush()

    def build(table: pa.Table) -> pa.Table:
        shard, n = table["shard"][0].as_py(), table.num_rows
        made = {"kind": pa.int32(), "shard": pa.int64(), "toward": pa.int64(), "payload": pa.binary(), "hot": pa.int32(), "sums": pa.list_(pa.int64())}
        if shard < 0:
            return pa.table({c: pa.array([3] * n, k) if c == "kind" else pa.nulls(n, k) for c, k in made.items()} | {c: table[c] for c in of_docs})
        found = [(k, shard, *x) for k, *x in shard_model(shard, table["block"].to_pylist(), table["payload"].to_pylist(), shards)]
        out = {c: pa.array(x, k) for (c, k), x in zip(made.items(), zip(*found, strict=True), strict=True)}
        return pa.table(out | {c: pa.nulls(len(found), table.schema.field(c).type) for c in of_docs})

    blocks = rows.select("doc_id", "held", F.col("text").cast("binary").alias("text")).mapInArrow(cut, f"shard long, payload binary, {doc_type}")
    model = stash(blocks.groupBy("shard").applyInArrow(build, f"kind int, shard long, toward long, payload binary, hot int, sums array<long>, {doc_type}"), "none")
    sums_of = {r[0]: r[1:] for r in (tuple(r) for r in model.where("kind = 2").groupBy("hot").agg(*(F.sum(F.col("sums")[i]) for i in range(11))).collect())}
    own = sums_of.get(-1, (0,) * 11)
    some = {i: x[:2] for i, x in sums_of.items() if i >= 0}
    n = [sum(x[2 + k] for x in sums_of.values()) for k in range(1, 5)]
    m = [own[6 + k] + sum(b == k for _, b in some.values()) for k in range(1, 5)]
    totals = Totals(own[0] + sum(c for c, _ in some.values()), own[2] + sum(c > 0 for c, _ in some.values()), own[1] + sum(b for _, b in some.values()), n, m, {}, {i: some.get(i, (0, 0)) for i in range(len(hot))})
    shared = docs.sparkSession.sparkContext.broadcast(totals)

    def answer(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table["shard"], "toward": table["toward"], "payload": pa.array(answers(table["payload"].to_pylist()), pa.binary())})

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("toward")  # what is stored comes first
        stored, *told = table["payload"].to_pylist()
        out = list(score_shard(table["shard"][0].as_py(), stored, told, shared.value, shards))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "sums": pa.array([p for _, p in out], pa.binary())})

    told = model.where("kind = 1").select("shard", "toward", "payload").groupBy("toward").applyInArrow(answer, "shard long, toward long, payload binary")
    sums = model.where("kind = 0").select("shard", "toward", "payload").unionByName(told).groupBy("shard").applyInArrow(score, "block long, sums binary")
    people = model.where("kind = 3").select("block", "local", "doc_id", "held", "n_tokens", F.lit(None).cast("binary").alias("sums"))
    none = {c: F.lit(None).cast(people.schema[c].dataType) for c in ("local", "doc_id", "held", "n_tokens")}
    sums = sums.withColumns(none).select(*people.columns)
    train_tokens = int(totals.tokens)

    def total(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        got = table.filter(pc.is_valid(table["local"])).sort_by("local")
        n = got.num_rows
        out = np.zeros((3, n))
        for p in table["sums"].drop_null().to_pylist():
            at, *values = unpack(p, "<u2", "<f8", "<f8", "<f8")
            for i, v in enumerate(values):
                out[i, at] += v
        return pa.Table.from_arrays(
            [got["doc_id"], got["held"], got["n_tokens"], pa.array(out[2].round().astype(np.int64)), pa.array(np.full(n, train_tokens)), pa.array(out[0]), pa.array(out[1]), pa.array(10 ** (-out[1] / np.maximum(1, got["n_tokens"].to_numpy())))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )

    return people.unionByName(sums).groupBy("block").applyInArrow(total, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
