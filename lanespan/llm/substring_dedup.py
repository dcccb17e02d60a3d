"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at a word, and a repeat is an internal node of the suffix tree at least `window` words deep; as every word
of a deeper node also lies in a node of exactly that depth, subtrees are cut there.

1. Most suffixes share no such node with another. They are found first, and left out, by anchors: of each window the
   `gram` words within it whose hash is least. Equal windows have equal anchors, so a suffix whose window has no repeated
   anchor is alone. Texts that are equal as a whole are one class, of which the smallest id is looked at.
2. Equal windows meet within an input block, word by word, and only the first of them goes on, with its words.
3. Suffixes are dealt to groups by prefixes of variable length: first as many words as it takes to hold PREFIX_BYTES bytes.
   A task counts the suffixes of its group as they come, merges equal windows at each GROUP_SUFFIXES, and if more than half
   of them are different deals the group out again by prefixes of twice the words, as often as it takes. So a task never
   holds more than that, and a window that every block has costs one suffix for each.
4. A group's suffixes, ordered by their words, are the leaves of its subtrees, and the lengths of common prefixes of
   neighbours give the internal nodes. Of a node `window` deep the first suffix, by id and place, is the one that stays;
   the others repeat it. Neighbouring repeats of a text join to its maximal runs of repeated words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lanespan.llm.common import mix64, pack, shards_for, starts, stash, unpack, with_group, word_hashes

WINDOW = 20
PREFIX_BYTES = 24
BLOCK_WORDS = 1_000_000
#: Characters of text for each group of suffixes, and suffixes that a group may have before it is cut again.
GROUP_CHARS, GROUP_SUFFIXES = 2_000_000, 500_000
#: Groups that such a group is dealt to.
PIECES = 64
#: Parts of 16 bits of a second hash of its window that a suffix carries beside its words and the first hash.
CHECK = 2
SENT_ROWS = 400_000
HOT_SHARE = 1 / 1024
LAST = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def key_of(joined: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(joined)
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (d & (1 << 64) - 1, d >> 64))


def slide(op, x: np.ndarray, w: int) -> np.ndarray:
    """op over each w neighbours, by doubling."""
    span, y = 1, x
    while span * 2 <= w:
        y = op(y[:-span], y[span:])
        span *= 2
    return op(y[: len(y) - (w - span)], y[w - span :]) if span < w else y


class Words:
    """Hashes of the words of several texts in a row, and hashes of any of their runs."""

    def __init__(self, hashes: list[np.ndarray], window: int):
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.n, self.window = len(self.h), window
        self.lens = np.array([len(x) for x in hashes], np.int64)
        self.begin = np.cumsum(self.lens) - self.lens
        self.doc = np.repeat(np.arange(len(hashes)), self.lens)
        ones = np.ones(self.n + 1, np.uint64)
        self.power, self.back = ones.copy(), ones
        self.power[1:], self.back[1:] = BASE, INVERSE
        self.power, self.back = np.cumprod(self.power), np.cumprod(self.back)
        self.sums = self.summed(self.h)
        left = self.begin[self.doc] + self.lens[self.doc] - np.arange(self.n)
        self.whole = left >= window  # a window begins here

    def summed(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.power[: self.n], dtype=np.uint64)])

    def runs(self, at: np.ndarray, length, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums if sums is None else sums
        return mix64((sums[at + length] - sums[at]) * self.back[at])

    def anchors(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the least gram of each window."""
        if self.n < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        a = self.runs(np.arange(self.n - gram + 1), gram)
        w = self.window - gram + 1
        least = np.where(self.whole[: self.n - self.window + 1], slide(np.minimum, a, w), np.uint64(0))
        pad = np.zeros(w - 1, np.uint64)
        top = slide(np.maximum, np.concatenate([pad, least, pad]), w)
        at = np.flatnonzero((top == a) & (a > 0))
        return at, a[at]


def nulls(rows: int, ids: pa.Array | None, id_type: pa.DataType, kinds: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    """A batch of doc_id and kinds, null where no column is given."""
    cols = [ids if ids is not None else pa.nulls(rows, id_type)]
    cols += [pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", *kinds])


class Cutter:
    """The first pass: a row for each text, the anchors of the classes by shard, and those that a block has several of."""

    KINDS = {"n": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "sha": pa.string(), "places": pa.binary(), "shard": pa.int32(), "payload": pa.binary()}
    SCHEMA = "n long, k1 long, k2 long, sha string, places binary, shard int, payload binary"

    def __init__(self, window: int, shards: int, key):
        self.window, self.shards, self.key = window, shards, key

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = {}, set()
        hashes, keys, size = [], [], 0
        kind = None
        for b in batches:
            kind, rows = b.column(0).type, []
            for t in b.column(1).to_pylist():
                words = (t or b"").split()
                joined = b" ".join(words)
                key = self.key(joined)
                rows.append((len(words), *key, hashlib.sha256(joined).hexdigest()))
                if len(words) >= self.window and key not in met:
                    met.add(key)
                    hashes.append(word_hashes(words, known))
                    keys.append(key)
                    size += len(words)
                    if len(known) > 300_000:
                        known.clear()
                    if size > BLOCK_WORDS:
                        yield from self.flush(kind, hashes, keys)
                        hashes, keys, size = [], [], 0
                        met.clear()
            yield nulls(len(rows), b.column(0), kind, self.KINDS, **{c: [r[i] for r in rows] for i, c in enumerate(("n", "k1", "k2", "sha"))})
        if hashes:
            yield from self.flush(kind, hashes, keys)

    def flush(self, kind: pa.DataType, hashes: list, keys: list) -> Iterator[pa.RecordBatch]:
        w = Words(hashes, self.window)
        at, anchor = w.anchors(self.window // 2)
        order = np.argsort(anchor, kind="stable")
        at, anchor = at[order], anchor[order]
        k1, k2 = np.array(keys, np.int64).T
        doc = w.doc[at]
        place = (at - w.begin[doc]).astype(np.uint32)
        first = starts(anchor)
        n = np.diff(np.append(first, len(anchor)))
        several = np.repeat(n > 1, n)
        yield from self.placed(kind, k1[doc[several]], k2[doc[several]], place[several])
        shard = ((anchor[first] >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        cuts = starts(shard)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
            f = first[lo:hi]
            used, local = np.unique(doc[f], return_inverse=True)
            payload = pack(anchor[f], local.astype(np.uint32), place[f], (n[lo:hi] > 1).astype(np.uint8), k1[used], k2[used])
            yield nulls(1, None, kind, self.KINDS, shard=[int(shard[lo])], payload=[payload])

    def placed(self, kind: pa.DataType, k1: np.ndarray, k2: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(k1):
            own = by_text(place, k1, k2)
            yield nulls(len(own[0]), None, kind, self.KINDS, places=own[0], k1=own[1], k2=own[2])


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def by_text(place: np.ndarray, *text: np.ndarray) -> list[list]:
    """The packed places of each text, then what names it."""
    order = np.lexsort((place, *reversed(text)))
    place, text = place[order].astype(np.uint32), [t[order] for t in text]
    at = np.flatnonzero(changes(*text))
    return [[pack(x) for x in np.split(place, at[1:])], *(t[at].tolist() for t in text)]


def repeated_anchors(table: pa.Table) -> pa.Table:
    """k1, k2, places of the anchors that several blocks of the shard have."""
    parts = [unpack(p, "<u8", "<u4", "<u4", "u1", "<i8", "<i8") for p in table["payload"].to_pylist()]
    anchor, place, told = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
    k1, k2 = (np.concatenate([p[i][p[1]] for p in parts]) for i in (4, 5))
    order = np.argsort(anchor, kind="stable")
    anchor, k1, k2, place, told = anchor[order], k1[order], k2[order], place[order], told[order]
    at = starts(anchor)
    n = np.diff(np.append(at, len(anchor)))
    differ = lambda x: np.maximum.reduceat(x, at) != np.minimum.reduceat(x, at)  # noqa: E731  copies of a class are one
    keep = np.repeat(differ(k1) | differ(k2) | differ(place) | (np.maximum.reduceat(told, at) > 0), n) & (told == 0)
    places, a, b = by_text(place[keep], k1[keep], k2[keep]) if keep.any() else ([], [], [])
    return pa.table({"k1": pa.array(a, pa.int64()), "k2": pa.array(b, pa.int64()), "places": pa.array(places, pa.binary())})


def by_block(table: pa.Table) -> pa.Table:
    """low, k1, k2, later: of each text of an input block the places that come later in their nodes."""
    parts = [unpack(p, "<u4", "<u4", "<i8", "<i8", "<i8") for p in table["later"].to_pylist()]
    place = np.concatenate([p[1] for p in parts])
    later, *names = by_text(place, *(np.concatenate([p[i][p[0]] for p in parts]) for i in (2, 3, 4)))
    return pa.table({**{c: pa.array(x, pa.int64()) for c, x in zip(("low", "k1", "k2"), names, strict=True)}, "later": pa.array(later, pa.binary())})


class Suffixes:
    """The second pass: suffixes whose window has a repeated anchor, by group; those that come later within a block are told apart here."""

    KINDS = {"block": pa.int64(), "later": pa.binary(), "shard": pa.int64(), "m": pa.int32(), "payload": pa.binary()}
    SCHEMA = "block long, later binary, shard long, m int, payload binary"

    def __init__(self, window: int, groups: int, key):
        self.window, self.groups, self.key = window, groups, key

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        texts, size = [], 0
        for b in batches:
            for t, low, k1, k2, places in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                words = (t or b"").split()
                if self.key(b" ".join(words)) != (k1, k2):
                    continue
                at = np.unique(np.concatenate([unpack(p, "<u4")[0] for p in places])).astype(np.int64)
                texts.append((word_hashes(words, known), np.array([len(w) for w in words], np.int64), (low, k1, k2), at))
                size += len(words)
                if len(known) > 300_000:
                    known.clear()
                if size > BLOCK_WORDS:
                    yield from self.flush(texts)
                    texts, size = [], 0
        if texts:
            yield from self.flush(texts)

    def batch(self, **columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in self.KINDS.items()], names=list(self.KINDS))

    def flush(self, texts: list) -> Iterator[pa.RecordBatch]:
        w = Words([t[0] for t in texts], self.window)
        names = np.array([(*t[2], texts[0][2][1]) for t in texts], np.int64).T  # the last names the block
        anchor = np.concatenate([t[3] + b for t, b in zip(texts, w.begin, strict=True)])
        delta = np.zeros(w.n + 1, np.int64)
        np.add.at(delta, np.maximum(w.begin[w.doc[anchor]], anchor - (self.window - self.window // 2)), 1)
        np.add.at(delta, anchor + 1, -1)
        at = np.flatnonzero((np.cumsum(delta[:-1]) > 0) & w.whole)
        node, doc = w.runs(at, self.window), w.doc[at]
        place = (at - w.begin[doc]).astype(np.uint32)
        order = np.lexsort((place, *(x[doc] for x in names[2::-1]), node))
        new = changes(node[order])
        for j in range(self.window):  # equal hashes are held against the words
            new |= changes(w.h[at[order] + j])
        first, later = self.told_apart(order, new, doc, place, names)
        yield from later
        at, node, doc, place = at[first], node[first], doc[first], place[first]
        size = np.concatenate([[0], np.cumsum(np.concatenate([t[1] for t in texts]))])
        prefix = w.runs(at, np.clip(np.searchsorted(size, size[at] + PREFIX_BYTES) - at, 1, self.window))
        group = ((prefix >> np.uint64(32)) * np.uint64(self.groups) >> np.uint64(32)).astype(np.int64)
        short = (w.h >> np.uint64(48)).astype(np.uint16)
        check = w.runs(at, self.window, w.summed(mix64(w.h))).view(np.uint16).reshape(-1, 4)[:, :CHECK]
        yield from self.dealt(group, node, lambda f: np.hstack([short[at[f][:, None] + np.arange(self.window)], check[f]]), doc, place, names)

    def told_apart(self, order: np.ndarray, new: np.ndarray, doc: np.ndarray, place: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, list[pa.RecordBatch]]:
        """The first suffix of each node, and a batch of those that come later in theirs. A suffix of a row that is there twice is one."""
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        same = place[order] == place[head]
        for x in names[:3]:
            same &= x[doc[order]] == x[doc[head]]
        later = order[~new & ~same]
        if not len(later):
            return order[new], []
        out, later = [], later[np.argsort(names[3][doc[later]], kind="stable")]
        for f in np.split(later, starts(names[3][doc[later]])[1:]):
            used, local = np.unique(doc[f], return_inverse=True)
            block = int(names[3][used[0]])
            out.append(self.batch(block=[block], later=[pack(local.astype(np.uint32), place[f], *(x[used] for x in names[:3]))], shard=[block % self.groups]))
        return order[new], out

    def dealt(self, group: np.ndarray, node: np.ndarray, words_of, doc: np.ndarray, place: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each group, with the suffixes that go there, their words in 16 bits each and CHECK more of the whole window."""
        order = np.argsort(group, kind="stable")
        cuts = starts(group[order])
        for f in np.split(order, cuts[1:]) if len(order) else []:
            used, local = np.unique(doc[f], return_inverse=True)
            yield self.batch(shard=[int(group[f[0]])], m=[len(f)], payload=[pack(node[f], words_of(f), local.astype(np.uint32), place[f], *(x[used] for x in names))])

    def held(self, payloads: list[bytes]) -> tuple[np.ndarray, ...]:
        """node, words, doc, place, names of the suffixes of several rows."""
        parts = [unpack(p, "<u8", "<u2", "<u4", "<u4", "<i8", "<i8", "<i8", "<i8") for p in payloads]
        before = np.cumsum([0] + [len(p[4]) for p in parts])
        node, words, place = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
        doc = np.concatenate([p[2] + b for p, b in zip(parts, before, strict=False)])
        return node, words.reshape(-1, self.window + CHECK), doc, place, np.array([np.concatenate([p[i] for p in parts]) for i in (4, 5, 6, 7)])

    def subtrees(self, length: int | None):
        """What comes later in its node, of a group of suffixes; it holds GROUP_SUFFIXES at a time and the firsts of those before.

        A group of too many firsts is dealt out anew by prefixes of length words, as PIECES groups. Without a length there is no
        longer prefix, and such a group is gone through as it is. Rows of what is known to come later pass.
        """

        limit = GROUP_SUFFIXES

        def in_group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            payloads, n, dealt = [], 0, False
            for b in batches:
                b = b.select(list(self.KINDS))
                known = b.filter(b["payload"].is_null())
                if known.num_rows:
                    yield known.set_column(known.schema.get_field_index("shard"), "shard", pa.nulls(known.num_rows, pa.int64()))
                for payload, m in zip(b["payload"].to_pylist(), b["m"].to_pylist(), strict=True):
                    if payload is None:
                        continue
                    payloads.append(payload)
                    n += m
                    if n > limit:
                        later, firsts = self.merged(payloads)
                        yield from later
                        n = len(firsts[0])
                        if length and n > limit // 2:
                            dealt = True
                            yield from self.cut_again(key[0].as_py(), length, *firsts)
                            payloads, n = [], 0
                        else:
                            payloads = next(self.dealt(np.zeros(n, np.int64), *firsts))["payload"].to_pylist()
            if payloads:
                later, firsts = self.merged(payloads)
                yield from later
                if dealt:
                    yield from self.cut_again(key[0].as_py(), length, *firsts)

        return in_group

    def merged(self, payloads: list[bytes]) -> tuple[list[pa.RecordBatch], tuple]:
        """Batches of what comes later, and the first suffix of each node."""
        node, words, doc, place, names = self.held(payloads)
        order, common = ordered(words, node, place, [x[doc] for x in names[:3]])
        first, later = self.told_apart(order, common < self.window, doc, place, names)
        words = words[first]
        return [b.set_column(b.schema.get_field_index("shard"), "shard", pa.nulls(b.num_rows, pa.int64())) for b in later], (node[first], lambda f: words[f], doc[first], place[first], names)

    def cut_again(self, shard: int, length: int, node: np.ndarray, words_of, doc: np.ndarray, place: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Suffixes of a group, dealt to PIECES groups by prefixes of so many words."""
        words = words_of(np.arange(len(node)))
        prefix = np.full(len(node), shard & (1 << 64) - 1, np.uint64)
        old = mix64(prefix)
        for j in range(length):
            prefix = mix64(prefix * BASE + words[:, j])
        piece = (prefix >> np.uint64(32)) * np.uint64(PIECES) >> np.uint64(32)
        return self.dealt(mix64(old + piece).view(np.int64), node, words_of, doc, place, names)


def ordered(words: np.ndarray, node: np.ndarray, place: np.ndarray, names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes by their words, then by id and place; and of each how many words it begins with as the one before does.

    Words are 16 bits here, followed by CHECK such parts of a hash of the window; suffixes in which all this is equal have a
    whole window in common if the other hashes of their windows (node) agree too.
    """
    n, width = words.shape
    window = width - CHECK
    wide = np.zeros((n, -(-width // 4) * 4), np.uint64)
    wide[:, :width] = words
    parts = wide[:, ::4] << np.uint64(48) | wide[:, 1::4] << np.uint64(32) | wide[:, 2::4] << np.uint64(16) | wide[:, 3::4]
    order = np.lexsort((place, *reversed(names), node, *parts.T[::-1]))
    common = np.zeros(n, np.int64)
    w, node = words[order], node[order]
    differ = w[1:] != w[:-1]
    alike = ~differ.any(axis=1) & (node[1:] == node[:-1])
    common[1:] = np.where(alike, window, np.where(differ.any(axis=1), np.minimum(differ.argmax(axis=1), window - 1), window - 1))
    return order, common


def spans_of(places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of words that windows at these places cover."""
    places = np.unique(places).astype(np.int64)
    new = np.concatenate([[True], places[1:] > places[:-1] + window])
    begin = places[new]
    end = places[np.concatenate([new[1:], [True]])] + window
    return begin, end


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", key=key_of) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, spans (begin and end of removed words).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, unchanged. A window of that many words repeats if its words also
    start earlier: in a smaller integer id, or before in the same text. Each word that a repeating window covers is
    removed. Null texts have no words; texts of fewer words than a window lose none. Null ids count as larger than all
    others. Rows that repeat both id and text are one document and share its result. Empty tables give empty results.
    key gives 128 bits of the words, as two signed numbers; texts are equal if both are. Ids have to be integers: others
    raise a ValueError.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} has to be an integer, as smaller ids start earlier")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    cutter, suffixes = Cutter(window, shards_for(chars), key), Suffixes(window, int(max(8, chars // GROUP_CHARS)), key)
    keys, names = ["k1", "k2"], ["low", "k1", "k2"]

    cut = stash(rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(cutter.run, f"doc_id long, {Cutter.SCHEMA}"), "none")
    people = cut.where("n is not null").select("doc_id", "n", *keys, "sha")
    known = F.coalesce("doc_id", F.lit(LAST))
    classes = stash(people.where(F.col("n") >= window).groupBy(*keys).agg(F.min(known).alias("low"), F.count(F.lit(1)).alias("members")))

    found = cut.where("shard is not null").select("shard", "payload").groupBy("shard").applyInArrow(repeated_anchors, "k1 long, k2 long, places binary")
    anchors = cut.where("places is not null").select(*keys, "places").unionByName(found).groupBy(*keys).agg(F.collect_list("places").alias("places"))
    anchors = stash(anchors.join(classes.select("low", *keys), keys).select(*names, "places"), "none")
    ends = reread(rows, anchors).select(F.col("text").cast("binary"), *names, "places").mapInArrow(suffixes.run, Suffixes.SCHEMA)

    told = []
    for length in [*(n for n in (8, 16, 32, 64) if n < window), window, None]:
        looked = stash(ends.groupBy("shard").applyInArrow(suffixes.subtrees(length), Suffixes.SCHEMA), "none")
        told.append(looked.where("later is not null").select("block", "later"))
        ends = looked.where("payload is not null")
        if ends.limit(1).count() == 0:
            break
    texts = reduce(DataFrame.unionByName, told).groupBy("block").applyInArrow(by_block, "low long, k1 long, k2 long, later binary")
    later = stash(texts.groupBy(*names).agg(F.collect_list("later").alias("later")), "none")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, k1, k2, parts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = (t or b"").split()
                if key(b" ".join(words)) != (k1, k2):
                    continue
                begin, end = spans_of(np.concatenate([unpack(p, "<u4")[0] for p in parts]), window)
                kept, at = [], 0
                for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                out.append((k1, k2, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"begin": x, "end": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)]))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), span))], names=[*keys, "gone", "left_sha", "spans"])

    lost = reread(rows, later).select(F.col("text").cast("binary"), *keys, "later").mapInArrow(removed, "k1 long, k2 long, gone long, left_sha string, spans array<struct<begin:bigint,end:bigint>>")
    owners = stash(classes.join(lost.dropDuplicates(keys), keys, "left"))

    least = max(64, int(people.count() * HOT_SHARE) + 1)
    long_ = with_group(people.where(F.col("n") >= window), owners, keys, "members", least)
    own = known == F.col("low")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")))
    long_ = long_.select(
        "doc_id", F.col("n").alias("n_words"), F.when(own, F.coalesce("gone", F.lit(0))).otherwise(F.col("n")).cast("long").alias("n_removed"),
        F.when(own, F.coalesce("left_sha", "sha")).otherwise(F.lit(EMPTY)).alias("kept_sha256"), F.when(own, F.coalesce("spans", F.expr("array()"))).otherwise(whole).alias("spans"),
    )
    short = people.where(F.col("n") < window).select("doc_id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)").alias("spans"))
    return long_.unionByName(short)


def reread(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted ids with what is known of them; ids are sent ahead, if they are few, so that only these texts move."""
    ids = wanted.select(F.col("low").alias("id")).distinct()
    n = ids.count()
    some = rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    if n <= SENT_ROWS:
        some = some.join(F.broadcast(ids), "id", "left_semi")
    return some.join(wanted, some["id"] == wanted["low"]).select("text", *wanted.columns)


def without_spans(text: str, spans: list) -> str:
    """The kept words of a text, joined by one space."""
    words, out, at = text.encode().split(), [], 0
    for s in spans:
        out += words[at : s["begin"]]
        at = s["end"]
    return b" ".join(out + words[at:]).decode()


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
