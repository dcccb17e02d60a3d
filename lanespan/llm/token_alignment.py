"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes differently. Every token points to the token of the other side that overlaps it and
reaches farthest right; where both sides end together, the left token is its own successor. Squaring the successors
(each round follows twice as many of them, for all tokens of many texts at once) ends at the last token of each
component: components are the smallest groups of tokens with the same bytes on both sides, and their last tokens are
the links between the vocabularies.

Texts are encoded by segments, which worker processes remember: neither tokenizer joins what stands before a single blank
between two other characters with what begins there. Segments whose tokens do not give their bytes back send their text
to the libraries as a whole.

What ends together has one token's bytes as a suffix of the other's, so the table of linked id pairs has at most as many
rows as all tokens have suffixes (about half a million for these vocabularies), however large the corpus is. It is
counted by Spark and sent to all workers; all else stays with its document.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import pack, starts, stash, unpack

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments a worker remembers; beyond that number only those of the text at hand stay. Only speed depends on it.
REMEMBERED = 600_000
#: Bytes of text that are aligned at once, if no single text has more.
BLOCK_BYTES = 4_000_000
#: Rows of the local table of pairs at which its parts are added up.
MERGE_PAIRS = 2_000_000
SEGMENT = re.compile(r"\s*\S+(?:(?! \S)\s+\S+)*(?:\s+\Z)?|\s+")
AFTER = ",|;", ""


def byte_of_char() -> dict[str, int]:
    """The inverse of the byte-level alphabet: printable bytes stand for themselves, the others for what follows U+0100, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and the ids of the segments met."""

    def __init__(self, left: str, right: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(left)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        code, vocabulary = byte_of_char(), self.left.get_vocab()
        self.left_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.left_bytes[i] = bytes(map(code.__getitem__, token))
        pieces = range(self.right.get_piece_size())
        self.right_bytes = [bytes([int(p[3:-1], 16)]) if self.right.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.right.id_to_piece(i)) for i in pieces)]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.left_bytes, self.right_bytes)]
        self.texts = [f"{i}{c}" for i in range(max(map(len, self.sizes))) for c in (*AFTER[0], AFTER[1])]
        self.known: tuple[dict, dict] = {}, {}
        self.odd: set[str] = set()

    def encoded(self, spaced: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids on both sides of texts with a blank before them."""
        return [x.ids for x in self.left.encode_batch_fast(spaced, add_special_tokens=False)], self.right.encode([s[1:] for s in spaced], num_threads=1)

    def same(self, data: bytes, a: Iterable[int], b: Iterable[int]) -> bool:
        """Whether ids give these bytes back on both sides."""
        return b"".join(map(self.left_bytes.__getitem__, a)) == data == b"".join(map(self.right_bytes.__getitem__, b))

    def learn(self, segments: set[str]) -> None:
        new = list(segments - self.known[0].keys())
        if len(self.known[0]) + len(new) > REMEMBERED:  # what this block has stays
            for known in self.known:
                stay = {s: known[s] for s in segments if s in known}
                known.clear()
                known.update(stay)
        if not new:
            return
        both = self.encoded(new)
        for known, ids in zip(self.known, both, strict=True):
            flat = np.fromiter(chain.from_iterable(ids), "<i4").tobytes()
            at = list(accumulate((4 * len(x) for x in ids), initial=0))
            known.update(zip(new, (flat[lo:hi] for lo, hi in pairwise(at)), strict=True))
        if not self.same("".join(new).encode(), *map(chain.from_iterable, both)):
            self.odd |= {s for s, a, b in zip(new, *both, strict=True) if not self.same(s.encode(), a, b)}

    def ids(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids on both sides, four bytes each; none for empty texts and those whose bytes are not given back."""
        cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        self.learn({s for segments in cut for s in segments})
        left, right = (k.__getitem__ for k in self.known)
        out = []
        for t, segments in zip(texts, cut, strict=True):
            if self.odd and not self.odd.isdisjoint(segments):
                (a,), (b,) = self.encoded([" " + t])
                same = self.same((" " + t).encode(), a, b)
                out.append((np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()) if same else (b"", b""))
            else:
                out.append((b"".join(map(left, segments)), b"".join(map(right, segments))))
        return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(left: str, right: str) -> Pair:
    """One per worker process; names without a path are resolved on the worker."""
    if (left, right) not in _PAIRS:
        import public_tokenizers

        _PAIRS[left, right] = Pair(*(x if os.path.sep in x else public_tokenizers.path(x) for x in (left, right)))
    return _PAIRS[left, right]


def terminals(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens with so many bytes on each side, all bytes the same: the last left token of each token's component, for both sides."""
    n, ends = len(left), (np.cumsum(left), np.cumsum(right))
    holder = np.repeat(np.arange(len(right)), right)  # the right token at each byte
    over = holder[ends[0] - 1]
    follow = np.empty(n + len(right), np.int64)
    follow[:n] = np.where(ends[1][over] > ends[0], n + over, np.arange(n))
    follow[n:] = np.repeat(np.arange(n), left)[ends[1] - 1]
    while True:
        farther = follow[follow]
        if np.array_equal(farther, follow):
            return follow[:n], follow[n:]
        follow = farther


class Aligned:
    """Texts of a block, aligned: all arrays run over the tokens or groups of the texts one after the other."""

    def __init__(self, pair: Pair, ids: list[tuple[bytes, bytes]]):
        self.pair = pair
        self.n = [np.array([len(x[k]) // 4 for x in ids], np.int64) for k in (0, 1)]
        self.a, self.b = (np.frombuffer(b"".join(x[k] for x in ids), "<i4").astype(np.int64) for k in (0, 1))
        sizes = pair.sizes[0][self.a], pair.sizes[1][self.b]
        last_a, last_b = terminals(*sizes) if len(self.a) else (np.zeros(0, np.int64),) * 2
        self.ends = np.flatnonzero(last_a == np.arange(len(last_a)))  # the left tokens that close groups
        number = np.zeros(len(self.a), np.int64)
        number[self.ends] = np.arange(len(self.ends))
        self.group = number[last_a], number[last_b]
        self.closers = np.searchsorted(self.group[1], np.arange(len(self.ends)), "right") - 1  # and the right ones
        first = [np.concatenate([[0], np.cumsum(n)]) for n in self.n]
        self.first = first
        self.first_group = np.searchsorted(self.ends, first[0])
        self.byte_ends = np.cumsum(sizes[0])[self.ends] if len(self.a) else self.ends

    def texts(self) -> Iterator[str]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        kinds = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        kinds[0][self.ends], kinds[1][self.closers] = 1, 2
        kinds[1][self.first[1][1:][self.n[1] > 0] - 1] = 3
        line = np.empty(len(self.a) + len(self.b), np.int64)
        right_before = np.concatenate([[0], self.closers + 1])
        line[np.arange(len(self.a)) + right_before[self.group[0]]] = self.a * 4 + kinds[0]
        line[np.arange(len(self.b)) + (self.ends + 1)[self.group[1]]] = self.b * 4 + kinds[1]
        both = self.first[0] + self.first[1]
        for lo, hi in zip(both[:-1], both[1:], strict=True):
            yield "".join(map(self.pair.texts.__getitem__, line[lo:hi].tolist()))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each text (left id * right ids + right id), how often each, and where each text's begin."""
        width = len(self.pair.sizes[1])
        keys = self.a[self.ends] * width + self.b[self.closers]
        doc = np.repeat(np.arange(len(self.n[0])), np.diff(self.first_group))
        all_ = width * len(self.pair.sizes[0])
        both = np.sort(doc * all_ + keys)
        at = starts(both)
        return both[at] % all_, np.diff(np.append(at, len(both))), np.searchsorted(both[at], np.arange(len(self.n[0]) + 1) * all_)


class Totals:
    """Pairs and their links of a partition."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.rows += len(keys)
        if self.rows > MERGE_PAIRS:
            self.parts = [self.merged()]
            self.rows = min(len(self.parts[0][0]), MERGE_PAIRS // 2)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([p[1] for p in self.parts]), len(keys)).astype(np.int64)


KINDS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "links": pa.binary(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64()}
MORE = {"groups": pa.string(), "ends": pa.list_(pa.int64())}


def cut(docs: DataFrame, left: str = LEFT, right: str = RIGHT, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds, written: one for each document (n_a not null) with its packed links, and those of its partition's pairs (a, b, n)."""
    kinds = KINDS | (MORE if with_groups else {})

    def batch(ids: pa.Array | None, id_type: pa.DataType, **columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        cols = [ids if ids is not None else pa.nulls(rows, id_type)]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in kinds.items())], names=["doc_id", *kinds])

    def block(pair: Pair, ids: pa.Array, texts: list[str], totals: Totals) -> pa.RecordBatch:
        x = Aligned(pair, pair.ids(texts))
        lines = list(x.texts())
        keys, n, at = x.links()
        totals.add(keys, n)
        cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        columns = {
            "n_a": x.n[0], "n_b": x.n[1], "n_groups": np.diff(x.first_group),
            "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in lines],
            "links": [pack(keys[lo:hi], n[lo:hi].astype("<u4")) for lo, hi in cuts],
        }
        if with_groups:
            begin = np.concatenate([[0], x.byte_ends])[x.first_group[:-1]]
            columns |= {"groups": lines, "ends": [x.byte_ends[lo:hi] - b for lo, hi, b in zip(x.first_group[:-1], x.first_group[1:], begin, strict=True)]}
        return batch(ids, ids.type, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, totals, kind = pair_of(left, right), Totals(), None
        for b in batches:
            kind, texts, lo, size = b.column(0).type, [t or "" for t in b.column(1).to_pylist()], 0, 0
            for hi, t in enumerate(texts, 1):
                size += len(t)
                if size >= BLOCK_BYTES or hi == len(texts):
                    yield block(pair, b.column(0).slice(lo, hi - lo), texts[lo:hi], totals)
                    lo, size = hi, 0
        keys, n = totals.merged()
        if len(keys):
            width = len(pair.sizes[1])
            yield batch(None, kind, a=keys // width, b=keys % width, n=n)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary, a int, b int, n long" + ", groups string, ends array<long>" * with_groups
    return stash(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}"), "none")


def pair_counts(written: DataFrame) -> DataFrame:
    """a, b, n: in how many links of the corpus an id of the left vocabulary and one of the right are linked."""
    return written.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, left: str = LEFT, right: str = RIGHT, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with_groups the groups
    as `a1,a2|b1;a3|b2,b3` and `ends`, the byte of the text with a blank before it at which each group ends.

    left is a byte-level vocabulary that reads the text after a blank, right one that adds the blank itself. Null and
    empty texts, and texts whose bytes are not given back on both sides, have no tokens and no links: zeros and an empty
    string. n_best counts the links whose pair is the most frequent of its right id in the corpus, ties included;
    count_sum adds up the links' corpus counts. Rows are independent, so ids may be null or repeat, and repeated rows all
    count. An empty table gives an empty result. Other columns are not read.
    """
    written = cut(docs, left, right, with_groups, id_col, text_col)
    spark = docs.sparkSession
    table = pair_counts(written).toArrow()  # bounded by the vocabularies
    a, b, n = (table[c].to_numpy().astype(np.int64) for c in "abn")
    width = int(b.max()) + 1 if len(b) else 1
    best = np.zeros(width, np.int64)
    np.maximum.at(best, b, n)
    order = np.lexsort((b, a))
    sent = spark.sparkContext.broadcast((a[order], b[order], n[order], n[order] == best[b[order]]))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(left, right)
        a, b, n, top = sent.value
        known = a * len(pair.sizes[1]) + b
        for batch in batches:
            out = []
            for data in batch.column("links").to_pylist():
                keys, times = unpack(data, "<i8", "<u4")
                at, times = np.searchsorted(known, keys), times.astype(np.int64)
                out.append((int(times.sum()), int(times[top[at]].sum()), int((times * n[at]).sum())))
            cols = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")] + [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(MORE if with_groups else {})]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c) for c in names[7:])], names=names)

    rows = written.where("n_a is not null").drop("a", "b", "n")
    schema = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string, ends array<long>" * with_groups
    return rows.mapInArrow(looked_up, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
