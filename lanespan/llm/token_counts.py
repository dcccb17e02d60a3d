"""Token counts by prefix dynamic programming over a byte-pair vocabulary with ranked pieces.

For each prefix of a segment the last token of its encoding is unique, and a sequence of tokens is an encoding if
and only if each adjacent pair is one. So last[i] is the vocabulary piece s[j:i] that is compatible with last[j],
and count[i] = count[j] + 1: exact counts for all prefixes in one pass. No piece holds a blank after another
character, so texts split before runs of blanks into segments whose counts add up; segments repeat, and each
worker keeps the steps from prefix to prefix of those that it has met. A text's steps are those of its segments, one
byte a character; they are what is stored, and every count, truncation and budget comes from them. The vocabulary's
sign for a blank is a blank for the library, wherever it stands in a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "piece_bpe_32k.model"
LIMIT = 4096
#: Entries a worker remembers; at that number it starts afresh. Only speed depends on it.
REMEMBERED = 1_000_000
BLANK = "▁"
SEGMENT = re.compile(r" *[^ \n\t]+| +|[\n\t]")


class PrefixCounter:
    """Exact token counts at every prefix, as the library encodes (no begin, end or added special tokens)."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        assert not any(BLANK in p.lstrip(BLANK) or re.search(r"[ \n\t]", p) for p in self.score)
        #: The beginnings of pieces; true for those that are pieces themselves.
        self.starts = {p[:k]: False for p in self.score for k in range(1, len(p))} | dict.fromkeys(self.score, True)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        outer = self

        class Steps(dict):
            """By segment; the first segment of a text has a blank of its own before it, whose token counts with the first character."""

            def __init__(self, first: bool):
                self.first = first

            def __missing__(self, segment: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.clear()
                s = segment.replace(" ", BLANK)
                if not self.first:
                    counts = outer.prefixes(s)
                elif s in "\n\t":  # no piece holds it, so the blank is a token of its own
                    counts = [0, *(1 + n for n in outer.prefixes(s)[1:])]
                else:
                    counts = [0, *outer.prefixes(BLANK + s)[2:]]
                self[segment] = out = np.diff(counts).astype("i1", casting="same_kind").tobytes()
                return out

        self.firsts, self.rest = Steps(True), Steps(False)

    def merged(self, text: str) -> list[str]:
        """The encoding by merges: of all adjacent pairs that form a piece the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        after = self.pairs.get(a)
        if after is None:
            after = self.pairs[a] = {}
        ok = after.get(b)
        if ok is None:
            self.n_pairs += 1
            if self.n_pairs > REMEMBERED:
                self.pairs, self.n_pairs = {a: (after := {})}, 1
            ok = after[b] = self.merged(a + b) == ([a, b] if a else [b])
        return ok

    def prefixes(self, s: str) -> list[int]:
        """count[i]: tokens of s[:i], for i from 0 to len(s). Characters without a piece become their UTF-8 bytes."""
        n, starts, pairs = len(s), self.starts, self.pairs
        count, last = [0] * (n + 1), [None] * (n + 1)
        last[0] = ""
        for j in range(n):
            prior = last[j]
            after = pairs.get(prior)
            for i in range(j + 1, n + 1):
                piece = s[j:i]
                kind = starts.get(piece)
                if kind is None:
                    break
                if kind and last[i] is None:
                    ok = after.get(piece) if after is not None else None
                    if self.compatible(prior, piece) if ok is None else ok:
                        last[i], count[i] = piece, count[j] + 1
            if last[j + 1] is None:
                last[j + 1], count[j + 1] = "", count[j] + len(s[j].encode("utf-8", "surrogatepass"))
        return count

    def steps(self, text: str) -> bytes:
        """count[p] - count[p - 1] for each prefix text[:p], a signed byte each (a piece has less than 32 characters of up to 4 bytes)."""
        parts = SEGMENT.findall(text.replace(BLANK, " "))
        return self.firsts[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:])) if parts else b""

    def counts(self, text: str) -> np.ndarray:
        """count[p]: tokens of text[:p] for p from 0 to len(text)."""
        return counts_of(self.steps(text))


def counts_of(steps: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, "i1"), dtype=np.int64)])


def last_of(steps: bytes) -> int:
    """The last count."""
    return int(np.frombuffer(steps, "i1").sum(dtype=np.int64))


def within(steps: bytes, budget: int) -> int:
    """The longest prefix, in characters, of no more than budget tokens."""
    if budget < 0:
        return 0
    if last_of(steps) <= budget:
        return len(steps)
    return int(np.flatnonzero(counts_of(steps) <= budget)[-1])


def pack(steps: bytes) -> bytes:
    """As stored: deflated with a frame that names its size."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(steps)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def tokens_of(data: bytes, chars: int) -> int:
    """Tokens of the first chars characters, from the stored prefix counts."""
    steps = unpack(data)
    return last_of(steps[: max(0, chars)])


def truncate_at(data: bytes, budget: int) -> int:
    """The longest prefix, in characters, of no more than budget tokens, from the stored prefix counts."""
    return within(unpack(data), budget)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """One per worker process and model; model is a path, or a name that public_tokenizers resolves on the worker."""
    if model not in _COUNTERS:
        import os

        import public_tokenizers

        _COUNTERS[model] = PrefixCounter(model if os.path.sep in model else public_tokenizers.path(model))
    return _COUNTERS[model]


def token_counts(docs: DataFrame, model: str = PIECES, limit: int = LIMIT, with_prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, fits_chars (the longest prefix of no more than limit
    tokens), and with_prefixes the packed counts of all prefixes; the other columns are read off these counts.

    Null texts count as empty, and empty texts have no tokens. Ids may be null or repeat: rows are independent. Other
    columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            steps = [c.steps(t) for t in texts]
            n = [last_of(x) for x in steps]
            fits = [len(x) if k <= limit else within(x, limit) for x, k in zip(steps, n, strict=True)]
            cols = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fits, pa.int64())]
            if with_prefixes:
                cols.append(pa.array([pack(x) for x in steps], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars", "prefixes"][: len(cols)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long" + ", prefixes binary" * with_prefixes)


def query(spark, sf_dir: str) -> DataFrame:
    """The counts of all prefixes are made for each row; the digest leaves them out."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_prefixes=True).drop("prefixes")
