"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel of two words: the gap-weighted count of common three-letter subsequences that lie within SPAN letters, each
weighted by DECAY for every letter it spans, normalised to 1 for equal words; a word's beginning counts as a letter. It
tolerates inserted, dropped and gapped letters. Values up to CUT count as none, so that only words that are much alike
meet, and the kernel of two sentences is the sum over pairs of their words. Landmarks are words of labelled sentences:
those around which words gather that stand out in toxic documents, whatever their language, and the plain words most
like them. A linear support vector machine with squared hinge loss is trained on the Nyström features of sentences. Only
documents carry labels, so the toxic sentences of a document are taken to be those that the machine of the round before
scores highest. As the kernel adds up over words, the machine gives each word a value of its own. A second machine over
a document's highest word values and its length, made a probability, is the document's score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanespan.llm.common import stash

SPAN, DECAY, CUT = 5, 0.7, 0.5
#: Bounds of the training sample: labelled rows of each class, characters altogether and of one text. Scoring has no bounds.
SAMPLE_ROWS, SAMPLE_CHARS, TEXT_CHARS = 1500, 8_000_000, 250_000
TOXIC_LANDMARKS, PLAIN_LANDMARKS = 48, 16
#: Words that landmarks are chosen from, and plain words that they are held against.
CANDIDATES, AGAINST = 600, 3000
#: Words longer than this are looked at in overlapping pieces of this length.
PIECE = 24
CHUNK_CHARS = 4_000_000
#: Words that a worker remembers; beyond that it starts afresh. Only speed depends on it.
REMEMBERED = 500_000
#: The highest word values of a document that its score is made of.
TOP = 6
#: Words of a smaller value, as a share of a full one, count as none.
LEAST = 0.15
#: Groups of landmarks by likeness.
GROUPS = 16

BOUND = re.compile(r"(?<=[.!?])\s+|\n+")
EDGES = re.compile(r"^[^\w\n]+|[^\w\n]+$", re.M)

# Digits and signs that stand for letters, and base letters of accented ones.
LOOKS = str.maketrans("0134578@$!|àáâãäåæçèéêëìíîïñòóôõöøùúûüýß", "oieastbasilaaaaaaaceeeeiiiinoooooouuuuys")
#: The sign next after z stands before a word; letters and it count from 1 in subsequences.
BEGIN, BASE = b"{", 28
NO_LETTERS = bytes(b for b in range(128) if not 97 <= b <= 122 and b != 10)

PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def spelled(words: list[str]) -> list[bytes]:
    """Letters of words behind BEGIN; signs within a word are left out, those at its ends do not count as letters."""
    if not words:
        return []
    whole = EDGES.sub("", "\n".join(words)).translate(LOOKS).encode("ascii", "ignore")
    return [BEGIN + c for c in whole.translate(None, NO_LETTERS).split(b"\n")]


def single_letters(words: list[str]) -> list[str]:
    """Each run of three or more words of one letter (and perhaps a sign after it), joined to one word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    short = np.concatenate([[False], size <= 2, [False]])
    change = np.flatnonzero(short[1:] != short[:-1])
    out = []
    for lo, hi in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        if hi - lo < 3:
            continue
        run: list[str] = []
        for w in [*words[lo:hi], "--"]:
            letters = [c for c in w if c.isalnum()]
            if len(letters) == 1 and w[0].isalnum():
                run += letters
            else:
                if len(run) >= 3:
                    out.append("".join(run))
                run = []
    return out


def table_of(codes: list[bytes]) -> np.ndarray:
    width = max(3, max(map(len, codes)))
    table = np.frombuffer(b"".join(c.ljust(width, b"`") for c in codes), np.uint8).reshape(len(codes), width)
    return table.astype(np.int32) - 96


def grams(table: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """The three-letter subsequences of each pattern of gaps, 0 where there is none, and their weight."""
    width = table.shape[1]
    for a, b in PATTERNS:
        if b < width:
            x, y, z = table[:, : width - b], table[:, a : a + width - b], table[:, b:]
            yield np.where(z > 0, (x * BASE + y) * BASE + z, 0), DECAY ** (b + 1)


def subsequences(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, subsequence and weight of all words; equal ones of a word are summed, and a word's weights have length 1."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    if not codes:
        return none
    found = list(grams(table_of(codes)))
    ids = np.concatenate([i for i, _ in found], axis=1)
    weights = np.concatenate([np.full(i.shape[1], w, np.float32) for i, w in found])
    word, col = np.nonzero(ids)
    if not len(word):
        return none
    key = word * BASE**3 + ids[word, col]
    order = np.argsort(key, kind="stable")
    key, w = key[order], weights[col[order]]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, w = key[first], np.add.reduceat(w, first)
    word, sub = key // BASE**3, key % BASE**3
    norm = np.sqrt(np.bincount(word, w * w, minlength=len(codes)))
    return word, sub, (w / norm[word]).astype(np.float32)


class Kernel:
    """Kernel values of words against fixed landmarks, by the landmarks' own subsequences."""

    def __init__(self, landmarks: list[bytes]):
        word, sub, w = subsequences(landmarks)
        used, at = np.unique(sub, return_inverse=True)
        self.column = np.full(BASE**3, -1, np.int32)
        self.column[used] = np.arange(len(used))
        self.table = np.zeros((len(used), len(landmarks)), np.float32)
        self.table[at, word] = w
        #: Landmarks that are alike form a group; the greatest weight of each subsequence in a group bounds all its values.
        seeds = list(range(min(GROUPS, len(landmarks))))
        pairs = np.zeros((len(landmarks), len(landmarks)), np.float32)
        for k in range(len(landmarks)):
            own = word == k
            pairs[k] = (self.table[at[own]] * w[own, None]).sum(axis=0)
        group = pairs[:, seeds].argmax(axis=1) if seeds else np.zeros(0, np.int64)
        self.most = np.zeros((BASE**3, max(1, len(seeds))), np.float32)
        for g in seeds:
            self.most[used, g] = self.table[:, group == g].max(axis=1, initial=0)

    def bound(self, codes: list[bytes]) -> np.ndarray:
        """No kernel value of a word is above this: in a group each subsequence counts as that landmark's that has most of it, and equal ones do not lengthen the word."""
        table = table_of(codes)
        total, length = np.zeros((len(codes), self.most.shape[1]), np.float32), np.zeros(len(codes), np.float32)
        for ids, w in grams(table):
            for column in ids.T:
                total += self.most[column] * np.float32(w)
            length += w * w * (ids > 0).sum(axis=1)
        return total.max(axis=1) / np.sqrt(np.maximum(length, 1e-9))

    def values(self, codes: list[bytes], cells: int = 6_000_000) -> np.ndarray:
        """Kernel values, less CUT and stretched to 1 again."""
        out = np.zeros((len(codes), self.table.shape[1]), np.float32)
        step = max(50, cells // (40 * self.table.shape[1]))
        for i in range(0, len(codes), step):
            some = codes[i : i + step]
            close = np.flatnonzero(self.bound(some) > CUT)
            word, sub, w = subsequences([some[k] for k in close])
            col = self.column[sub]
            word, col, w = word[col >= 0], col[col >= 0], w[col >= 0]
            if len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[i + close[word[first]]] = np.add.reduceat(self.table[col] * w[:, None], first)
        out -= CUT
        np.maximum(out, 0, out=out)
        out /= 1 - CUT
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Values of whole words; a long word has the best of its pieces."""
        codes = spelled(words)
        if not codes or max(map(len, codes)) <= PIECE:
            return self.values(codes)
        pieces, owner = [], []
        for k, c in enumerate(codes):
            for i in range(0, max(1, len(c) - PIECE // 2), PIECE // 2):
                pieces.append(c[i : i + PIECE])
                owner.append(k)
        first = np.flatnonzero(np.diff(np.array(owner), prepend=-1))
        return np.maximum.reduceat(self.values(pieces), first)


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss by Newton steps on its active rows."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w = np.zeros(x1.shape[1])
    reg = np.eye(len(w)) * ridge
    reg[-1, -1] = 1e-8
    weight = weight / weight.sum()
    for k in range(rounds):
        on = y * (x1 @ w) < 1
        a = x1[on] * weight[on, None]
        new = np.linalg.solve(reg + a.T @ x1[on], a.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = w + (new - w) * (1.0 if k < 20 else 0.5)
    return w[:-1], float(w[-1])


class Sentences:
    """Sentences of texts as numbers of distinct words."""

    def __init__(self, texts: list[str]):
        self.words: dict[str, int] = {}
        ids, ends, self.per_text = [], [], []
        for t in texts:
            found = [w for s in BOUND.split(t.lower()) if (w := s.split())]
            found = [w + single_letters(w) for w in found]
            self.per_text.append(len(found))
            for s in found:
                ids.extend([self.words.setdefault(w, len(self.words)) for w in s])
                ends.append(len(ids))
        self.ids = np.array(ids, np.int64)
        self.starts = np.array([0, *ends[:-1]], np.int64) if ends else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.ids))))
        self.doc = np.repeat(np.arange(len(texts)), self.per_text)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums of the values of each sentence's words."""
        some = np.flatnonzero(values.any(axis=1)[self.ids]) if len(self.ids) else np.zeros(0, np.int64)
        out = np.zeros((len(self.starts), values.shape[1]), np.float32)
        np.add.at(out, self.of[some], values[self.ids[some]])
        return out


def features(high: np.ndarray, words: int) -> np.ndarray:
    """The highest word values, none above 1, and the logarithm of the number of words."""
    out = np.zeros(TOP + 1)
    top = np.minimum(np.sort(np.asarray(high, np.float64))[::-1][:TOP], 1)
    out[: len(top)] = top
    out[-1] = np.log1p(words) / 8
    return out


class Model:
    """kernel, weights per landmark, and the weights, slope and shift of the document machine."""

    def __init__(self, texts: list[str], labels: list[int], plain_weight: float = 1.0):
        y = np.array(labels)
        t = Sentences(texts)
        landmarks = self.chosen(t, y)
        self.kernel = Kernel(landmarks)
        same = self.kernel.values(landmarks).astype(np.float64)
        vals, vecs = np.linalg.eigh((same + same.T) / 2)
        root = vecs @ np.diag(np.maximum(vals, 1e-2) ** -0.5) @ vecs.T
        of_words = self.kernel.of_words(list(t.words))
        psi = t.summed(of_words) @ root.astype(np.float32)
        balance = np.where(y == 1, 1.0 / max(1, y.sum()), 1.0 / max(1, (1 - y).sum()))
        bag = np.zeros((len(texts), psi.shape[1]), np.float32)
        np.add.at(bag, t.doc, psi)
        w, b = train_svm(bag, 2.0 * y - 1, balance) if len(y) else (np.zeros(len(root)), 0.0)
        for _ in range(3):
            f = psi @ w
            order = np.lexsort((-f, t.doc))
            rank = np.arange(len(order)) - np.searchsorted(t.doc[order], t.doc[order])
            pick = order[(y[t.doc[order]] == 1) & (rank < 2) | (y[t.doc[order]] == 0) & (rank < 6)] if len(order) else order
            if not len(pick):
                break
            w, b = train_svm(psi[pick], 2.0 * y[t.doc[pick]] - 1, balance[t.doc[pick]])
        self.weights = (root @ w).astype(np.float32)
        value = of_words @ self.weights
        doc = t.doc[t.of] if len(t.of) else np.zeros(0, np.int64)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        words = [value[t.ids[lo:hi]] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        best = None
        for full in (0.3, 0.45, 0.6, 0.9):  # from which value on a word counts fully
            x = np.stack([features(v[v > full * LEAST] / full, len(v)) for v in words]) if words else np.zeros((0, TOP + 1))
            w, b = train_svm(x, 2.0 * y - 1, balance, ridge=1e-3) if len(y) else (np.zeros(TOP + 1), 0.0)
            loss = float((balance * np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)) ** 2).sum())
            if best is None or loss < best[0]:
                best = loss, full, w, b, x
        _, self.full, self.top, self.offset, x = best
        self.slope, self.shift = self.fitted(x @ self.top + self.offset, y, plain_weight)

    @staticmethod
    def chosen(t: Sentences, y: np.ndarray) -> list[bytes]:
        """Landmarks: words around which gather those that stand out in toxic documents, each unlike those before; then the commonest plain words like them."""
        words = list(t.words)
        doc = t.doc[t.of] if len(t.of) else np.zeros(0, np.int64)
        seen = np.unique(doc * len(words) + t.ids) if len(t.ids) else np.zeros(0, np.int64)
        of, word = seen // max(1, len(words)), seen % max(1, len(words))
        toxic = np.bincount(word[y[of] == 1], minlength=len(words)) / max(1, y.sum())
        plain = np.bincount(word[y[of] == 0], minlength=len(words)) / max(1, (1 - y).sum())
        codes = [c[:PIECE] for c in spelled(words)]
        at: dict[bytes, list[float]] = {}
        for c, a, b in zip(codes, toxic.tolist(), plain.tolist(), strict=True):
            if len(c) >= 4:
                s = at.setdefault(c, [0.0, 0.0])
                s[0] += a
                s[1] += b
        gain = {c: a - 3 * b for c, (a, b) in at.items()}
        some = sorted((c for c in gain if gain[c] > 0), key=lambda c: (-gain[c], c))[:CANDIDATES]
        like = sorted((c for c in gain if gain[c] <= 0), key=lambda c: (-at[c][1], c))[:AGAINST]
        out: list[bytes] = []
        if some:
            kernel = Kernel(some)
            near, plainly = kernel.values(some), kernel.values(like)
            left = np.array([gain[c] for c in some])
            against = np.array([gain[c] for c in like]) @ plainly if like else np.zeros(len(some))
            open_ = np.ones(len(some), bool)
            for _ in range(TOXIC_LANDMARKS):
                worth = np.where(open_, near.T @ left + against, -1)
                k = int(np.argmax(worth))
                if worth[k] <= 1 / max(1, y.sum()):
                    break
                out.append(some[k])
                open_[k] = False
                left = left * (1 - near[:, k]) ** 2
                against = against * (1 - near[k]) ** 2
            if out and like:
                close = Kernel(out).values(like).max(axis=1) * np.array([at[c][1] for c in like])
                out += [like[k] for k in np.argsort(-close, kind="stable")[:PLAIN_LANDMARKS] if close[k] > 0]
        return out or [BEGIN + b"abc"]

    @staticmethod
    def fitted(f: np.ndarray, y: np.ndarray, plain_weight: float) -> tuple[float, float]:
        """Slope and shift of the logistic curve, with smoothed targets; clean rows weigh as many as they stand for among the labels."""
        n1, n0 = y.sum(), (1 - y).sum()
        target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, c = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * f + c, -30, 30)))
            share = np.where(y == 1, 1.0, plain_weight)
            g = np.array([(share * (p - target) * f).sum(), (share * (p - target)).sum()])
            v = share * p * (1 - p) + 1e-9
            h = np.array([[(v * f * f).sum(), (v * f).sum()], [(v * f).sum(), v.sum()]]) + np.eye(2) * 1e-6
            step = np.linalg.solve(h, g)
            a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
        return float(max(a, 1e-3)), float(c)

    def value(self, words: list[str]) -> np.ndarray:
        """Values of words as shares of a full one."""
        return self.kernel.of_words(words) @ self.weights / self.full

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("met", "high")}

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of texts. A worker remembers the words it has met, and the values of those that have one."""
        if not hasattr(self, "met") or len(self.met) > REMEMBERED:
            self.met, self.high = set(), {}
        docs = [w + single_letters(w) for w in (t.lower().split() for t in texts)]
        new = list(set().union(*docs) - self.met)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            v = self.value(some)
            for k in np.flatnonzero(v > LEAST).tolist():
                self.high[some[k]] = float(v[k])
        self.met.update(new)
        x = [features(list(filter(None, map(self.high.get, w))), len(w)) for w in docs]
        f = np.array(x).reshape(len(texts), TOP + 1) @ self.top + self.offset
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -30, 30)))


def in_chunks(model: Model, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Begin, end and scores of runs of texts of about CHUNK_CHARS characters."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK_CHARS):
            n += len(texts[j])
            j += 1
        yield i, j, model.scores(texts[i:j])
        i = j


def crc_mod(c, n: int):
    return F.crc32(c.cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a sample of the labelled rows, in the order of a seeded digest of their ids; SAMPLE_ROWS of each class at most.

    folds: rows whose crc32 of the id as text is divisible by it are held out. Rows of labels without an id or a label are
    left out; an id that repeats is one row, toxic if one of its labels is, with one of its texts. If no labelled text is
    found, or only one class, the model still scores all texts.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if folds:
        named = named.where(crc_mod(F.col(id_col), folds) != 0)
    named = named.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y")).withColumn("__key", F.md5(F.col("__id").cast("string")))
    toxic, all_ = named.agg(F.sum((F.col("__y") > 0).cast("int")), F.count(F.lit(1))).first()
    plain_weight = max(1.0, (all_ - (toxic or 0)) / SAMPLE_ROWS) / max(1.0, (toxic or 0) / SAMPLE_ROWS)
    parts = [named.where(F.col("__y") == y).orderBy("__key", "__id").limit(SAMPLE_ROWS) for y in (1, 0)]
    some = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.where(F.length(text_col) <= TEXT_CHARS).join(some, F.col(id_col) == F.col("__id")).select("__id", "__y", "__key", F.col(text_col).alias("__text"))
    found = stash(rows.groupBy("__id", "__y", "__key").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("x")).select("__id", "__y", "__key", "x.t"))
    upto = F.sum(F.length("t")).over(Window.orderBy("__key", "__id"))  # no more rows than the sample has
    within = found.select("__id", upto.alias("upto")).where(F.col("upto") <= SAMPLE_CHARS)
    got = found.join(F.broadcast(within), "__id").orderBy("__key", "__id").select("t", "__y").collect()
    return Model([r["t"] for r in got], [int(r["__y"] > 0) for r in got], plain_weight)


def score(docs: DataFrame, model: Model, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Null texts count as empty; their score is that of no words. Null ids are not held out."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the numbers of landmarks and subsequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            out = [x for _, _, x in in_chunks(model, texts)]
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_mod(F.col(id_col), folds) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels, folds=5))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, None, id_col, text_col))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for i, j, x in in_chunks(model, [t or "" for t in b.column(at).to_pylist()]):
                yield b.slice(i, j - i).filter(pa.array(x < 0.5))

    return docs.mapInArrow(keep, docs.schema)
