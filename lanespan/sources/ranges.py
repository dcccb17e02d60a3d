"""Large trace-event files, read in ranges of bytes.

Where a range begins, nothing tells whether its first byte lies in a string, or how many brackets are open. So every
range is read twice. The first time it is followed for both beginnings, outside and inside a string, which gives what it
does to any state: in which of the two it ends, how many brackets it opens or closes, how low it gets, and where a list of
events may begin. These few numbers of a file's ranges are put together in order, which gives each range its true beginning, and the
second time each gives the events that begin in it, the last of them with what reaches into the ranges behind.

Plain files are cut anywhere. Gzip files whose members name their sizes (blocked gzip) are cut between members, and
any other gzip file is one range, as it can be read from its beginning only. Files are listed by Spark, and opened by the
workers with pyarrow's file systems.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, before inflating.
SPLIT = 64 << 20
CHUNK = 8 << 20
#: Bytes read first of what lies behind a range, where its last event ends.
TAIL = 16 << 10
#: A list of events: the key, and what may stand before its bracket. A match is no longer than MATCH bytes.
LIST, MATCH = re.compile(rb'(?<!\\)"traceEvents"\s{0,64}:\s{0,64}\['), 160
QUOTE, BACK, OPEN, CLOSE = 34, 92, (91, 123), (93, 125)
KIND = np.zeros(256, np.int8)
KIND[list(OPEN)], KIND[list(CLOSE)] = 1, -1


def opened(path: str):
    """The file of a URI, or of a plain path."""
    path = re.sub(r"^file:/+", "/", path)
    fs, name = (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def member_size(head: bytes) -> int | None:
    """Bytes of a gzip member that names them (two bytes in the extra field BC), else nothing."""
    if head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        size = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def ranges_of(path: str, size: int, split: int) -> list[tuple[int, int, int]]:
    """First byte and end of each range of the file, and where to read on from to see the MATCH bytes before it."""
    with opened(path) as f:
        if f.read(2) != b"\x1f\x8b":
            return [(lo, min(lo + split, size), max(0, lo - MATCH)) for lo in range(0, size, split)]
        out, lo, at, back, members = [], 0, 0, 0, []
        while at < size:
            f.seek(at)
            n = member_size(f.read(64))
            if n is None:
                return [(0, size, 0)]
            f.seek(at + n - 4)
            members.append((at, int.from_bytes(f.read(4), "little")))
            while sum(x for _, x in members[1:]) >= MATCH:
                members.pop(0)
            at += n
            if at - lo >= split or at >= size:
                out.append((lo, at, back))
                lo, back = at, members[0][0]
        return out


def gzipped(f) -> bool:
    f.seek(0)
    return f.read(2) == b"\x1f\x8b"


def stream(f, lo: int, hi: int | None = None, first: int | None = None) -> Iterator[bytes]:
    """The bytes from lo to hi (to the end), inflated if they are gzip members. Pieces have CHUNK bytes; if `first` is given, they begin with so many and double up to CHUNK."""
    left, inflate = None if hi is None else hi - lo, zlib.decompressobj(31) if gzipped(f) else None
    at, piece = lo, min(CHUNK, first or CHUNK)
    while left is None or left > 0:
        f.seek(at)
        data = f.read(piece if left is None else min(piece, left))
        piece = min(CHUNK, 2 * piece)
        if not data:
            return
        at, left = at + len(data), None if left is None else left - len(data)
        if inflate is None:
            yield data
            continue
        while data:
            out = inflate.decompress(data, CHUNK)
            if out:
                yield out
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if inflate.eof:
                inflate = zlib.decompressobj(31)


def before(f, lo: int, back: int) -> tuple[bytes, bool]:
    """The MATCH bytes before lo, and whether an odd number of backslashes stands right before it, so that its first byte is escaped."""
    tail = b"".join(stream(f, back, lo))[-MATCH:]
    n = len(tail) - len(tail.rstrip(b"\\"))
    while n and n == len(tail) and back > 0 and not gzipped(f):  # nothing but backslashes
        back = max(0, back - 2 * len(tail))
        tail = b"".join(stream(f, back, lo))
        n = len(tail) - len(tail.rstrip(b"\\"))
    return tail[-MATCH:], n % 2 == 1


class Text:
    """Quotes that open or close strings, and brackets, of a piece of text."""

    def __init__(self, data: bytes, escaped: bool = False):
        a = np.frombuffer(data, np.uint8)
        self.data, self.n = data, len(a)
        quotes = np.flatnonzero(a == QUOTE)
        backs = np.flatnonzero(a == BACK)
        self.escaped_after = False
        if len(backs) or escaped:
            new = np.concatenate([[True], np.diff(backs) > 1]) if len(backs) else np.zeros(0, bool)
            first = backs[new] if len(backs) else backs
            length = np.diff(np.append(np.flatnonzero(new), len(backs)))
            behind = first + length  # what follows a run is escaped by it if the run is odd
            odd = length % 2 == 1
            if escaped and len(first) and first[0] == 0:
                odd[0] = ~odd[0]
            hit = behind[odd]
            if escaped and not (len(first) and first[0] == 0):
                hit = np.append(hit, 0)
            self.escaped_after = bool((hit == self.n).any())
            quotes = np.setdiff1d(quotes, hit, assume_unique=True)
        self.quotes = quotes
        self.brackets = np.flatnonzero(KIND[a])
        self.kinds = KIND[a[self.brackets]].astype(np.int64)
        self.within = np.searchsorted(self.quotes, self.brackets) % 2  # in a string, if the text begins outside


def effect(pieces: Iterator[bytes], tail: bytes, escaped: bool) -> dict:
    """What a range's text does to either beginning: per beginning its end (in a string or not), the change of depth, the lowest
    depth, and by relative depth the first list of events (where its bracket is, and how low it gets behind it). tail: what stands before the range."""
    out = {s: {"inside": s, "depth": 0, "low": 0, "lists": {}} for s in (0, 1)}
    at, first, root = 0, None, None
    for data in pieces:
        t = Text(data, escaped)
        text = tail + data
        lists = [m.end() - 1 - len(tail) for m in LIST.finditer(text) if m.end() > len(tail)]
        for x in out.values():
            own = t.within == x["inside"]
            place, change = t.brackets[own], np.cumsum(t.kinds[own])
            low = int(change.min(initial=0))
            for known in x["lists"].values():
                known[1] = min(known[1], x["depth"] + low)
            for p in lists:
                k = int(np.searchsorted(place, p))
                if k < len(place) and place[k] == p:  # outside of strings
                    depth = x["depth"] + int(change[k]) - 1
                    x["lists"].setdefault(depth, [at + p, x["depth"] + int(change[k:].min())])
            x["low"] = min(x["low"], x["depth"] + low)
            x["depth"] += int(change[-1]) if len(change) else 0
            x["inside"] = (x["inside"] + len(t.quotes)) % 2
        if first is None and (rest := data.lstrip()):
            first, root = at + len(data) - len(rest), rest[:1] == b"["
        at, escaped, tail = at + len(data), t.escaped_after, text[-MATCH:]
    return {"size": at, "first": first, "root": root} | {f"{k}{s}": (v if k != "lists" else [[d, *y] for d, y in v.items()]) for s, x in out.items() for k, v in x.items()}


EFFECT = "path string, lo long, hi long, back long, size long, first long, root boolean, inside0 int, depth0 long, low0 long, lists0 array<array<bigint>>, inside1 int, depth1 long, low1 long, lists1 array<array<bigint>>"
LONGS = [(c, pa.int64()) for c in ("lo", "hi", "back")]


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range (path, lo, hi, back)."""
    kinds = [("path", pa.string()), *LONGS, ("size", pa.int64()), ("first", pa.int64()), ("root", pa.bool_())]
    for s in "01":
        kinds += [(f"inside{s}", pa.int32()), (f"depth{s}", pa.int64()), (f"low{s}", pa.int64()), (f"lists{s}", pa.list_(pa.list_(pa.int64())))]
    for b in batches:
        rows = []
        for r in b.to_pylist():
            with opened(r["path"]) as f:
                rows.append(r | effect(stream(f, r["lo"], r["hi"]), *before(f, r["lo"], r["back"])))
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


BEGIN = "path string, lo long, hi long, back long, offset long, inside int, depth long, level long, begin long, open boolean"


def beginnings(table: pa.Table) -> pa.Table:
    """Each range of a file with its true beginning: offset of its first byte, in a string or not, depth; level: the depth of events, begin: the offset of their list's bracket, open: whether events may begin in it."""
    out = []
    offset = depth = inside = 0
    level = begin = None
    blank, closed = True, False
    for r in table.sort_by("lo").to_pylist():
        s, low = str(inside), None
        if blank and r["first"] is not None:
            blank = False
            if r["root"]:  # a list is the whole file, and nothing comes after it
                level, begin = 1, offset + r["first"]
        if level is None:
            at, low = next((x[1:] for x in r[f"lists{s}"] if x[0] + depth == 1), (None, None))
            if at is not None:
                level, begin = 2, offset + at
        elif level == 2:
            low = r[f"low{s}"]
        out.append({**{c: r[c] for c in ("path", "lo", "hi", "back")}, "offset": offset, "inside": inside, "depth": depth, "level": level, "begin": begin, "open": level is not None and not closed})
        closed |= low is not None and low + depth < 2
        offset, depth, inside = offset + r["size"], depth + r[f"depth{s}"], r[f"inside{s}"]
    kinds = [("path", pa.string()), *LONGS, ("offset", pa.int64()), ("inside", pa.int32()), *((c, pa.int64()) for c in ("depth", "level", "begin")), ("open", pa.bool_())]
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


def objects(f, r: dict) -> Iterator[tuple[int, bytes]]:
    """Offset and text of the events that begin in the range."""
    escaped, inside, depth, at = before(f, r["lo"], r["back"])[1], r["inside"], r["depth"], r["offset"]
    level, begin = r["level"], r["begin"]
    held, start, done = [], None, False

    def walk(pieces: Iterator[bytes], own: bool) -> Iterator[tuple[int, bytes]]:
        nonlocal escaped, inside, depth, at, held, start, done
        for data in pieces:
            t = Text(data, escaped)
            here = t.within == inside
            place, kinds = t.brackets[here], t.kinds[here]
            after = depth + np.cumsum(kinds)
            behind = place + at > begin
            ends = np.flatnonzero(behind & (kinds < 0) & (after == level))
            firsts = np.flatnonzero(behind & (kinds > 0) & (after == level + 1))
            stop = np.flatnonzero(behind & (after < level))
            if len(stop):
                done = True
                ends, firsts = ends[ends < stop[0]], firsts[firsts < stop[0]]
            marks = sorted([(int(place[k]), 0) for k in firsts] + [(int(place[k]), 1) for k in ends])
            for p, closing in marks:
                if closing:
                    if start is not None:
                        body = b"".join([*held, data[: p + 1]]) if held else data[start - at : p + 1]
                        if body[:1] == b"{":
                            yield start, body
                        held, start = [], None
                        if not own:
                            done = True
                            return
                elif own:
                    start = at + p
            if start is not None:
                held.append(data[max(0, start - at) :])
            depth = int(after[-1]) if len(after) else depth
            inside = (inside + len(t.quotes)) % 2
            escaped, at = t.escaped_after, at + len(data)
            if done or (not own and start is None):
                return

    yield from walk(stream(f, r["lo"], r["hi"]), True)
    if start is not None and not done:
        yield from walk(stream(f, r["hi"], first=TAIL), False)


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, offset, value of the events of each range."""
    for b in batches:
        for r in b.to_pylist():
            if not r["open"]:
                continue
            rows, size = [], 0
            with opened(r["path"]) as f:
                for offset, body in objects(f, r):
                    rows.append((r["path"], offset, body.decode("utf-8", "replace")))
                    size += len(body)
                    if size > CHUNK:
                        yield made(rows)
                        rows, size = [], 0
            yield made(rows)


def made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "idx", "value"])


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Each of n rows in a task of its own, as far as there are that many slots."""
    return df.repartition(max(1, n), "path", "lo")


def event_texts(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, idx (offset of the first byte, in the file as it reads when inflated), value: the text of each event of all files of the path.

    A file holds a list of events, or an object with the list `traceEvents`, of which the first counts; elements that are no objects are
    left out. Files without such a list, and empty files, have no events. However ranges are cut, the result is the same.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["path"], *x) for r in b.to_pylist() for x in ranges_of(r["path"], r["length"], split)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), *[pa.int64()] * 3))], names=["path", "lo", "hi", "back"])

    from lanespan.sources.scratch import cut as written

    ranges = written(files.mapInArrow(cut, "path string, lo long, hi long, back long"))
    n = ranges.count()
    found = dealt(ranges, n).mapInArrow(effects, EFFECT)
    begun = written(found.groupBy("path").applyInArrow(lambda table: beginnings(table), BEGIN))
    return dealt(begun.where("open"), n).mapInArrow(texts, "file string, idx long, value string")
