"""Traces read in ranges of bytes against the plain reading of the whole file."""

import gzip
import json
import os
import random
import struct
import zlib

import pyarrow as pa
import pytest

from lanespan.sources import ranges as R
from lanespan.sources import trace


def blocked(data: bytes, n: int) -> bytes:
    """Gzip members of n bytes that name their sizes."""
    out = b""
    for lo in range(0, len(data), n):
        part, c = data[lo : lo + n], zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def read(path: str, split: int) -> tuple[list[tuple[int, str]], int]:
    cuts = [dict(zip(("path", "lo", "hi", "back"), (path, *x), strict=True)) for x in R.ranges_of(path, os.path.getsize(path), split)]
    begun = R.beginnings(pa.Table.from_batches(list(R.effects([pa.RecordBatch.from_pylist(cuts)]))))
    return sorted((r["idx"], r["value"]) for b in R.texts(begun.to_batches()) for r in b.to_pylist()), len(cuts)


@pytest.mark.parametrize("trial", range(24))
def test_any_cut_gives_the_same_events(tmp_path, monkeypatch, trial):
    r = random.Random(trial)
    text = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", "a", " ", '"traceEvents": [', "é", "\n", ","]) for _ in range(r.randrange(9)))
    events = [{"ph": "X", "name": text(), "ts": r.random(), "args": {text(): text(), "l": [1, {"x": text()}, [text()]]}} for _ in range(r.randrange(12))]
    whole = {"schema": 1, "devices": [{"id": 0, "x": text()}], 'q\\"': {"traceEvents": [{"not": "me"}]}, "traceEvents": events, "after": [{"z": text()}], "name": "x"}
    data = (" \n" * (trial % 2) + json.dumps(events if trial % 3 == 0 else whole, ensure_ascii=trial % 2 == 0, indent=None if trial % 4 else 1)).encode()
    files = {"plain": data, "gz": gzip.compress(data), "blocked": blocked(data, 37)}
    for kind, content in files.items():
        path = tmp_path / kind
        path.write_bytes(content)
        for split in (1, 7, 100_000) if kind == "plain" else (60, 300):
            for chunk in (5, 1 << 20):
                monkeypatch.setattr(R, "CHUNK", chunk)
                got, parts = read(str(path), split)
                assert [json.loads(v) for _, v in got] == events
                assert all(data[i : i + len(v.encode())] == v.encode() for i, v in got)
                assert kind == "gz" or len(content) < 2 * split or parts > 1


def test_long_runs_of_backslashes(tmp_path):
    for n in (2 * R.MATCH + 1, 2 * R.MATCH + 2):
        events = [{"name": "\\" * n, "x": '"'}, {"name": "b"}]
        (tmp_path / "t").write_text(json.dumps(events))
        for split in (1, 50, 333):
            assert [json.loads(v) for _, v in read(str(tmp_path / "t"), split)[0]] == events


def test_many_files_in_many_ranges(spark, tmp_path):
    r = random.Random(3)
    want = {}
    for k in range(4):
        events = [{"ph": "X", "cat": "kernel", "name": f"k{i} {{\"[", "ts": i, "dur": r.randrange(50), "args": {"correlation": i, "n": "x" * r.randrange(200)}} for i in range(300)]
        content = json.dumps(events if k % 2 else {"traceEvents": events}).encode()
        (tmp_path / f"t{k}.json").write_bytes(blocked(content, 4000) if k == 3 else content)
        want[k] = [(e["name"], float(e["dur"]), str(e["args"]["correlation"])) for e in events]
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"a": []}')
    for split in (1 << 10, 8 << 10, 1 << 30):
        got = {}
        for x in trace.events(spark, str(tmp_path), split).orderBy("file", "idx").collect():
            got.setdefault(int(x.file.rpartition("/t")[2][0]), []).append((x.name, x.dur, x.args["correlation"]))
        assert got == want
    ids = {x.file: x.n for x in trace.call_paths(trace.events(spark, str(tmp_path), 5000)).groupBy("file").count().withColumnRenamed("count", "n").collect()}
    assert sorted(ids.values()) == [300] * 4


def test_a_large_file_is_read_in_many_tasks(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"ph": "X", "name": f"n{i}"} for i in range(5000)]))
    texts = R.event_texts(spark, str(tmp_path), 10_000)
    assert texts.rdd.getNumPartitions() > 8 and texts.count() == 5000
