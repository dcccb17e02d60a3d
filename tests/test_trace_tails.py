"""What is read behind a range to end its last event."""

import json
import os

import pyarrow as pa

from lanespan.sources import ranges as R


def read(path: str, split: int) -> tuple[list, int]:
    """The events of the file, and how many bytes the second pass reads."""
    cuts = [dict(zip(("path", "lo", "hi", "back"), (path, *x), strict=True)) for x in R.ranges_of(path, os.path.getsize(path), split)]
    begun = R.beginnings(pa.Table.from_batches(list(R.effects([pa.RecordBatch.from_pylist(cuts)]))))
    n, opened = [0], R.opened

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            return self.f.seek(at)

        def read(self, size):
            data = self.f.read(size)
            n[0] += len(data)
            return data

    R.opened = lambda p: Counted(opened(p))
    try:
        got = sorted((r["idx"], r["value"]) for b in R.texts(begun.to_batches()) for r in b.to_pylist())
    finally:
        R.opened = opened
    return [json.loads(v) for _, v in got], n[0]


def test_a_range_does_not_read_far_behind_its_end(tmp_path):
    events = [{"name": f"n{i} {{\"[", "args": {"x": "y" * (i % 50)}} for i in range(40_000)]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(events))
    got, n = read(str(path), 64 << 10)
    assert got == events
    assert n < 2 * path.stat().st_size


def test_an_event_longer_than_what_is_read_first(tmp_path):
    events = [{"name": "a"}, {"name": "b" * (5 * R.TAIL) + "\"}"}, {"name": "c"}]
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"traceEvents": events}))
    for split in (20, 1000, R.TAIL):
        assert read(str(path), split)[0] == events
