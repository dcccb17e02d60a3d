"""The reader of SQLite captures: ranges of rows, and options that the file answers."""

import sqlite3

import pytest
from lanespan.sources import sqlite as L


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("capture") / "c.sqlite"
    with sqlite3.connect(p) as con:
        con.execute("CREATE TABLE StringIds (id INTEGER PRIMARY KEY, value TEXT)")
        con.execute("CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL (start INTEGER, end INTEGER, deviceId INTEGER, shortName INTEGER)")
        con.executemany("INSERT INTO StringIds VALUES (?, ?)", [(i, f"k{i}") for i in range(5)])
        con.executemany("INSERT INTO CUPTI_ACTIVITY_KIND_KERNEL VALUES (?, ?, ?, ?)", [(i * 10, i * 10 + 5, i % 3, i % 6) for i in range(1000)])
    con.close()
    return str(p)


def test_a_device_is_read_in_several_tasks(spark, path):
    k = L.kernels(spark, path, device=1, window=(3000, 5000), rows=100)
    assert sorted(r.s for r in k.collect()) == [i * 10 for i in range(300, 500) if i % 3 == 1] == sorted(r.s for r in k.where("e > 3000").collect())
    whole = L.kernels(spark, path, rows=100)
    assert whole.where("device = 0").count() == 334 and whole.count() == 1000 and whole.where("name is null").count() == sum(i % 6 == 5 for i in range(1000))
    raw = spark.read.format("kernel_sqlite").option("path", path).option("rows", "100").option("device", "1").load()
    assert raw.rdd.getNumPartitions() == 10 and raw.count() == 333


def test_options_reach_the_file(path):
    source = L.KernelSource({"path": path, "device": "1", "since": "5", "rows": "400"})
    reader = source.reader(None)
    assert reader.where == [("deviceId = ?", 1), ("end > ?", 5)]
    parts = reader.partitions()
    assert [(p.lo, p.hi) for p in parts] == [(1, 400), (401, 800), (801, 1000)] and sum(1 for p in parts for _ in reader.read(p)) == 333


def test_views_have_no_row_ids(spark, path, tmp_path):
    p = tmp_path / "v.sqlite"
    with sqlite3.connect(p) as con:
        con.execute("CREATE TABLE StringIds (id INTEGER PRIMARY KEY, value TEXT)")
        con.execute("CREATE TABLE raw (start INTEGER PRIMARY KEY, end INTEGER, deviceId INTEGER, shortName INTEGER) WITHOUT ROWID")
        con.execute("INSERT INTO raw VALUES (1, 2, 0, 0)")
        con.execute("CREATE VIEW CUPTI_ACTIVITY_KIND_KERNEL AS SELECT * FROM raw")
    con.close()
    assert L.kernels(spark, str(p)).count() == 1
