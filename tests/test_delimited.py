import json

import pytest

from lanespan.sources import delimited as D


def test_csv_with_marks_blanks_and_more_cells_than_names(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('﻿ a , b,c \n1, x ,one, two,three\n2,"q ""r"", s",\n3\n', encoding="utf-8")
    assert D.fields(spark, str(p)) == ["a", "b", "c"]
    got = [tuple(r) for r in D.read_csv(spark, str(p)).orderBy("a").collect()]
    assert got == [("1", "x", "one, two,three"), ("2", 'q "r", s', None), ("3", None, None)]
    (tmp_path / "wide.csv").write_text("a,b\n" + ",".join("1" * 80) + "\n")
    with pytest.raises(Exception, match="beyond the header"):
        D.read_csv(spark, str(tmp_path / "wide.csv")).collect()


def test_sidecars_and_where_they_are(spark, tmp_path):
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "m.json").write_text(json.dumps({"a": {"b": 1}}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "own.json").write_text("{}")
    assert D.artifact(spark, str(tmp_path), None, "m.json") == f"{tmp_path}/metadata/m.json"
    assert D.artifact(spark, str(tmp_path), "own.json", "x.json") == f"{tmp_path}/own.json"
    assert D.artifact(spark, str(tmp_path), "/nowhere/own.json", "x.json") == f"{tmp_path}/own.json" and D.artifact(spark, str(tmp_path), "gone.json", "x.json") is None
    assert D.sidecar(spark, f"{tmp_path}/metadata/m.json") == {"a": {"b": 1}} and D.sidecar(spark, f"{tmp_path}/bad.json") == {} and D.sidecar(spark, None) == {}
    with pytest.raises(ValueError):
        D.sidecar(spark, f"{tmp_path}/bad.json", strict=True)


def test_environment_reads_two_names_only(spark):
    rows = spark.createDataFrame([("Environment", "A=1;B=x=y;=no;C"), ("DeviceEnvironment", "A=0;D=4"), ("Other", "E=5")], "name string, value string")
    assert {r.key: r.value for r in D.environment(rows).collect()} == {"A": "1", "B": "x=y", "D": "4"}
