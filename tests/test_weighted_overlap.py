"""The weighted overlap of names against its SQL, where intervals are empty or have no stream."""

import datetime

import oracle
import pytest

from lanespan.plans.catalogue import ORACLE_SQL, QUERIES

T = datetime.datetime(2024, 1, 1)
#: minute of begin, user, stream, minutes.
ROWS = {
    "an empty interval within another stream's": [(0, 1, "view", 90.0), (10, 1, "click", 0.0), (30, 1, "click", 20.0), (40, 1, "view", 5.0)],
    "a name of empty intervals only": [(0, 1, "view", 90.0), (10, 1, "click", 0.0), (20, 1, "click", 0.0), (0, 2, "click", 1.0)],
    "nothing but empty intervals": [(0, 1, "view", 0.0), (0, 1, "click", 0.0)],
    "no stream, no user": [(0, 1, None, 90.0), (0, 1, "view", 30.0), (10, 1, "click", 10.0), (0, None, "view", 10.0), (0, None, "click", 10.0)],
    "more than 15 names of equal length": [(0, k % 10, "view" if k < 10 else "click", 7.0) for k in range(20)],
}


@pytest.mark.parametrize("name", ROWS)
def test_weighted_overlap_matches_sql(spark, tmp_path, name):
    rows = [(i, T + datetime.timedelta(minutes=at), user, stream, minutes, "{}") for i, (at, user, stream, minutes) in enumerate(ROWS[name])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert oracle.differences(spark, QUERIES["weighted_overlap_topk"], ORACLE_SQL["weighted_overlap_topk"], str(tmp_path)) == ""
