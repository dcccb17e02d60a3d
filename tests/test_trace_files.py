"""Traces written from rows of many tasks, where joins become broadcasts only while the query runs."""

import pytest
from pyspark.sql import functions as F

from lanespan.operators import joins
from lanespan.plans import q_sources


@pytest.mark.parametrize("most", [joins.SENT_ROWS, 0])
def test_a_trace_is_one_file_where_the_join_of_its_ends_becomes_a_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(q_sources, "sent", lambda df: joins.sent(df, most), raising=False)
    rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 3).alias("file"), F.col("id").alias("ord"), F.struct(F.lit("X").alias("ph"), F.col("id").cast("string").alias("name")).alias("event"))
    # As tables are loaded, but that 4,000 events are too large to be broadcast.
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        path = q_sources.trace_files(rows, "file", "ord")
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).count() == 3
    got = {int(f.rpartition("file=")[2][0]): [int(x) for x in names] for f, names in q_sources.J.events(spark, path, split=4096).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("names")).collect()}
    assert got == {k: list(range(k, 4000, 3)) for k in range(3)}
