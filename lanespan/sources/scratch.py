"""Cutting lineage: a frame is written to the shared checkpoint folder and goes on from there, so a lost executor costs its tasks only."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master without one, a folder of its own. A cluster has to name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="lanespan-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in that folder."""
    folder(df.sparkSession)
    return df.checkpoint()
