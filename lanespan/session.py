"""Session settings for local work; a cluster's own settings take precedence there."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lanespan", cores: int | None = None, memory: str = "6g") -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
