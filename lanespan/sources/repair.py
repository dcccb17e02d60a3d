"""Derived tables that are published only if they pass their contract, and are derived again once if they do not.

A published table lies in `current`. One that breaks its contract is moved to `rejected`, where it stays as evidence, and a new one
is written beside it as `candidate`. Only what passes, as it is read back, becomes `current`, by a move, so a reader never finds
half a table; a candidate that fails stays apart and the call raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SHOWN = 10


class Folder:
    """Versions of a table under a root, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def there(self, name: str) -> bool:
        """Whether a table was written to its end."""
        return self.fs.exists(self.path(f"{name}/_SUCCESS"))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self.path(name), self.path(to)):
            raise OSError(f"{self.root}/{name} could not be moved to {to}")

    def next(self, name: str) -> str:
        """rejected/0, rejected/1, ...: the first that is free."""
        self.fs.mkdirs(self.path(name))
        return f"{name}/{len(self.fs.listStatus(self.path(name)))}"


def published(spark: SparkSession, root: str, build: Callable[[], DataFrame], violations: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table at root/current, if it is whole and `violations` (check_id, key, detail) finds nothing in it; else the one that build() derives, if that passes.

    What was rejected stays in root/rejected, by number. If the rebuilt table fails too, it is kept there as well, nothing is
    published, and ValueError names the first violations.
    """
    at = Folder(spark, root)
    if at.there("current") and violations(at.read("current")).limit(1).count() == 0:
        return at.read("current")
    if at.fs.exists(at.path("current")):
        at.move("current", at.next("rejected"))
    at.fs.delete(at.path("candidate"), True)  # of a call that was cut short
    build().write.parquet(f"{at.root}/candidate")
    left = [f"{r.check_id} {r.key}: {r.detail}" for r in violations(at.read("candidate")).limit(SHOWN).collect()]
    if left:
        kept = at.next("rejected")
        at.move("candidate", kept)
        raise ValueError(f"the table still breaks its contract after it was derived again ({at.root}/{kept}): " + "; ".join(left))
    at.move("candidate", "current")
    return at.read("current")
