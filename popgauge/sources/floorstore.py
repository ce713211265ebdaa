"""Noise floors kept between runs.

A floor depends on its task's cells only, so it is filed under a fingerprint of them. Scoring asks the store first and
draws floors for the tasks that it lacks or whose cells have changed. Each addition is a folder of its own that counts
once Spark has committed it (its ``_SUCCESS`` file stands): a run that breaks off leaves nothing that is read, and runs
side by side add equal rows at worst. Nothing is ever overwritten; old fingerprints stay and are not asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "task_id int, fingerprint string, best_err double"


def fingerprints(cells: DataFrame, keys: Sequence[str], numbers: Sequence[str], settings: str = "") -> DataFrame:
    """(task_id, fingerprint) from cells with ``task_id``, the cell's ``keys`` and its ``numbers``.

    Numbers count to ten digits, as sums come out a little different when rows are added in another order; two hashes of
    every cell are summed up, so the order of cells does not matter."""
    said = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys],
                       *[F.coalesce(F.format_string("%.9e", F.col(n).cast("double")), F.lit("\x00")) for n in numbers])
    sums = [F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64(said), F.xxhash64(F.reverse(said), said))]
    told = F.concat_ws(":", F.lit(settings), F.count(F.lit(1)).cast("string"), *[s.cast("string") for s in sums])
    return cells.groupBy("task_id").agg(told.alias("fingerprint"))


class FloorStore:
    """Floors under ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list[str]:
        """Folders of finished additions."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        done = hadoop.Path(f"{self.path}/*/_SUCCESS")
        found = done.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(done)
        return sorted(f.getPath().getParent().toString() for f in found or [])

    def read(self) -> DataFrame:
        """(task_id, fingerprint, best_err), each fingerprint once."""
        paths = self.commits()
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("task_id", "fingerprint").agg(F.max("best_err").alias("best_err"))

    def add(self, floors: DataFrame) -> None:
        """Commit (task_id, fingerprint, best_err)."""
        floors.select("task_id", "fingerprint", "best_err").coalesce(1).write.parquet(f"{self.path}/floors-{uuid.uuid4().hex}")

    def floors(self, prints: DataFrame, draw: Callable[[list[int]], DataFrame]) -> DataFrame:
        """(task_id, best_err) of the tasks in ``prints`` (task_id, fingerprint). ``draw`` makes (task_id, best_err) of the
        task ids that the store lacks under their fingerprint; it is not called if there are none."""
        asked = self.spark.createDataFrame(prints.select("task_id", "fingerprint").collect(), "task_id int, fingerprint string")  # a row for each task
        todo = [r["task_id"] for r in asked.join(self.read(), ["task_id", "fingerprint"], "left_anti").collect()]
        if todo:
            self.add(F.broadcast(asked).join(draw(sorted(todo)), "task_id"))
        return asked.join(self.read(), ["task_id", "fingerprint"]).select("task_id", "best_err")
