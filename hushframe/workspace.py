"""Where intermediate tables live, and how big a side may be before it is broadcast."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Refused

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# A side is broadcast only when its row count was checked against this bound.
BROADCAST_ROWS = 200_000
# While a table is written, Spark deletes a job's shuffle files as soon as it ends: nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Cuts lineage by writing a table to the shared folder and reading it back.

    Random ids must exist exactly once: a lost executor would otherwise draw new ones
    when Spark recomputes a stage. A written table survives executor loss, keeps
    parquet column pruning, and is read as often as needed.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        base = root or shared_folder(spark)
        self.root = f"{base.rstrip('/')}/hush-{uuid4().hex}"
        self._written: list[str] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}-{uuid4().hex[:12]}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("errorifexists").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        self._written.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete the tables this workspace wrote (they may hold source keys)."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self._written:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        self._written.clear()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only for a local-mode session."""
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_SETTING
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise Refused("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="hush-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when its known row count is within the bound, else leave the
    choice (shuffled join, AQE) to Spark."""
    return F.broadcast(df) if rows <= limit else df
