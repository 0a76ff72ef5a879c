"""Named queries over the given tables, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load_table
from ..workspace import Workspace


#: Rows of a dealt-out table that one task takes, at most about.
DEALT = 250_000


@dataclass
class Context:
    """One run of a query: session, folder of the tables, and a workspace."""

    spark: SparkSession
    folder: str
    ws: Workspace

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def text(self, name: str, columns: list[str] | None = None, **options) -> DataFrame:
        return load_table(self.spark, f"{self.folder}/{name}.parquet", self.ws, columns=columns, **options)

    def tasks(self, name: str) -> int:
        """For ``partitions=``: the given tables are files of one row group each. A task for each core, and more for a table
        of more rows, so that a task's work and memory don't grow with the table."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.raw(name).count() // DEALT))

    def dealt(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """The text table dealt out to ``tasks``, unless it has as many files."""
        tasks = self.tasks(name)
        return self.text(name, columns, partitions=None if len(self.raw(name).inputFiles()) >= tasks else tasks)

    def kept(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """The numbered text table written once, for queries that read it many times: dealt out, for what is written by one
        task is read by one."""
        return self.ws.keep(self.dealt(name, columns), name)


Query = Callable[[Context], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Context(spark, sf_dir.rstrip("/"), Workspace(spark)))

    run.__name__ = name
    return run
