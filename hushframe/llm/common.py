"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words are the runs between these ASCII spaces (\x20 and \x09-\x0D).
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_ACTIVE: ContextVar[Workspace | None] = ContextVar("workspace", default=None)
#: While a table is written, a batch of rows on its way to Python ends after so many bytes, not only after its number of rows:
#: texts and sets of shingles are wide, and a batch is held by the JVM, by its Python worker and once more as its results.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Workspace]:
    """A workspace that takes all tables ``written`` meanwhile, and deletes them at the end. What outlives it is written to
    another workspace before."""
    ws = Workspace(spark)
    token = _ACTIVE.set(ws)
    try:
        yield ws
    finally:
        _ACTIVE.reset(token)
        ws.release()


def current() -> Workspace | None:
    return _ACTIVE.get()


def written(df: DataFrame, label: str, ws: Workspace | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and a lost executor costs a reread."""
    spark = df.sparkSession
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return (ws or current() or Workspace(spark)).keep(df, label)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def width(spark: SparkSession) -> int:
    """Tasks of a shuffle, from the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def count_words(text: Column) -> Column:
    """Number of words in ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
