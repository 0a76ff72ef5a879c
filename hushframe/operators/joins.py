"""Equi-joins that stay even when one key owns a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rows import ROW
from ..workspace import small_side

# A key is hot when its rows exceed this and also one fair share of a quarter task.
HOT_ROWS = 1_000_000
# A dictionary is broadcast only when the bytes of its texts were counted and lie within this.
DICTIONARY_BYTES = 8 << 20


def hot_keys(counts: DataFrame, n: str, total: int, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int, int]:
    """(hot keys with their number of splits, how many, rows per split).

    There are at most ``total / rows per split`` hot keys, so the result is small by
    construction and is broadcast only after its count was read.
    """
    width = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(hot_rows, math.ceil(total / (4 * width)))
    hot = counts.filter(F.col(n) > share).withColumn(
        "_splits", F.ceil(F.col(n) / share).cast("int")
    ).drop(n)
    return hot, (hot.count() if total > share else 0), share


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: str,
    how: str = "left",
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` to ``right`` (unique by ``key``); rows of hot keys are spread over
    several tasks by a hash of ``spread`` and their single right row is repeated. Rows without a
    key find nothing: if they are many, they are spread as well.

    ``counts`` is ``(key, n)`` for the left side; pass it when an earlier step has it.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot, n_hot, share = hot_keys(counts.select(key, "n"), "n", total, hot_rows)
    if n_hot == 0:
        return left.join(right, key, how)
    hot = small_side(hot, n_hot)
    salted = left.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(1 + total // share)).cast("int")).otherwise(
            F.coalesce(F.pmod(F.xxhash64(spread), F.col("_splits")).cast("int"), F.lit(0))
        ),
    )
    copies = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1))
    )
    return (
        salted.drop("_splits").join(copies.drop("_splits"), [key, "_salt"], how).drop("_salt")
    )


def dictionary_bytes(book: DataFrame, by: str = "field", texts: tuple[str, ...] = ("label", "code")) -> dict[str, int]:
    """Bytes of the texts of each dictionary of ``book``: a row for each heading reaches the driver."""
    size = sum((F.octet_length(t) for t in texts), F.lit(16))
    return {r[0]: r[1] for r in book.groupBy(by).agg(F.sum(size)).collect()}


def looked_up(df: DataFrame, value: Column, side: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with the row of ``side`` (unique by its column ``key``) that has ``value``, if any, beside it. A side of ``size``
    bytes is sent around while it is small; a larger one meets the rows by a shuffle, hot values spread."""
    if size <= DICTIONARY_BYTES:
        return df.join(F.broadcast(side), value == F.col(key), "left")
    spread = ROW if ROW in df.columns else df.columns[0]
    return keyed_join(df.withColumn(f"{key}_of", value), side.withColumnRenamed(key, f"{key}_of"), f"{key}_of", spread).drop(f"{key}_of")
