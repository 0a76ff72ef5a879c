"""Dense source row numbers without sorting or moving the rows.

Tables here have an order ("source row 0 is the first row"), DataFrames do not. A
row's number is its place inside its chunk plus the number of rows in the chunks
before it. The chunks are the input files (parquet keeps the place itself) or the
blocks of a text file, so only one count per chunk is aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace, small_side

ROW = "_row"


def _numbered(df: DataFrame, chunk: list[str], first: int = 0) -> DataFrame:
    """``df`` has ``chunk`` columns (sortable) and ``_at``, the place within the chunk."""
    counts = df.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    # One row per file or block: a single ordered pass over metadata, not over data.
    before = Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_o{c}") for c in chunk],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low") + first).alias("_offset"),
    ).persist()
    keep = [c for c in df.columns if c not in (*chunk, "_at")]
    head = offsets.limit(2).collect()
    if len(head) == 1:  # a single chunk: no join, one constant
        return df.select(*keep, (F.col("_at") + F.lit(head[0]["_offset"])).cast("long").alias(ROW))
    on = [df[c].eqNullSafe(offsets[f"_o{c}"]) for c in chunk]
    joined = df.join(small_side(offsets, offsets.count()), on, "left")
    return joined.select(*keep, (F.col("_at") + F.col("_offset")).cast("long").alias(ROW))


def number_file_rows(raw: DataFrame) -> DataFrame:
    """Number the rows of a parquet scan by (file, place in the file)."""
    marked = raw.select(
        *raw.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_at"),
    )
    return _numbered(marked, ["_file"])


def number_block_rows(raw: DataFrame, ws: Workspace) -> DataFrame:
    """Number the rows of a text scan (csv, json) by (file, block, place in the block)."""
    marked = raw.select(
        *raw.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return _numbered(ws.keep(marked, "rows"), ["_file", "_block"])


def with_row_number(df: DataFrame, ws: Workspace, order_by: list[str] | None = None) -> DataFrame:
    """Number any DataFrame: in its present order, or by a sort key (ties by content)."""
    if order_by:
        rest = [c for c in df.columns if c not in order_by]
        df = df.orderBy(*order_by, *rest)
    mid = F.monotonically_increasing_id()
    marked = ws.keep(df.select("*", mid.alias("_at")), "rows")
    # The upper bits of the id are the partition, the lower 33 the place within it.
    return _numbered(marked.withColumn("_chunk", F.shiftright("_at", 33)), ["_chunk"])
