"""Exact dedup by a content sort: equal texts become neighbours and are compared in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import width

#: Characters of a text that its splitter holds.
HEAD = 64


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    keep: str = "smallest",
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): one row for each row of ``docs``.

    Sampled splitters range-partition the normalised texts, by their first characters and then their hash, so that no
    splitter is long and texts with a common beginning still spread. Each task sorts its range (spilling to disk), and
    neighbours that are equal in full form a group. ``keep`` says whether the ``smallest`` or the ``largest`` id stays.

    A text with more copies than a quarter of a task's fair share is cut into slices that sort apart, so that no task
    gets all of it; size and surviving id of such a group come from the counts that found it, by SHA-256. There are at
    most four such texts for each shuffle task, which bounds their broadcast.

    A null text counts as empty. Of rows with the same text and id exactly one is kept. A null id is chosen only where
    a group has no other; ``keep_id`` is then null. No rows give no rows; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    last = keep == "largest"
    pick = F.max if last else F.min
    body = normalise(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("id"), body.alias("body")).withColumn("sha", F.sha2("body", 256))
    tasks = width(docs.sparkSession)
    share = max(1, docs.count() // (4 * tasks))
    hot = (
        texts.groupBy("sha").agg(F.count(F.lit(1)).alias("all"), pick("id").alias("best"))
        .filter(F.col("all") > share)
        .withColumn("slices", F.ceil(F.col("all") / share))
    )
    sliced = texts.join(F.broadcast(hot), "sha", "left").withColumn(
        "slice", F.coalesce(F.pmod(F.xxhash64("id"), "slices"), F.lit(0)).cast("int")
    )
    # splitters are sampled rows that pass through the driver: a text's first characters and its hash stand for it there
    ranged = sliced.withColumn("head", F.substring("body", 1, HEAD)).repartitionByRange(tasks, "head", "sha", "slice")
    equal = Window.partitionBy("head", "sha", "slice", "body")
    ordered = equal.orderBy(F.col("id").desc_nulls_last() if last else F.col("id").asc_nulls_last())
    grouped = (
        ranged.withColumn("place", F.row_number().over(ordered))
        .withColumn("here", F.count(F.lit(1)).over(equal))
        .withColumn("first", pick("id").over(equal))
        .select(
            "id", "place", "sha",
            F.when(F.col("slices").isNotNull(), F.col("best")).otherwise(F.col("first")).alias("keep_id"),
            F.coalesce("all", "here").alias("group_size"),
        )
    )
    return grouped.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        ((F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
