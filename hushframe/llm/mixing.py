"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .common import current, fresh, scratch, written

#: Slices of the key's range: a source's rows are summed by slice, and only the slice with its cut is sorted.
SLICES = 4096


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from the id's text and the seed, the same in every run."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, weight, source_size): ``share`` of all sizes by weight, none above ``most`` times its
    source's size; the excess is shared again by weight until none is above. Each round is one aggregate over the table
    of sources, and caps at least one more source. Where every source is at its cap, less than the share is mixed."""
    cap = F.col("source_size") * most
    level = 0.0
    while True:
        over = F.col("weight") * level > cap
        total, capped, weight, n_over = sizes.agg(
            F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))),
            F.count(F.when(over, F.lit(1))),
        ).first()
        if not total or not weight:
            break
        raised = (total * share - (capped or 0.0)) / weight
        if raised <= level:
            break
        level = raised
    return sizes.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), cap).cast("double"))


def mix(
    docs: DataFrame,
    weights,
    size: Column,
    quality: DataFrame | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    share: float = 1.0,
    most: float = 3.0,
    seed: int = 8,
    unlabelled: float = 1.0,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each row of ``docs``.

    ``size`` gives a row's words; ``weights`` makes (source, weight) of a table of sources; ``quality`` is (id, quality)
    with a positive weight for some documents (others: ``unlabelled``).

    A source of target t and size s takes every document floor(t / s) times: complete epochs. For the fraction that is
    left, documents are sorted by the exponential keys -ln(u) / quality (so good ones come first more often) and their
    sizes prefix-summed; a document is taken once more if more than half of it lies before the cut, which brings the
    source to its target within half a document. u comes from the id, so that reruns agree.

    The prefix sums are made of slices of u ** (1 / quality): slices are summed by source, and only the slice that holds
    a source's cut is sorted. A source with a third of all rows needs no task of its own.

    Null sources form one source, null ids count as the empty id, and repeated rows are taken each on its own (in the
    order of key, id, size). A source without words takes its documents floor(most) times at no cost.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size")
    )
    if quality is not None:
        by_id = quality.select(F.col(quality.columns[0]).alias("id"), F.col(quality.columns[1]).alias("quality"))
        by_id = by_id.filter("id is not null").groupBy("id").agg(F.max("quality").alias("quality"))
        rows = rows.join(by_id, "id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(unlabelled))
    good = F.coalesce(F.when(F.col("quality") > 0, F.col("quality").cast("double")), F.lit(unlabelled))
    rows = rows.withColumn("key", -F.log(uniform(F.col("id"), seed)) / good).drop("quality")
    rows = written(
        rows.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key"))) * SLICES), F.lit(SLICES - 1)).cast("int")), "mix"
    )
    slices = written(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    sizes = written(weights(slices.groupBy("source").agg(F.sum("words").alias("source_size"))), "sources")
    goals = targets(sizes, share, most).select(
        "source", "source_size", "target",
        F.coalesce(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))), F.lit(int(most)))
        .cast("long").alias("epochs"),
    )
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    goals = goals.withColumnRenamed("source", "of")
    plan = written(
        slices.join(F.broadcast(goals) if sizes.count() <= 10_000 else goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
        .withColumn(
            "side",
            F.when(F.col("rest") <= 0, 1).when(F.col("before") + F.col("words") <= F.col("rest"), -1)
            .when(F.col("before") >= F.col("rest"), 1).otherwise(0),
        ),
        "cuts",
    )
    few = plan.count() <= 200_000
    cut = plan.withColumnsRenamed({"source": "of", "slice": "at"})
    on = F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at"))
    placed = rows.join(F.broadcast(cut) if few else cut, on).drop("of", "at", "words")
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = placed.filter("side = 0").withColumn(
        "once", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2 < F.col("rest")
    )
    clear = placed.filter("side <> 0").withColumn("once", F.col("side") == -1)
    both = clear.unionByName(at_cut)
    return both.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("epochs") + F.col("once").cast("long")).alias("copies"),
        (F.col("size") * (F.col("epochs") + F.col("once").cast("long"))).alias("taken"),
    )


def mix_rows(docs: DataFrame, weights, size: Column, quality: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it. Rows with the same id, source and size are all taken as
    often as the one of them that is taken most."""
    key, key_source, key_size, n = (fresh(docs, x) for x in ("mix_id", "mix_source", "mix_size", "mix_copies"))
    outer = current() or Workspace(docs.sparkSession)
    with scratch(docs.sparkSession):
        mixed = mix(docs, weights, size, quality, id_col, source_col, **options)
        copies = mixed.groupBy(F.col(id_col).alias(key), F.col(source_col).alias(key_source), F.col("size").alias(key_size))
        copies = written(copies.agg(F.max("copies").cast("int").alias(n)).filter(F.col(n) > 0), "copies", outer)
    on = F.col(id_col).eqNullSafe(F.col(key)) & F.col(source_col).eqNullSafe(F.col(key_source))
    on &= F.coalesce(size, F.lit(0)) == F.col(key_size)
    taken = docs.join(copies, on).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return taken.select(docs.columns)
