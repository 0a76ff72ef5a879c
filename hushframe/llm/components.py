"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b), a > b. Each node's least neighbour (itself included) is found by one aggregate and written;
    then every link is moved to it. Large: of a node's greater neighbours; small: of its lesser ones and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = written(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    least = least.select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    moved = both.join(least, F.col("a") == F.col("node"))
    if large:
        new = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("m").alias("b"))
        )
    return written(new.filter("a > b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b) can reach; nodes without a link are absent.

    The rounds stop when all links are stars; their number grows with the logarithm of the longest chain. Every step
    is written to the shared folder; nothing is collected. A node with very many links is only aggregated (combined
    before the shuffle) and joined (Spark splits the large side of such a join). Self-links and repeated links do no
    harm, a link with a null end is ignored, and no links give no rows.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(ends.filter("a > b").distinct(), "links")
    while _unsettled(now):
        now = _starred(_starred(now, True), False)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _unsettled(links: DataFrame) -> bool:
    """Whether (a, b), a > b, are no stars yet: in a star each a has one b, the least node, which is no a."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return each.filter("down > 1 or down > 0 and up > 0").limit(1).count() > 0
