"""Sums of hashes that identify a multiset without gathering it.

Addition is commutative, so partial sums are built map-side and one key may own any
share of the rows: no list is collected per key. (Clarke et al., "Incremental multiset
hash functions and their application to memory integrity checking", 2003.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LANE = "decimal(38,0)"


def framed(columns: list[Column]) -> Column:
    """Unambiguous text of several cells: each is preceded by its length, a NULL is a mark of its own."""
    cells = [c.cast("string") for c in columns]
    return F.concat(
        *[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]
    )


def feature_lane(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), framed(list(parts))).cast("decimal(20,0)")


def feature_sums(cells: list[tuple[Column, ...]], lanes: int = 2) -> list[Column]:
    """Per row: 64-bit lanes summed over the row's cells, ready for ``sum`` per key."""
    if not cells:
        return [F.lit(0).cast("decimal(26,0)") for _ in range(lanes)]
    return [
        reduce(lambda a, b: a + b, [feature_lane(seed, *cell) for cell in cells]).cast(
            "decimal(28,0)"
        )
        for seed in range(1, lanes + 1)
    ]


def sha_lanes(c: Column) -> list[Column]:
    """Four 60-bit integers out of a SHA-256 of the text ``c``."""
    hexed = F.sha2(F.encode(c, "UTF-8"), 256)
    return [F.conv(F.substring(hexed, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(4)]


def lane_sum(name: str) -> Column:
    """Exact sum of a column of 60-bit integers, 0 of no rows: thirds of 20 bits are summed as longs, which costs a row less
    than sums of decimals."""
    thirds = [
        F.sum(F.shiftright(name, bits).bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(20,0)") * F.lit(1 << bits).cast("decimal(13,0)")
        for bits in (40, 20, 0)
    ]
    return F.coalesce(reduce(lambda a, b: a + b, thirds).cast(LANE), F.lit(0).cast(LANE))
