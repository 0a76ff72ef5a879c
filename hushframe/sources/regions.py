"""Tables inside a grid: ``cells(book, sheet, row, col, kind, text)``.

Discovery finds islands of consecutive occupied rows. Rows are cut into blocks; islands
are found inside each block and only those touching a block's edge are stitched, so a
huge sheet is never ranked in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import refuse_any, refuse_if
from .rows import ROW
from .tables import check_headings, check_row_shape, heading_ok

# --- Fixed values ---
BLOCK = 65_536
MAX_NAME = 31
#: Tiles that a rectangle touches along an axis, at most about.
TILES = 64
# --- end of fixed values ---

BOUNDS = ["left", "top", "right", "bottom"]


def column_letters(c: Column) -> Column:
    """Column number (1-based, up to 18,278) as letters."""
    def letter(n: Column) -> Column:
        return F.char(n.cast("int") + 65)

    a = c - 1
    one = letter(a % 26)
    two = letter(F.floor((a - 26) / 26) % 26)
    three = letter(F.floor((a - 702) / 676) % 26)
    return F.when(c <= 26, one).when(c <= 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def range_text(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.concat(
        column_letters(left), top.cast("string"), F.lit(":"), column_letters(right), bottom.cast("string")
    )


def parse_range(text: str) -> tuple[int, int, int, int] | None:
    """Bounds of a canonical range such as ``B3:E5``; NULL for anything else."""
    m = re.fullmatch(r"([A-Z]{1,3})([1-9][0-9]*):([A-Z]{1,3})([1-9][0-9]*)", text)
    if not m:
        return None

    def number(letters: str) -> int:
        n = 0
        for ch in letters:
            n = n * 26 + ord(ch) - 64
        return n

    left, top, right, bottom = number(m[1]), int(m[2]), number(m[3]), int(m[4])
    return (left, top, right, bottom) if left <= right and top <= bottom else None


def overlap(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def in_blocks(regions: DataFrame, low: str = "top", high: str = "bottom") -> DataFrame:
    """Repeat each region once per row block it touches, for an equi-join on the block."""
    first, last = F.floor(F.col(low) / BLOCK), F.floor(F.col(high) / BLOCK)
    return regions.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def uncovered(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """Cells outside every declared table: a range anti-join, keyed on (sheet, row block)."""
    c = cells.withColumn("block", F.floor(F.col("row") / BLOCK).cast("long"))
    d = in_blocks(declared).select(
        F.col("book").alias("d_book"), F.col("sheet").alias("d_sheet"), F.col("block").alias("d_block"), *BOUNDS
    )
    on = (
        (c.book == d.d_book) & (c.sheet == d.d_sheet) & (c.block == d.d_block)
        & c.row.between(F.col("top"), F.col("bottom")) & c.col.between(F.col("left"), F.col("right"))
    )
    return c.join(d, on, "left_anti").drop("block")


def row_islands(rows: DataFrame) -> DataFrame:
    """Islands of consecutive rows from ``(book, sheet, row, left, right)`` (one per row), with their ``block`` or without."""
    key = ["book", "sheet"]
    blocked = rows if "block" in rows.columns else rows.withColumn("block", F.floor(F.col("row") / BLOCK).cast("long"))
    inside = Window.partitionBy(*key, "block").orderBy("row")
    local = (
        blocked.withColumn("island", F.col("row") - F.row_number().over(inside))
        .groupBy(*key, "block", "island")
        .agg(
            F.min("row").alias("top"), F.max("row").alias("bottom"),
            F.min("left").alias("left"), F.max("right").alias("right"),
        )
        .drop("island")
    )
    at_start = F.col("top") == F.col("block") * BLOCK
    at_end = F.col("bottom") == F.col("block") * BLOCK + BLOCK - 1
    inner = local.filter(~at_start & ~at_end).select(*key, *BOUNDS)
    # At most two islands per block remain; a new island starts where the gap is above 1.
    order = Window.partitionBy(*key).orderBy("top")
    starts = (F.col("top") - F.lag("bottom").over(order)) > 1
    edge = (
        local.filter(at_start | at_end)
        .withColumn("starts", F.coalesce(starts, F.lit(True)).cast("long"))
        .withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "island")
        .agg(
            F.min("top").alias("top"), F.max("bottom").alias("bottom"),
            F.min("left").alias("left"), F.max("right").alias("right"),
        )
        .select(*key, *BOUNDS)
    )
    return inner.unionByName(edge)


def discover_regions(cells: DataFrame, declared: DataFrame | None = None, max_width: int | None = None) -> DataFrame:
    """Proposed rectangles: declared tables as they are, then islands of occupied rows
    with two rows, two columns and no overlap with a table; with ``max_width`` none wider."""
    key = ["book", "sheet"]
    occupied = cells.filter(F.col("text").isNotNull())
    if declared is not None:
        occupied = uncovered(occupied, declared)
    # Nearly every cell has a row of its own: a block's cells meet before they are summed, not in the scan, where one task
    # would hold all rows of a file.
    placed = occupied.withColumn("block", F.floor(F.col("row") / BLOCK).cast("long")).repartition(*key, "block")
    rows = placed.groupBy(*key, "block", "row").agg(F.min("col").alias("left"), F.max("col").alias("right"))
    found = row_islands(rows).filter((F.col("top") < F.col("bottom")) & (F.col("left") < F.col("right")))
    if max_width is not None:
        found = found.filter(F.col("right") - F.col("left") < max_width)
    if declared is not None:
        d = in_blocks(declared).select(
            F.col("book").alias("d_book"), F.col("sheet").alias("d_sheet"), F.col("block").alias("d_block"),
            *[F.col(b).alias(f"d_{b}") for b in BOUNDS],
        )
        f = in_blocks(found)
        touching = f.join(
            d,
            (f.book == d.d_book) & (f.sheet == d.d_sheet) & (f.block == d.d_block)
            & (f.left <= d.d_right) & (d.d_left <= f.right) & (f.top <= d.d_bottom) & (d.d_top <= f.bottom),
            "left_semi",
        ).select(*key, "top").distinct()
        found = found.join(touching, [*key, "top"], "left_anti").select(*key, *BOUNDS)
    out = found.withColumn("kind", F.lit("plain_range"))
    if declared is not None:
        out = out.unionByName(declared.select(*key, *BOUNDS, F.lit("declared_table").alias("kind")))
    return out.select(
        *key, *BOUNDS,
        range_text(F.col("left"), F.col("top"), F.col("right"), F.col("bottom")).alias("range"),
        F.col("top").alias("header_row"), "kind",
    )


def check_selection(
    selections: dict[str, tuple[str, str]], declared: list[tuple[str, tuple]] = ()
) -> dict[str, tuple[str, tuple[int, int, int, int]]]:
    """Bounds per chosen region ``{name: (sheet, range)}``, which the caller has written out by hand.

    No two rectangles on a sheet may overlap, and one touching a declared table must be it.
    """
    refuse_if(not selections, "number of regions")
    chosen = {}
    for name, (sheet, text) in selections.items():
        bounds = parse_range(text)
        refuse_if(
            not heading_ok(name) or len(name) > MAX_NAME or not sheet or bounds is None, "region selection"
        )
        refuse_if(any(s == sheet and overlap(bounds, b) for s, b in chosen.values()), "regions overlap")
        refuse_if(
            any(s == sheet and overlap(bounds, b) and tuple(b) != bounds for s, b in declared),
            "choose the complete declared table",
        )
        chosen[name] = (sheet, bounds)
    return chosen


def tiled(rectangles: DataFrame) -> DataFrame:
    """Each rectangle once for every tile it touches, with the tile's size and place (``th``, ``tw``, ``tr``, ``tc``). A
    sheet's tiles are as large as its rectangles on average, and large enough for its largest to touch few of them."""
    key = ["book", "sheet"]

    def side(low: str, high: str) -> Column:
        extent = F.col(high) - F.col(low) + 1
        return F.greatest(F.ceil(F.avg(extent)), F.ceil(F.max(extent) / TILES)).cast("long")

    sizes = rectangles.groupBy(*key).agg(side("top", "bottom").alias("th"), side("left", "right").alias("tw"))

    def places(low: str, high: str, size: str) -> Column:
        return F.explode(F.sequence(F.expr(f"`{low}` div {size}"), F.expr(f"`{high}` div {size}")))

    down = rectangles.join(sizes, key).withColumn("tr", places("top", "bottom", "th"))
    return down.withColumn("tc", places("left", "right", "tw"))


def overlapping(rectangles: DataFrame) -> DataFrame:
    """``(book, overlapping_pairs)`` of books with any: rectangles of two names meet in their tiles, and a pair counts in the
    tile that holds the upper left corner of what they share."""
    tiles = tiled(rectangles.select("book", "name", "sheet", *[F.col(b).cast("long").alias(b) for b in BOUNDS]))
    a, b = tiles.alias("a"), tiles.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("book", "sheet", "tr", "tc")]
    meet = (
        (F.col("a.name") < F.col("b.name"))
        & (F.col("a.left") <= F.col("b.right")) & (F.col("b.left") <= F.col("a.right"))
        & (F.col("a.top") <= F.col("b.bottom")) & (F.col("b.top") <= F.col("a.bottom"))
        & F.expr("greatest(a.top, b.top) div a.th = a.tr AND greatest(a.`left`, b.`left`) div a.tw = a.tc")
    )
    return a.join(b, [*same, meet]).groupBy(F.col("a.book").alias("book")).agg(F.count(F.lit(1)).alias("overlapping_pairs"))


def selection_verdicts(selections: DataFrame, max_regions: int | None = None, max_width: int | None = None) -> DataFrame:
    """Per book of ``(book, name, sheet, left, top, right, bottom)``: regions, overlapping
    pairs, validity. With ``max_regions`` or ``max_width`` books beyond them are invalid; pairs are counted all the same."""
    width = F.col("right") - F.col("left") + 1
    sized = selections.groupBy("book").agg(
        F.count(F.lit(1)).alias("regions"),
        F.count_if(F.length("name") > MAX_NAME).alias("bad_names"),
        (F.lit(0) if max_width is None else F.count_if(width > max_width)).alias("too_wide"),
    )
    fits = (F.col("bad_names") == 0) & (F.col("too_wide") == 0)
    if max_regions is not None:
        fits &= F.col("regions") <= max_regions
    pairs = F.coalesce("overlapping_pairs", F.lit(0))
    return sized.join(overlapping(selections), "book", "left").select(
        "book", "regions", pairs.alias("overlapping_pairs"), (fits & (pairs == 0)).alias("valid")
    )


def read_region(
    cells: DataFrame, book: str, sheet: str, bounds: tuple[int, int, int, int], totals_row: bool = False
) -> DataFrame:
    """The text table inside a rectangle: first row is the heading, ``_row`` from 0.

    Only the heading row reaches the driver.
    """
    left, top, right, bottom = bounds
    last = bottom - int(totals_row)
    inside = cells.filter(
        (F.col("book") == book) & (F.col("sheet") == sheet)
        & F.col("col").between(left, right) & F.col("row").between(top, last)
    )
    # The heading row and the flags of the whole rectangle in one small aggregate.
    state = inside.agg(
        F.count_if(F.col("kind").isin("merged", "hidden")).alias("merged_or_hidden"),
        F.count_if((F.col("kind") == "formula") & F.col("text").isNull()).alias("unsaved_formulas"),
        F.collect_list(F.when(F.col("row") == top, F.struct("col", "text"))).alias("head"),
    ).first()
    refuse_any("region", {"merged_or_hidden": state.merged_or_hidden, "unsaved_formulas": state.unsaved_formulas})
    by_col = {h.col: h.text for h in state.head}
    names = [by_col.get(c) or "" for c in range(left, right + 1)]
    check_headings(names)
    body = inside.filter(F.col("row") > top)
    values = [
        F.coalesce(F.max(F.when(F.col("col") == left + i, F.col("text"))), F.lit("")).alias(n)
        for i, n in enumerate(names)
    ]
    # A row without any cell is an all-blank row: it shows up as a missing row number.
    table = body.groupBy("row").agg(*values).withColumn(ROW, (F.col("row") - top - 1).cast("long"))
    table = table.select(*[F.col("`" + n.replace("`", "``") + "`") for n in names], ROW)
    n_rows = table.count()
    refuse_any("region rows", {"blank_rows": max(0, last - top - n_rows)})
    check_row_shape(table)
    return table


def read_regions(
    cells: DataFrame, book: str, selections: dict[str, tuple[str, str]], declared: list[tuple] = ()
) -> dict[str, DataFrame]:
    """Every chosen region as a named table; ``declared`` is ``(sheet, bounds, totals_row)``."""
    chosen = check_selection(selections, [(s, b) for s, b, _ in declared])
    totals = {(s, tuple(b)): t for s, b, t in declared}
    return {
        name: read_region(cells, book, sheet, bounds, totals.get((sheet, bounds), False))
        for name, (sheet, bounds) in chosen.items()
    }
