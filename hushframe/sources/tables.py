"""Text-typed tables: scan, append, shape checks and conversion counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused, refuse_any, refuse_if
from ..functions import text as X
from ..functions.numbers import double_text
from ..workspace import Workspace
from .rows import ROW, number_block_rows, number_file_rows

RESERVED = ("record_id", "entity_id")
# How CSV is read and written alike: every cell quoted, a quote inside doubled, line breaks kept. A file is then one
# split; large tables have many files.
CSV = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "quoteAll": True, "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n",
}


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def iso_text(c: Column, kind: T.DataType) -> Column:
    """ISO text of a date or timestamp; six fraction digits when there are any."""
    shown = c.cast("string")
    if isinstance(kind, T.DateType):
        return shown
    whole = F.replace(F.substring(shown, 1, 19), F.lit(" "), F.lit("T"))
    fraction = F.rpad(F.substring(shown, 21, 6), 6, "0")
    return F.when(F.length(shown) == 19, whole).otherwise(F.concat(whole, F.lit("."), fraction))


def cell_text(c: Column, kind: T.DataType, dates: bool, places: int | None = None) -> Column:
    if isinstance(kind, T.StringType):
        shown = c
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and dates:
        shown = iso_text(c, kind)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = (
            double_text(c.cast("double"))
            if places is None
            else c.cast(f"decimal(38,{places})").cast("string")
        )
    elif isinstance(kind, (T.IntegralType, T.DecimalType)):
        shown = c.cast("string")
    else:
        raise Refused("unsupported cell type")
    return F.coalesce(shown, F.lit(""))


def as_text(
    df: DataFrame, dates: bool = True, places: dict[str, int] | None = None
) -> DataFrame:
    """Every cell as text: NULL is '', numbers keep their shortest exact text (or a fixed
    scale from ``places``), dates become ISO text when ``dates`` allows them."""
    places = places or {}
    return df.select(
        *[
            quoted(f.name)
            if f.name == ROW
            else cell_text(quoted(f.name), f.dataType, dates, places.get(f.name)).alias(f.name)
            for f in df.schema
        ]
    )


def heading_ok(name: object) -> bool:
    return (
        isinstance(name, str)
        and bool(name.strip())
        and len(name) <= X.MAX_FIELD
        and not any((ord(ch) < 32 and ch not in "\t\r\n") or ord(ch) == 127 for ch in name)
    )


def check_headings(names: list[str], reserved: tuple[str, ...] = ()) -> None:
    refuse_if(not names, "headings are missing")
    refuse_any(
        "headings",
        {
            "unsupported": sum(not heading_ok(n) for n in names),
            "duplicated": len(names) - len(set(names)),
            "reserved": sum(n in reserved for n in names),
        },
    )


def append_tables(parts: list[DataFrame], allow_reordered: bool = False) -> DataFrame:
    """Rows of same-schema tables in the supplied order; ``_row`` continues over parts."""
    refuse_if(not parts, "no table given")
    first = data_columns(parts[0])
    for part in parts[1:]:
        names = data_columns(part)
        same = set(names) == set(first) if allow_reordered else names == first
        refuse_if(not same or len(names) != len(first), "headings differ between appended tables")
    numbered = all(ROW in p.columns for p in parts)
    offset, out = 0, None
    for i, part in enumerate(parts):
        if numbered:
            part = part.withColumn(ROW, F.col(ROW) + offset)
            if i + 1 < len(parts):
                offset += parts[i].count()
        out = part if out is None else out.unionByName(part)
    return out


def load_table(
    spark: SparkSession,
    paths: str | list[str],
    ws: Workspace,
    fmt: str = "parquet",
    dates: bool = True,
    places: dict[str, int] | None = None,
    allow_reordered: bool = False,
    schema: T.StructType | str | None = None,
    columns: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Text-typed table with ``_row``; several paths are appended in order. A file of one row group (or a CSV file) is one
    task: with ``partitions`` the typed, pruned rows are dealt out by row number before they become text."""
    parts = []
    for path in [paths] if isinstance(paths, str) else paths:
        reader = spark.read if schema is None else spark.read.schema(schema)
        if fmt == "csv":
            reader = reader.options(**CSV)
        raw = reader.format(fmt).load(path)
        if columns is not None:
            raw = raw.select(*[quoted(c) for c in columns])
        check_headings(raw.columns, reserved=(ROW,))
        numbered = number_file_rows(raw) if fmt == "parquet" else number_block_rows(raw, ws)
        if partitions is not None:
            numbered = numbered.repartition(partitions, ROW)
        parts.append(as_text(numbered, dates, places))
    return append_tables(parts, allow_reordered)


def load_related(
    spark: SparkSession, paths: dict[str, str], ws: Workspace, **options
) -> dict[str, DataFrame]:
    """Several named tables, each keeping its own schema."""
    refuse_if(not paths or any(not heading_ok(n) for n in paths), "table names")
    return {name: load_table(spark, path, ws, **options) for name, path in paths.items()}


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables (files or directories) in a folder, hidden ones left out."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in fs.listStatus(target)]
    return sorted(n.rsplit(".", 1)[0] for n in names if not n.startswith(("_", ".")))


def extra_tables(found: list[str], bound: list[str]) -> list[str]:
    """Tables outside the bound set; a missing bound table is refused."""
    refuse_if(not set(bound) <= set(found), "a bound table is missing")
    return [n for n in found if n not in set(bound)]


def row_shape_counts(df: DataFrame) -> DataFrame:
    """One row: total rows, all-blank rows, rows with an oversized or NUL-holding field."""
    cells = [quoted(c) for c in data_columns(df)]
    blank = F.lit(True)
    bad = F.lit(False)
    for c in cells:
        blank = blank & (c == "")
        bad = bad | (F.length(c) > X.MAX_FIELD) | F.contains(c, F.lit("\x00"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(blank).alias("blank_rows"),
        F.count_if(bad).alias("bad_field_rows"),
    )


def check_row_shape(df: DataFrame) -> None:
    row = row_shape_counts(df).first()
    refuse_any("row shape", {"blank_rows": row.blank_rows, "bad_field_rows": row.bad_field_rows})


def conversion_counters(df: DataFrame) -> DataFrame:
    """Of a typed table: how many temporal cells become text."""
    temporal = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]
    total = F.lit(0).cast("long")
    for name in temporal:
        total = total + F.count(quoted(name))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("date_cells"))


def cell_counters(cells: DataFrame) -> DataFrame:
    """Of a cell table: temporal cells, saved formula results, formulas without one."""
    formula = F.col("kind") == "formula"
    return cells.agg(
        F.count_if(F.col("kind") == "date").alias("date_cells"),
        F.count_if(formula & F.col("text").isNotNull()).alias("formula_cells"),
        F.count_if(formula & F.col("text").isNull()).alias("unsaved_formulas"),
    )


def unsafe_cells(df: DataFrame, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(count of cells holding control characters, their coordinates; with ``first`` the first ones).

    Coordinates are (row, column position, heading); values never leave the table.
    """
    names = data_columns(df)
    hit = [
        F.when(
            X.has_control(quoted(n)),
            F.struct(F.lit(i).alias("_col"), F.lit(n).alias("column")),
        )
        for i, n in enumerate(names)
    ]
    found = df.select(ROW, F.explode(F.array_compact(F.array(*hit))).alias("c")).select(
        ROW, "c._col", "c.column"
    )
    listed = found if first is None else found.orderBy(ROW, "_col").limit(first)
    return found.agg(F.count(F.lit(1)).alias("cells")), listed
