"""Profiles: what each column holds, with counts only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import refuse_any, refuse_if
from ..functions import numbers as N
from ..functions import text as X
from ..policy import Limits, Policy, decision_counts
from ..sources.tables import check_headings, data_columns, quoted

LONG = 64


def column_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long form ``(column, value)`` in one scan."""
    names = columns if columns is not None else data_columns(df)
    cells = [F.struct(F.lit(n).alias("column"), quoted(n).alias("value")) for n in names]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.column", "c.value")


def distinct_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)``: partial counts are merged map-side, so a value filling a
    third of the rows costs one row per task."""
    return column_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: class, type, cardinality, blanks, rare values and flags.

    Values longer than a category are never shuffled: their predicates are evaluated in
    the scan and only their digest is grouped.
    """
    v = F.col("value")
    is_long = F.length(v) > LONG

    def early(hit: Column) -> Column:
        return F.when(is_long, hit)

    keyed = column_values(df).select(
        "column",
        F.when(is_long, F.lit(None)).otherwise(v).alias("short"),
        F.when(is_long, X.digest(v)).alias("digest"),
        early(X.identifier_shaped(v)).alias("ident"),
        early(v.rlike(X.PRECISE)).alias("precise"),
        early(X.is_blank(v)).alias("blank"),
        early(N.finite_number(v)).alias("finite"),
        early(N.finite_number(v) & N.integral_number(v)).alias("integral"),
    )
    flags = ["ident", "precise", "blank", "finite", "integral"]
    grouped = keyed.groupBy("column", "short", "digest").agg(
        F.count(F.lit(1)).alias("n"), *[F.bool_or(f).alias(f) for f in flags]
    )
    s = F.col("short")
    late = {
        "ident": X.identifier_shaped(s),
        "precise": s.rlike(X.PRECISE),
        "blank": X.is_blank(s),
        "finite": N.finite_number(s),
        "integral": N.finite_number(s) & N.integral_number(s),
    }
    judged = grouped.select(
        "column",
        "n",
        (s.isNull() | (s != "")).alias("present"),
        *[F.coalesce(F.col(f), late[f]).alias(f) for f in flags],
        (s.isNull() | X.free_text_shaped(s) | X.formula_or_control(s)).alias("unsafe"),
    )
    stats = judged.groupBy("column").agg(
        F.count(F.lit(1)).alias("cardinality"),
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank_count"),
        F.count_if(F.col("n") < 2).alias("categories_below_2"),
        F.count_if("present").alias("present"),
        F.count_if(F.col("present") & F.col("finite")).alias("finite"),
        F.count_if(F.col("present") & F.col("integral")).alias("integral"),
        F.bool_or("ident").alias("ident"),
        F.bool_or("unsafe").alias("unsafe"),
        F.bool_or("precise").alias("precise"),
    )
    return stats.select(
        "column",
        X.heading_class(F.col("column")).alias("inferred_classification"),
        N.number_type(F.col("present"), F.col("finite"), F.col("integral")).alias("type"),
        "cardinality",
        "n_rows",
        "blank_count",
        "categories_below_2",
        F.array_compact(
            F.array(
                F.when(F.col("ident"), "identifier_or_date_shape"),
                F.when(F.col("unsafe"), "free_text_or_unsafe_cell"),
                F.when(F.col("cardinality") / F.col("n_rows") > 0.5, "high_cardinality"),
                F.when(F.col("precise"), "precise_number"),
            )
        ).alias("flags"),
    )


def type_counts(df: DataFrame) -> DataFrame:
    """Inferred type per column straight from one aggregate (no shuffle of values)."""
    names = data_columns(df)
    aggs = []
    for i, n in enumerate(names):
        c = quoted(n)
        aggs += [
            F.count_if(c != "").alias(f"p{i}"),
            F.count_if(N.finite_number(c)).alias(f"f{i}"),
            F.count_if(N.finite_number(c) & N.integral_number(c)).alias(f"i{i}"),
        ]
    cells = [
        F.struct(
            F.lit(n).alias("column"),
            N.number_type(F.col(f"p{i}"), F.col(f"f{i}"), F.col(f"i{i}")).alias("type"),
        )
        for i, n in enumerate(names)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def category_review(df: DataFrame, column: str, limits: Limits = Limits()) -> tuple[list[str], int]:
    """(sorted distinct labels, blank count) of a bounded, safe category column."""
    refuse_if(column not in df.columns, "headings changed")
    c = quoted(column)
    groups = df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value")
    stats = groups.agg(
        F.coalesce(F.sum(F.when(X.is_blank(v), F.col("n"))), F.lit(0)).alias("blank"),
        F.count_if(~X.is_blank(v)).alias("labels"),
        F.count_if(~X.is_blank(v) & ~X.safe_category(v)).alias("unsafe"),
    ).first()
    refuse_any(
        "category review",
        {"too_many": stats.labels if stats.labels > limits.categories else 0, "unsafe": stats.unsafe},
    )
    # Bounded by the check above.
    labels = groups.filter(~X.is_blank(v)).select("value").orderBy("value").collect()
    return [r.value for r in labels], int(stats.blank)


def categories(df: DataFrame, column: str, limits: Limits = Limits()) -> list[str]:
    """As :func:`category_review`, refusing blanks and an empty domain."""
    labels, blank = category_review(df, column, limits)
    refuse_any("category review", {"blank": blank, "empty": int(not labels)})
    return labels


def category_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: distinct labels, blanks and unsafe labels, as a table.

    A value too long for a category is unsafe whatever it says, so only its digest is
    shuffled.
    """
    v, s = F.col("value"), F.col("short")
    is_long = F.length(v) > LONG
    groups = (
        column_values(df, columns)
        .groupBy(
            "column",
            F.when(~is_long, v).alias("short"),
            F.when(is_long, X.digest(v)).alias("digest"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or(is_long & X.is_blank(v)).alias("long_blank"))
    )
    blank = F.coalesce(X.is_blank(s), F.col("long_blank"))
    safe = F.coalesce(X.safe_category(s), F.lit(False))
    return (
        groups.select("column", "n", blank.alias("blank"), safe.alias("safe"))
        .groupBy("column")
        .agg(
            F.count_if(~F.col("blank")).alias("labels"),
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank_count"),
            F.count_if(~F.col("blank") & ~F.col("safe")).alias("unsafe_labels"),
        )
    )


def review_entries(df: DataFrame, column: str) -> DataFrame:
    """``(digest, original, count)`` per distinct text. Grouped by digest: the text
    itself rides along once per partial group."""
    c = quoted(column)
    return (
        df.select(X.digest(c).alias("digest"), c.alias("original"))
        .groupBy("digest")
        .agg(F.first("original").alias("original"), F.count(F.lit(1)).alias("count"))
    )


def check_review_entries(entries: DataFrame, limits: Limits = Limits()) -> None:
    row = entries.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length("original")), F.lit(0)).alias("bytes"),
    ).first()
    refuse_any(
        "text review size",
        {
            "empty": int(row.n == 0),
            "texts": row.n if row.n > limits.reviews else 0,
            "bytes": row.bytes if row.bytes > limits.review_bytes else 0,
        },
    )


def id_counts(df: DataFrame, column: str = "record_id") -> DataFrame:
    """One row: rows, ids that are no canonical UUIDv4, distinct ids."""
    c = quoted(column)
    grouped = df.groupBy(c.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~X.is_uuid4(F.col("id")), F.col("n"))), F.lit(0)).alias("bad_ids"),
        F.count(F.lit(1)).alias("distinct_ids"),
    )


def inspect_returned(df: DataFrame) -> tuple[int, list[str]]:
    """(row count, result headings) of a returned table with sound ids."""
    names = data_columns(df)
    refuse_if("record_id" not in names or len(names) < 2, "needs record_id and a result column")
    check_headings([n for n in names if n != "record_id"])
    row = id_counts(df).first()
    refuse_any(
        "returned ids",
        {
            "empty": int(row.n_rows == 0),
            "malformed": row.bad_ids,
            "duplicated": row.n_rows - row.distinct_ids,
        },
    )
    return int(row.n_rows), [n for n in names if n != "record_id"]


def decision_summary(df: DataFrame, policy: Policy) -> DataFrame:
    """One row: source rows and the number of columns per kind of decision."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.lit(n).cast("long").alias(k) for k, n in decision_counts(policy).items()],
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
