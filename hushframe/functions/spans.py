"""Match positions inside a text as arrays of ``(reason, start, end)`` code-point spans.

``regexp_extract_all`` gives the matches and ``split`` the gaps between them; running
lengths of both give every position, so no Python is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (
    DATE,
    EMAIL,
    LONG_DIGITS,
    MAX_FIELD,
    SPACE,
    TIME,
    date_in,
    email_in,
    formula_prefix,
    is_blank,
    time_in,
)

SPAN = "struct<reason:string,start:int,end:int>"


def _span(reason: str, start: Column, end: Column) -> Column:
    return F.struct(
        F.lit(reason).alias("reason"), start.cast("int").alias("start"), end.cast("int").alias("end")
    )


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def pattern_spans(c: Column, pattern: str, reason: str, hit: Column | None = None) -> Column:
    """Every match of a pattern without groups, left to right; ``hit`` tells cheaply
    whether there is any."""
    state = f"struct<at:int,out:array<{SPAN}>>"
    pieces = F.arrays_zip(
        F.split(c, pattern, -1).alias("gap"),
        F.regexp_extract_all(c, F.lit(pattern), 0).alias("hit"),
    )

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        return F.struct(
            end.alias("at"),
            F.when(
                piece["hit"].isNotNull(), F.concat(acc["out"], F.array(_span(reason, start, end)))
            )
            .otherwise(acc["out"])
            .alias("out"),
        ).cast(state)

    zero = F.struct(F.lit(0).alias("at"), _none().alias("out")).cast(state)
    found = F.aggregate(pieces, zero, step, lambda acc: acc["out"])
    return F.when(c.rlike(pattern) if hit is None else hit, found).otherwise(_none())


def _trimmed(c: Column, spans: Column, lead: str, trail: str) -> Column:
    """Move both ends of each span inwards over the given characters."""

    def inner(span: Column) -> Column:
        text = F.substring(c, span["start"] + 1, span["end"] - span["start"])
        left = F.length(text) - F.length(F.regexp_replace(text, rf"^{lead}+", "")) if lead else F.lit(0)
        rest = F.substring(text, left + 1, F.length(text))
        right = F.length(rest) - F.length(F.regexp_replace(rest, rf"{trail}+\z", ""))
        return F.struct(
            span["reason"].alias("reason"),
            (span["start"] + left).cast("int").alias("start"),
            (span["end"] - right).cast("int").alias("end"),
        )

    return F.transform(spans, inner)


def issue_spans(c: Column) -> Column:
    """Spans of everything :func:`..text.text_issues` reports, in its order."""
    lead = F.length(c) - F.length(F.regexp_replace(c, rf"^[{SPACE}]++", ""))
    return F.concat(
        F.when(
            F.length(c) > MAX_FIELD, F.array(_span("too_long", F.lit(MAX_FIELD), F.length(c)))
        ).otherwise(_none()),
        F.when(
            (c != "") & is_blank(c), F.array(_span("whitespace_only", F.lit(0), F.length(c)))
        ).otherwise(_none()),
        F.when(
            formula_prefix(c), F.array(_span("formula_prefix", lead, lead + 1))
        ).otherwise(_none()),
        pattern_spans(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "control_character"),
        _trimmed(c, pattern_spans(c, EMAIL, "email", email_in(c)), r"[(<\[{]", r"[,.;:!?)\]}>]"),
        pattern_spans(c, DATE, "date", date_in(c)),
        pattern_spans(c, TIME, "time", time_in(c)),
        _trimmed(c, pattern_spans(c, LONG_DIGITS, "long_digits"), "", r"[^\p{Nd}]"),
    )


def utf16_spans(c: Column, spans: Column, limit: int | None = None) -> Column:
    """Distinct spans with UTF-16 offsets, by (start, end, reason); with ``limit`` the first so many."""

    def units(position: Column) -> Column:
        before = F.substring(c, 1, position)
        return (position + F.length(F.regexp_replace(before, r"[^\x{10000}-\x{10FFFF}]", ""))).cast("int")

    ordered = F.array_sort(
        F.transform(
            F.array_distinct(spans),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["reason"].alias("reason")),
        )
    )
    return F.transform(
        ordered if limit is None else F.slice(ordered, 1, limit),
        lambda s: F.struct(
            s["reason"].alias("reason"),
            units(s["start"]).alias("start"),
            units(s["end"]).alias("end"),
        ),
    )
