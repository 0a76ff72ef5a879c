"""Reviewed narrative text: issues, known identifiers, and binding to the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import refuse_any, refuse_if
from ..functions import ids
from ..functions import spans as S
from ..functions import text as X
from ..policy import Policy, heading_class
from ..sources.tables import data_columns, quoted
from .phrases import with_hits
from .profile import column_values


def identifier_columns(columns: list[str], declared: tuple[str, ...] = ()) -> list[str]:
    """Columns declared as identifying, and those whose heading says so."""
    refuse_if(not set(declared) <= set(columns), "headings changed")
    return [c for c in columns if c in declared or heading_class(c) == "direct_identifier"]


def declared_identifiers(policy: Policy) -> tuple[str, ...]:
    return tuple(
        n
        for n, r in policy.columns.items()
        if r.classification == "direct_identifier" or r.action == "pseudonymise"
    )


def source_identifiers(source: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct stripped, case-folded, non-blank identifying values: ``(identifier)``."""
    values = column_values(source, columns).select(X.strip(F.col("value")).alias("value"))
    distinct = values.filter(F.col("value") != "").distinct()
    return distinct.select(ids.casefold("value").alias("identifier")).distinct()


def known_identifier_pairs(texts: DataFrame, identifiers: DataFrame) -> DataFrame:
    """``(digest, identifier)`` for every identifier standing in a text ``(digest, text)`` as whole words."""
    found = with_hits(texts, "digest", "text", identifiers)
    return found.select("digest", F.explode(F.array_distinct(F.col("known.identifier"))).alias("identifier"))


def review_findings(reviews: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Issue codes and UTF-16 spans per approved text.

    ``reviews`` is ``(digest, approved)``; the result is ``(digest, issues, spans)`` for
    the texts with at least one issue.
    """
    found = with_hits(reviews.select("digest", "approved"), "digest", "approved", identifiers)
    known = F.transform(
        "known", lambda k: F.struct(F.lit("known_identifier").alias("reason"), k["start"].alias("start"), k["end"].alias("end"))
    )
    codes = F.concat(
        X.text_issues(F.col("approved")),
        F.when(F.size("known") > 0, F.array(F.lit("known_identifier"))).otherwise(F.array().cast("array<string>")),
    )
    spans = F.concat(S.issue_spans(F.col("approved")), known)
    return found.select("digest", codes.alias("issues"), S.utf16_spans(F.col("approved"), spans).alias("spans")).filter(
        F.size("issues") > 0
    )


def first_spans(findings: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """The texts with spans; with ``limit`` the first so many spans, in the given order of the texts.

    Each listed text holds at least one span, so the first ``limit`` texts suffice: a
    top-k selection first, then a running sum over those few rows.
    """
    listed = findings.filter(F.size("spans") > 0)
    if limit is None:
        return listed
    top = listed.orderBy(order).limit(limit)
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.size("spans")).over(before), F.lit(0))
    room = F.greatest(F.lit(limit) - used, F.lit(0)).cast("int")
    return top.withColumn("spans", F.slice("spans", 1, room)).filter(F.size("spans") > 0)


def binding_counts(source: DataFrame, column: str, reviews: DataFrame) -> DataFrame:
    """One row: texts without a review, reviews without a text, texts with controls."""
    c = quoted(column)
    digests = source.groupBy(X.digest(c).alias("digest")).agg(
        F.bool_or(X.has_unsafe_control(c)).alias("control"), F.lit(1).alias("in_source")
    )
    given = reviews.select("digest", F.lit(1).alias("in_reviews"))
    return digests.join(given, "digest", "full_outer").agg(
        F.count_if(F.col("in_reviews").isNull()).alias("unreviewed"),
        F.count_if(F.col("in_source").isNull()).alias("unknown_reviews"),
        F.count_if("control").alias("source_controls"),
    )


def review_map_counts(reviews: DataFrame) -> DataFrame:
    """One row: entries, malformed digests, repeated digests, unclean texts, bytes."""
    grouped = reviews.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(X.has_text_issue(F.col("approved")).cast("long")).alias("unclean"),
        F.sum(F.octet_length("approved").cast("long")).alias("bytes"),
    )
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.count_if(~F.col("digest").rlike(X.SHA256_HEX)).alias("bad_digests"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.coalesce(F.sum("unclean"), F.lit(0)).alias("unclean"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def approve_reviews(
    source: DataFrame, column: str, reviews: DataFrame, identifiers: DataFrame | None = None
) -> None:
    """Refuse unless every approved text is clean, free of known identifiers, and the
    reviews cover exactly the source's distinct texts."""
    names = data_columns(source)
    refuse_if(column not in names, "headings changed")
    refuse_if(heading_class(column) == "direct_identifier", "identifier heading under review")
    if identifiers is None:
        others = [c for c in identifier_columns(names) if c != column]
        identifiers = source_identifiers(source, others) if others else None
    row = review_map_counts(reviews).first()
    bound = binding_counts(source, column, reviews).first()
    counts = {
        "empty": int(row.entries == 0),
        "malformed": row.bad_digests,
        "repeated": row.repeated,
        "issues": row.unclean,
        "source_changed": bound.unreviewed + bound.unknown_reviews,
        "source_controls": bound.source_controls,
    }
    if identifiers is not None:
        found = with_hits(reviews.select("digest", "approved"), "digest", "approved", identifiers)
        counts["known_identifier"] = found.filter(F.size("known") > 0).count()
    refuse_any("text review", counts)


def review_table(spark, reviews: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(reviews.items()), "digest string, approved string")


def check_review_source(source: DataFrame, policy: Policy, reviews: dict | None = None) -> None:
    """Bind every reviewed column of a policy to the present source."""
    narrative = policy.of_action("review_text")
    if not narrative:
        return
    columns = identifier_columns(data_columns(source), declared_identifiers(policy))
    identifiers = source_identifiers(source, columns)
    for name in narrative:
        rule = policy.columns[name]
        refuse_if(rule.domain.from_table and name not in (reviews or {}), "a review table is missing")
        given = (
            reviews[name]
            if rule.domain.from_table
            else review_table(source.sparkSession, dict(rule.domain.approved))
        )
        approve_reviews(source, name, given, identifiers)


def candidate_mismatches(
    source: DataFrame, stage: DataFrame, column: str, reviews: DataFrame
) -> DataFrame:
    """One row: protected texts that are not the approved text of their source row."""
    wanted = source.select("_row", X.digest(quoted(column)).alias("digest"))
    got = stage.select("_row", quoted(column).alias("got"))
    paired = wanted.join(got, "_row", "full_outer").join(
        F.broadcast(reviews) if reviews.count() <= 200_000 else reviews, "digest", "left"
    )
    return paired.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("got").eqNullSafe(F.col("approved"))).alias("mismatches"),
    )
