"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with literal tokens that every match contains. Each rule is
filed under the token (or the alternatives) that the fewest urls hold; a url fetches the rules filed under its own tokens, and only those
rules' expressions run on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lower_ascii

#: Rules up to this many are broadcast; more are joined by a shuffle that Spark splits where a token is hot.
BROADCAST_RULES = 20_000
SITE, PATTERN = "site", "pattern"


@dataclass(frozen=True)
class Rule:
    """``name`` is shown in results; ``tokens`` must be whole tokens (``[0-9a-z]+``) of every url that ``regex`` finds. A
    token may name alternatives, ``a|b``, of which every such url has one: the rule is then filed under each."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    kind: str = PATTERN


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^0-9a-z]+", text.lower()) if t]


def site_rule(action: str, host: str, path: str) -> Rule:
    """A host with its subdomains, and the start of a path."""
    parts = tokens_of(path)
    if parts and re.search(r"[0-9A-Za-z]$", path):
        parts.pop()  # the url's token may go on
    # Only these characters mean something in a Java expression; re.escape is Python's.
    literal = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", host + path)
    regex = r"^(?:[^/]*\.)?" + literal + ("" if path else "(?:/|$)")
    return Rule(host + path, action, regex, (*tokens_of(host), *parts), SITE)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host between the first ``://`` and ``/``, ``?``, ``#`` or the end, its A-Z lower-cased; the path
    from there up to ``?``, ``#`` or the end. Both are empty for null and without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_no, name, action, kind, regex, tokens), made without a Python source."""
    rows = [
        F.struct(
            F.lit(i).alias("rule_no"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"),
            F.lit(r.kind).alias("kind"), F.lit(r.regex).alias("regex"),
            F.array([F.lit(t) for t in r.tokens] or [F.lit("")]).alias("tokens"),
        )
        for i, r in enumerate(rules)
    ]
    empty = "array<struct<rule_no:int,name:string,action:string,kind:string,regex:string,tokens:array<string>>>"
    table = F.array(*rows) if rows else F.array().cast(empty)
    return spark.range(1).select(F.inline(table))


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """(id, host, path, rule, verdict, pattern): one row for each row of ``pages``, repeated rows included.

    Site rules come first: the longest that fits decides (of equal length the later name, then ``block``). Else any
    fitting pattern rule with ``block`` blocks, else one with ``allow`` allows, else ``otherwise`` holds. ``rule`` is the
    deciding site rule, ``pattern`` the deciding pattern rule. A null url, or one without ``://``, has an empty host and
    path and gets ``otherwise``, unless a rule without tokens fits. No rules or no pages are fine.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    urls = urls.withColumn("key", key).withColumn(
        # the empty token fetches rules without any literal
        "tokens", F.array_distinct(F.concat(F.split(F.lower("key"), "[^0-9a-z]+"), F.array(F.lit(""))))
    )
    table = rule_table(spark, rules)
    named = table.select("rule_no", F.explode(F.array_distinct("tokens")).alias("tokens"))
    named = named.withColumn("token", F.explode(F.array_distinct(F.split("tokens", "[|]"))))
    few = sum(1 + t.count("|") for r in rules for t in r.tokens or ("",)) <= BROADCAST_RULES
    small = F.broadcast if few else (lambda side: side)
    seen = (
        urls.select(F.explode("tokens").alias("token"))
        .join(small(named.select("token").distinct()), "token")
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    index = (
        named.join(seen, "token", "left")
        .groupBy("rule_no", "tokens").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        .groupBy("rule_no").agg(F.min(F.struct("n", "tokens"))["tokens"].alias("tokens"))
        .select("rule_no", F.explode(F.array_distinct(F.split("tokens", "[|]"))).alias("token"))
        .join(table.drop("tokens"), "rule_no")
    )
    found = (
        urls.withColumn("row", F.monotonically_increasing_id())
        .withColumn("token", F.explode("tokens")).drop("tokens")
        .join(small(index), "token", "left")
        .withColumn("fits", F.expr("regex is not null and key rlike regex"))
    )
    best = F.max(
        F.when(F.col("fits") & (F.col("kind") == SITE), F.struct(F.length("name").alias("size"), "name", "action"))
    )
    # "block" sorts after "allow"
    other = F.max(F.when(F.col("fits") & (F.col("kind") == PATTERN), F.struct("action", "name")))
    judged = found.groupBy("row").agg(
        F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"),
        best.alias("best"), other.alias("other"),
    )
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.name").alias("rule"),
        F.coalesce("best.action", "other.action", F.lit(otherwise)).alias("verdict"),
        F.when(F.col("best").isNull(), F.col("other.name")).alias(fresh(pages.select(id_col), "pattern")),
    )
