"""Redact text corpora: find identifiers, replace them by counted tokens, restore them.

A corpus is a table of runs ``(doc_id, part, para, run, text)``: the pieces of each
paragraph, in order. Attributes and link targets are rows ``(doc_id, part, ord, text)``.
Matches are found on the joined paragraph, so a name split over runs is one match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import refuse_any, refuse_if
from ..functions import ids
from ..functions import text as X
from ..functions.text import WORD
from ..workspace import Workspace
from .joins import keyed_join

# --- Fixed values of the redaction rules ---
KINDS = {"person": "PERSON", "email": "EMAIL", "identifier": "ID", "other": "TEXT"}
PREFIX = "HUSH"
TOKEN = rf"\[{PREFIX}-(?:PERSON|EMAIL|ID|TEXT)-[0-9A-F]{{8}}\]"
MAILBOX = rf"(?<![{WORD}.+\-])[{WORD}.+\-]+@[{WORD}.\-]+\.[A-Za-z]{{2,}}(?![{WORD}.\-])"
ORCID = r"(?<!\p{Nd})(?:\p{Nd}{4}-){3}\p{Nd}{3}[\p{Nd}Xx](?!\p{Nd})"
AFFILIATION = (
    rf"(?iu)(?<![{WORD}])(author|affiliation|acknowledg(?:e)?ments?|university|institute|department)(?![{WORD}])"
)
TITLED_NAME = (
    rf"(?<![{WORD}])(?:Dr|Prof|Professor|By)\.?[{X.SPACE}]+[A-Z][a-z]+(?:[{X.SPACE}]+[A-Z][a-z]+){{1,3}}(?![{WORD}])"
)
TERM_MIN, TERM_MAX = 3, 256
AUTHOR_METADATA = (
    "creator", "lastModifiedBy", "revision", "created", "modified", "Company", "Manager",
)
# --- end of fixed values ---

RUN_KEY = ["doc_id", "part", "para"]


def paragraphs(runs: DataFrame) -> DataFrame:
    """``(doc_id, part, para, runs, joined)``: one row per paragraph, runs in order."""
    grouped = runs.groupBy(*RUN_KEY).agg(
        F.array_sort(F.collect_list(F.struct("run", "text"))).alias("runs")
    )
    return grouped.withColumn("joined", F.array_join(F.transform("runs", lambda r: r["text"]), ""))


def whole_texts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Documents kept as one text per row, as one-run paragraphs (no grouping needed)."""
    run = F.struct(F.lit(0).alias("run"), F.col(text).alias("text"))
    return df.select(
        F.col(doc).alias("doc_id"),
        F.lit("body").alias("part"),
        F.lit(1).alias("para"),
        F.array(run).alias("runs"),
        F.col(text).alias("joined"),
    )


def _found(text: Column) -> Column:
    """Mailboxes, then researcher ids, as ``(rank, index, kind, value)``."""

    def listed(pattern: str, kind: str, rank: int) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), 0),
            lambda v, i: F.struct(
                F.lit(rank).alias("rank"), i.alias("i"), F.lit(kind).alias("kind"), v.alias("value")
            ),
        )

    # The plain pre-checks keep texts without an '@' or a digit group out of the regexes.
    none = F.array().cast("array<struct<rank:int,i:int,kind:string,value:string>>")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), listed(MAILBOX, "email", 0)).otherwise(none),
        F.when(text.rlike(r"\p{Nd}{4}-\p{Nd}{4}-"), listed(ORCID, "identifier", 1)).otherwise(none),
    )


def found_identifiers(paras: DataFrame, attributes: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """``(doc_id, at, kind, value)`` of every mailbox and researcher id; ``at`` orders
    them: per part its paragraphs, then its attributes, link targets last."""

    def place(stage: int, part: Column, sub: int, pos: Column) -> Column:
        return F.struct(
            F.lit(stage).alias("stage"), part.cast("string").alias("part"), F.lit(sub).alias("sub"),
            pos.cast("long").alias("pos"), F.col("f.rank").alias("rank"), F.col("f.i").alias("i"),
        ).alias("at")

    out = paras.select("doc_id", "part", "para", F.explode(_found(F.col("joined"))).alias("f")).select(
        "doc_id", place(0, F.col("part"), 0, F.col("para")), "f.kind", "f.value"
    )
    for stage, df in ((0, attributes), (1, links)):
        if df is not None:
            out = out.unionByName(
                df.select("doc_id", "part", "ord", F.explode(_found(F.col("text"))).alias("f")).select(
                    "doc_id", place(stage, F.col("part"), 1, F.col("ord")), "f.kind", "f.value"
                )
            )
    return out


def inventory(paras: DataFrame, attributes: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Per document: distinct mailboxes and researcher ids (documents with any)."""
    found = found_identifiers(paras, attributes, links)
    distinct = found.select("doc_id", "kind", "value").distinct()
    return distinct.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "email").alias("emails"),
        F.count_if(F.col("kind") == "identifier").alias("orcids"),
    )


def bad_term(value: Column, kind: Column) -> Column:
    stripped = X.strip(value)
    return (
        ~kind.isin(list(KINDS))
        | (F.length(value) < TERM_MIN)
        | (F.length(value) > TERM_MAX)
        | (value != stripped)
        | value.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    )


def unique_terms(terms: DataFrame) -> DataFrame:
    """``(doc_id, at, kind, value)``: the first of repeated values per document wins.

    A minimum per (document, value) merges map-side: no ranking over a whole document.
    """
    first = terms.groupBy("doc_id", "value").agg(F.min(F.struct("at", "kind")).alias("first"))
    return first.select("doc_id", "first.at", "first.kind", "value")


def check_terms(terms: DataFrame, max_terms: int | None = None) -> None:
    """Refuse malformed terms and, where a limit is given, documents with more terms."""
    per_doc = terms.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(bad_term(F.col("value"), F.col("kind")).cast("long")).alias("bad"),
    )
    row = per_doc.agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_terms"),
        F.count_if(F.col("n") > max_terms if max_terms is not None else F.lit(False)).alias("documents_with_too_many_terms"),
    ).first()
    refuse_any("terms", row.asDict())


def supplied_terms(terms: DataFrame) -> DataFrame:
    """Caller terms ``(doc_id, ord, kind, value)`` placed before anything discovered."""
    at = F.struct(
        F.lit(-1).alias("stage"), F.lit("").alias("part"), F.lit(0).alias("sub"),
        F.col("ord").cast("long").alias("pos"), F.lit(0).alias("rank"), F.lit(0).alias("i"),
    )
    return terms.select("doc_id", at.alias("at"), "kind", "value")


def draw_tokens(terms: DataFrame, ws: Workspace) -> DataFrame:
    """``(doc_id, at, kind, value, token)``: one random token per document and value.

    A repeat inside a document is redrawn until there is none; only repeats are redrawn.
    """
    label = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")]

    def drawn(df: DataFrame) -> DataFrame:
        hexed = ids.random_hex8(F.col("value"))
        return df.withColumn(
            "token", F.concat(F.lit(f"[{PREFIX}-"), label, F.lit("-"), hexed, F.lit("]"))
        )

    tokens = ws.keep(drawn(terms), "tokens")
    while True:
        ranked = tokens.withColumn(
            "_again", F.row_number().over(Window.partitionBy("doc_id", "token").orderBy("at")) > 1
        )
        if ranked.filter("_again").isEmpty():
            return tokens
        keep = ranked.filter("not _again").drop("_again")
        again = drawn(ranked.filter("_again").drop("_again", "token"))
        tokens = ws.keep(keep.unionByName(again), "tokens")


def term_lists(tokens: DataFrame) -> DataFrame:
    """``(doc_id, terms)``: the document's terms in their order (bounded by the term check)."""
    one = F.struct(F.col("at"), F.col("value"), F.col("token"))
    return tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("terms"))


MATCH = "struct<start:int,end:int,token:string>"


def _literal_matches(text: Column, term: Column) -> Column:
    """Occurrences of one term, left to right without overlap."""
    pieces = F.split(text, X.quote_literal(term["value"]), -1)
    width = F.length(term["value"])
    state = f"struct<at:int,out:array<{MATCH}>>"

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        one = F.struct(end.alias("start"), (end + width).alias("end"), term["token"].alias("token"))
        return F.struct(
            (end + width).alias("at"), F.concat(acc["out"], F.array(one.cast(MATCH))).alias("out")
        ).cast(state)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCH}>").alias("out")).cast(state)
    every = F.aggregate(pieces, zero, step, lambda acc: acc["out"])
    # The last piece is followed by no occurrence.
    return F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0)))


def chosen_matches(text: Column, terms: Column) -> Column:
    """Longest terms first (ties in term order), each left to right, skipping overlaps."""
    present = F.filter(terms, lambda t: F.contains(text, t["value"]))
    longest = F.array_sort(
        F.transform(
            present,
            lambda t: F.struct(
                (-F.length(t["value"])).alias("neg"), t["at"].alias("at"),
                t["value"].alias("value"), t["token"].alias("token"),
            ),
        )
    )
    all_matches = F.flatten(F.transform(longest, lambda t: _literal_matches(text, t)))
    none = F.array().cast(f"array<{MATCH}>")
    kept = F.aggregate(
        all_matches,
        none,
        lambda acc, m: F.when(
            F.exists(acc, lambda a: (m["start"] < a["end"]) & (a["start"] < m["end"])), acc
        ).otherwise(F.concat(acc, F.array(m))),
    )
    return F.array_sort(F.when(F.size(present) > 0, kept).otherwise(none))


def _rewritten(joined: Column, matches: Column, low: Column, high: Column) -> Column:
    """Text of the run covering ``low..high``: its uncovered characters, with each token
    in the run that holds the match's first character."""
    state = "struct<at:int,out:string>"

    def cut(a: Column, b: Column) -> Column:
        return F.substring(joined, a + 1, F.greatest(b - a, F.lit(0)))

    def step(acc: Column, m: Column) -> Column:
        starts_here = m["start"] >= low
        return F.struct(
            F.greatest(acc["at"], F.least(m["end"], high)).alias("at"),
            F.when(starts_here, F.concat(acc["out"], cut(acc["at"], m["start"]), m["token"]))
            .otherwise(acc["out"])
            .alias("out"),
        ).cast(state)

    mine = F.filter(matches, lambda m: (m["end"] > low) & (m["start"] < high))
    zero = F.struct(low.cast("int").alias("at"), F.lit("").alias("out")).cast(state)
    return F.aggregate(mine, zero, step, lambda acc: F.concat(acc["out"], cut(acc["at"], high)))


def rewritten_runs(runs: Column, joined: Column, matches: Column) -> Column:
    """The paragraph's runs with their new texts."""
    RUN = "struct<run:int,text:string>"
    state = f"struct<at:int,out:array<{RUN}>>"

    def step(acc: Column, r: Column) -> Column:
        high = acc["at"] + F.length(r["text"])
        one = F.struct(r["run"].alias("run"), _rewritten(joined, matches, acc["at"], high).alias("text"))
        return F.struct(high.alias("at"), F.concat(acc["out"], F.array(one.cast(RUN))).alias("out")).cast(state)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{RUN}>").alias("out")).cast(state)
    return F.aggregate(runs, zero, step, lambda acc: acc["out"])


def _with_terms(df: DataFrame, tokens: DataFrame, spread: str) -> DataFrame:
    """Attach each document's terms; a document owning many rows is spread."""
    lists = term_lists(tokens)
    per_doc = df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return keyed_join(df, lists, "doc_id", spread, counts=per_doc)


@dataclass
class Redacted:
    runs: DataFrame
    attributes: DataFrame | None
    links: DataFrame | None
    replacements: DataFrame
    tokens: DataFrame


def sequential_replace(text: Column, terms: Column, old: str, new: str) -> Column:
    """Plain replacement of every term in list order (later terms see earlier results)."""
    return F.aggregate(terms, text, lambda acc, t: F.replace(acc, t[old], t[new]))


def _attribute_pass(df: DataFrame, tokens: DataFrame) -> DataFrame:
    """Attributes rewritten in term order, with the tokens used: ``used`` is an array of
    ``(token, n)`` counted on the text as it stood when the term's turn came."""
    joined = _with_terms(df, tokens, "ord")
    USED = "struct<token:string,n:bigint>"
    state = f"struct<text:string,used:array<{USED}>>"

    def step(acc: Column, t: Column) -> Column:
        n = X.occurrences(acc["text"], t["value"])
        one = F.struct(t["token"].alias("token"), n.alias("n")).cast(USED)
        return F.when(
            F.contains(acc["text"], t["value"]),
            F.struct(
                F.replace(acc["text"], t["value"], t["token"]).alias("text"),
                F.concat(acc["used"], F.array(one)).alias("used"),
            ).cast(state),
        ).otherwise(acc)

    zero = F.struct(F.col("text"), F.array().cast(f"array<{USED}>").alias("used")).cast(state)
    done = F.when(F.col("terms").isNotNull(), F.aggregate("terms", zero, step)).otherwise(zero)
    return joined.withColumn("r", done).select("doc_id", "part", "ord", F.col("r.text").alias("text"), "r.used", "terms")


def _leaks(text: Column, terms: Column) -> Column:
    return F.transform(F.filter(terms, lambda t: F.contains(text, t["value"])), lambda t: t["token"])


def redact(
    paras: DataFrame,
    ws: Workspace,
    terms: DataFrame | None = None,
    attributes: DataFrame | None = None,
    links: DataFrame | None = None,
    max_terms: int | None = None,
) -> Redacted:
    """Replace supplied and discovered identifiers by tokens, count them, check leaks."""
    every = found_identifiers(paras, attributes, links)
    if terms is not None:
        every = supplied_terms(terms).unionByName(every)
    wanted = ws.keep(unique_terms(every), "terms")
    check_terms(wanted, max_terms)
    tokens = draw_tokens(wanted, ws)

    body = _with_terms(paras, tokens, "para").withColumn(
        "matches",
        F.when(F.col("terms").isNotNull(), chosen_matches(F.col("joined"), F.col("terms"))).otherwise(
            F.array().cast(f"array<{MATCH}>")
        ),
    )
    hit = F.size("matches") > 0
    new_runs = F.when(hit, rewritten_runs(F.col("runs"), F.col("joined"), F.col("matches"))).otherwise(
        F.col("runs")
    )
    stage = ws.keep(
        body.withColumn("new_runs", new_runs).select(
            *RUN_KEY,
            F.col("new_runs").alias("runs"),
            F.transform("matches", lambda m: m["token"]).alias("used"),
            F.flatten(
                F.transform("new_runs", lambda r: _leaks(r["text"], F.coalesce(F.col("terms"), F.array())))
            ).alias("leaks"),
        ),
        "redacted",
    )
    counts = stage.select("doc_id", F.explode("used").alias("token"), F.lit(1).cast("long").alias("n"))
    leaks = stage.select("doc_id", F.explode("leaks").alias("token"))
    sides = {}
    for label, df in (("attributes", attributes), ("links", links)):
        if df is None:
            sides[label] = None
            continue
        done = ws.keep(
            _attribute_pass(df, tokens).withColumn(
                "leaks", _leaks(F.col("text"), F.coalesce(F.col("terms"), F.array()))
            ).drop("terms"),
            label,
        )
        sides[label] = done.select("doc_id", "part", "ord", "text")
        counts = counts.unionByName(done.select("doc_id", F.explode("used").alias("u")).select("doc_id", "u.token", "u.n"))
        leaks = leaks.unionByName(done.select("doc_id", F.explode("leaks").alias("token")))
    total = counts.groupBy("doc_id", "token").agg(F.sum("n").alias("count"))
    replacements = ws.keep(
        tokens.join(total, ["doc_id", "token"]).select(
            "doc_id", "at", "token", F.col("value").alias("original"), "kind", "count"
        ),
        "replacements",
    )
    left = leaks.join(replacements.select("doc_id", "token"), ["doc_id", "token"], "left_semi").count()
    refuse_any("an identifier remained", {"places": left})
    runs = stage.select(*RUN_KEY, F.explode("runs").alias("r")).select(*RUN_KEY, "r.run", "r.text")
    return Redacted(runs, sides["attributes"], sides["links"], replacements, tokens)


# --- restore ---
def token_counts(texts: DataFrame) -> DataFrame:
    """``(doc_id, token, n)`` of every token in ``(doc_id, text)``. Tokens are delimited by
    brackets, so matches never overlap and equal plain substring counts."""
    hits = F.when(
        F.contains("text", F.lit(f"[{PREFIX}-")), F.regexp_extract_all("text", F.lit(TOKEN), 0)
    )
    return texts.select("doc_id", F.explode(hits).alias("token")).groupBy("doc_id", "token").agg(
        F.count(F.lit(1)).alias("n")
    )


def restore_counts(texts: DataFrame, replacements: DataFrame) -> DataFrame:
    """One row: tokens whose count differs from the record, and originals still present."""
    want = replacements.select("doc_id", "token", F.col("count").alias("want"))
    got = token_counts(texts)
    off = want.join(got, ["doc_id", "token"], "left").agg(
        F.count_if(~F.col("want").eqNullSafe(F.coalesce("n", F.lit(0)))).alias("wrong_tokens")
    )
    pairs = keyed_join(
        texts.withColumn("_spread", F.xxhash64("text")), _pairs(replacements), "doc_id", "_spread"
    )
    here = F.exists(F.coalesce("pairs", F.array()), lambda p: F.contains(F.col("text"), p["original"]))
    return off.join(F.broadcast(pairs.agg(F.count_if(here).alias("originals_present"))))


def _pairs(replacements: DataFrame) -> DataFrame:
    return replacements.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "token", "original"))).alias("pairs")
    )


def restore_texts(texts: DataFrame, replacements: DataFrame, check: bool = True) -> DataFrame:
    """Put the originals back into every row of ``(doc_id, text, …)``."""
    if check:
        refuse_any("tokens were not preserved", restore_counts(texts.select("doc_id", "text"), replacements).first().asDict())
    joined = keyed_join(texts.withColumn("_spread", F.xxhash64("text")), _pairs(replacements), "doc_id", "_spread")
    back = F.when(
        F.col("pairs").isNotNull() & F.contains("text", F.lit(f"[{PREFIX}-")),
        sequential_replace(F.col("text"), F.col("pairs"), "token", "original"),
    ).otherwise(F.col("text"))
    return joined.withColumn("text", back).drop("pairs", "_spread")


def replacement_counts(replacements: DataFrame) -> DataFrame:
    """One row of violations over a replacement record: per-document repeats and shape."""
    def repeats(column: str) -> DataFrame:
        return replacements.groupBy("doc_id", column).agg(F.count(F.lit(1)).alias("n")).agg(
            F.count_if(F.col("n") > 1).alias(f"repeated_{column}")
        )

    bad = (
        ~F.col("token").rlike(rf"^{TOKEN}\z")
        | ~F.length("original").between(TERM_MIN, TERM_MAX)
        | ~F.col("kind").isin(list(KINDS))
        | (F.col("count") < 1)
    )
    shape = replacements.agg(F.count_if(bad).alias("malformed"))
    return shape.join(F.broadcast(repeats("token"))).join(F.broadcast(repeats("original")))


def replacement_totals(replacements: DataFrame) -> DataFrame:
    """One row: replacements and their occurrences."""
    return replacements.agg(
        F.count(F.lit(1)).alias("replacements"), F.coalesce(F.sum("count"), F.lit(0)).alias("occurrences")
    )


# --- review of paragraphs and metadata ---
def numbered_paragraphs(df: DataFrame, doc: str, text: str, part: str = "body") -> DataFrame:
    """``(doc_id, part, para, text)``: the lines of a text, numbered from 1."""
    return df.select(
        F.col(doc).alias("doc_id"), F.lit(part).alias("part"),
        F.posexplode(F.split(text, "\n")).alias("i", "text"),
    ).select("doc_id", "part", (F.col("i") + 1).alias("para"), "text")


def suggestions(paras: DataFrame, limit: int | None = None, excerpt: int | None = None) -> DataFrame:
    """Paragraphs hinting at authors or institutions, found where they stand (no shuffle).

    With ``limit`` only the first so many per document; that filter is pushed below the
    shuffle. With ``excerpt`` only so many characters of each.
    """
    text = F.col("text")
    hits = paras.filter((text.rlike(AFFILIATION) | text.rlike(TITLED_NAME)) & ~X.is_blank(text))
    if limit is not None:
        order = Window.partitionBy("doc_id").orderBy("part", "para")
        hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    shown = X.strip(text)
    return hits.select(
        "doc_id",
        F.substring(X.digest(F.concat_ws(":", "part", "para")), 1, 16).alias("id"),
        "part",
        "para",
        (shown if excerpt is None else F.substring(shown, 1, excerpt)).alias("excerpt"),
    )


def remove_paragraphs(paras: DataFrame, chosen: DataFrame, offered: DataFrame) -> DataFrame:
    """``paras`` without the chosen ``(doc_id, id)`` rows, which must have been offered."""
    picked = chosen.select("doc_id", "id")
    row = picked.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).join(
        offered.select("doc_id", "id", F.lit(1).alias("ok")), ["doc_id", "id"], "left"
    ).agg(
        F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("ok").isNull()).alias("not_offered")
    ).first()
    refuse_any("paragraph selection", row.asDict())
    gone = picked.join(offered, ["doc_id", "id"]).select("doc_id", "part", "para")
    return paras.join(gone, ["doc_id", "part", "para"], "left_anti")


def metadata_fields(metadata: Column) -> Column:
    """How many author fields of a metadata map are filled."""
    return F.size(
        F.map_filter(metadata, lambda k, v: k.isin(list(AUTHOR_METADATA)) & ~X.is_blank(v))
    )


def strip_metadata(metadata: Column) -> Column:
    """A metadata map without author fields and custom properties."""
    return F.map_filter(
        metadata, lambda k, v: ~k.isin(list(AUTHOR_METADATA)) & ~F.startswith(k, F.lit("custom:"))
    )


def split_occurrences(paras: DataFrame, terms: list[str] = ()) -> DataFrame:
    """``(doc_id, split)``: documents where a term or identifier occurs more often in the
    joined paragraph than in its single runs."""

    def more(count) -> Column:
        direct = F.aggregate(
            F.transform("runs", lambda r: count(r["text"])), F.lit(0).cast("long"), lambda a, n: a + n
        )
        return count(F.col("joined")) > direct

    def matches(pattern: str):
        return lambda c: F.size(F.regexp_extract_all(c, F.lit(pattern), 0)).cast("long")

    found = more(matches(MAILBOX)) | more(matches(ORCID))
    for term in terms:
        found = found | more(lambda c, t=term: X.occurrences(c, F.lit(t)))
    many = F.size("runs") > 1
    return paras.groupBy("doc_id").agg(F.bool_or(many & found).alias("split"))


def check_review_digest(seen: str, now: str) -> None:
    refuse_if(seen != now, "the corpus changed after its review")

