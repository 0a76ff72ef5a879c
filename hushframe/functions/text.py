"""Cell predicates and string helpers as Columns: everything here stays in codegen.

Python's and Java's character classes differ, so the classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: these patterns and limits decide results and are part of the rules ---
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
MAX_FIELD = 4096
MAX_CATEGORY = 64
MAX_CATEGORY_WORDS = 4
# The look-behind and the possessive quantifiers change no match; they keep the search
# linear on long runs without spaces and free of deep recursion on long digit runs.
EMAIL = rf"(?<![^{SPACE}@])[^{SPACE}@]++@[^{SPACE}@]+\.[^{SPACE}@]+"
DATE = (
    rf"(?=\p{{Nd}})(?<![{WORD}])(?:\p{{Nd}}{{4}}[-/]\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{1,2}}"
    rf"|\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{2,4}})(?![{WORD}])"
)
TIME = (
    rf"(?=\p{{Nd}})(?<![{WORD}])\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}(?::\p{{Nd}}{{2}}(?:\.\p{{Nd}}+)?)?(?![{WORD}])"
)
LONG_DIGITS = r"(?:\p{Nd}[ ()+.\-]*+){7,}+"
PRECISE = r"\.\p{Nd}{3,}"
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
UUID_SHAPE = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
SHA256_HEX = r"^[0-9a-f]{64}\z"
# Heading words that mark a column as identifying, narrative or quasi-identifying.
DIRECT_WORDS = (
    r"(?iu)(^|_)(name|email|phone|address|username|dob|identifier)(_|\z)"
    r"|(^|_)(student|person|university|account)_(id|number)(_|\z)"
)
NARRATIVE_WORDS = r"(?iu)(^|_)(notes?|comments?|description|feedback|text)(_|\z)"
ADDRESS_VERB = (
    r"(?iu)(^|_)address_(?=(?:(?:the|your|my|our|their|these|those|any)_)?"
    r"(?:learning|development|research|training|support|needs?|challenges?|issues?"
    r"|concerns?|gaps?|problems?)(_|\z))"
)
QUASI_WORDS = r"(?iu)campus|subject|course|year|gpa|postcode|birth|date|gender"
# --- end of fixed values ---


def strip(c: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.regexp_replace(c, rf"^[{SPACE}]++|[{SPACE}]++\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{SPACE}]")


def has_control(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1f\x7f]")


def has_unsafe_control(c: Column) -> Column:
    """As :func:`has_control`, but tab, line feed and carriage return are fine."""
    return c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def formula_prefix(c: Column) -> Column:
    return c.rlike(rf"^[{SPACE}]*+[=+\-@]")


def formula_or_control(c: Column) -> Column:
    return c.rlike(rf"^[{SPACE}]*+[=+\-@]|[\x00-\x1f\x7f]")


# Each search is behind a cheap test for a character it cannot do without.
def email_in(c: Column) -> Column:
    return F.contains(c, F.lit("@")) & c.rlike(EMAIL)


def date_in(c: Column) -> Column:
    return (F.contains(c, F.lit("-")) | F.contains(c, F.lit("/"))) & c.rlike(DATE)


def time_in(c: Column) -> Column:
    return F.contains(c, F.lit(":")) & c.rlike(TIME)


def identifier_shaped(c: Column) -> Column:
    return email_in(c) | date_in(c) | time_in(c) | c.rlike(rf"^{LONG_DIGITS}\z")


def free_text_shaped(c: Column) -> Column:
    more_words = rf"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{MAX_CATEGORY_WORDS}}}[^{SPACE}]"
    return (F.length(c) > MAX_CATEGORY) | c.rlike(more_words)


def safe_category(c: Column) -> Column:
    return (
        (c != "")
        & ~free_text_shaped(c)
        & ~c.rlike(rf"^[{SPACE}]|[{SPACE}]\z")
        & ~formula_or_control(c)
        & ~identifier_shaped(c)
    )


def is_uuid4(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID4), F.lit(False))


def is_uuid_shaped(c: Column) -> Column:
    return c.rlike(UUID_SHAPE)


def valid_heading(c: Column) -> Column:
    return ~is_blank(c) & (F.length(c) <= MAX_FIELD) & ~has_unsafe_control(c)


def heading_class(c: Column) -> Column:
    """Advisory class of a heading, from its words."""
    words = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", "_")
    words = F.regexp_replace(words, rf"[^{WORD}]++", "_")
    return (
        F.when(F.regexp_replace(words, ADDRESS_VERB, "$1").rlike(DIRECT_WORDS), "direct_identifier")
        .when(words.rlike(NARRATIVE_WORDS) | words.rlike(ADDRESS_VERB), "free_text")
        .when(words.rlike(QUASI_WORDS), "quasi_identifier")
        .otherwise("unknown")
    )


def quote_literal(c: Column) -> Column:
    """A regex that matches exactly the text of ``c``."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, needle: Column) -> Column:
    """How often the literal ``needle`` occurs, left to right without overlap."""
    return (
        (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)
    ).cast("long")


def digest(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


# Issue codes of a reviewed text, in reporting order.
def text_issues(c: Column) -> Column:
    def code(name: str, hit: Column) -> Column:
        return F.when(hit, F.lit(name))

    return F.array_compact(
        F.array(
            code("too_long", F.length(c) > MAX_FIELD),
            code("whitespace_only", (c != "") & is_blank(c)),
            code("formula_prefix", formula_prefix(c)),
            code("control_character", has_unsafe_control(c)),
            code("email", email_in(c)),
            code("date", date_in(c)),
            code("time", time_in(c)),
            code("long_digits", c.rlike(LONG_DIGITS)),
        )
    )


def has_text_issue(c: Column) -> Column:
    return (
        (F.length(c) > MAX_FIELD)
        | ((c != "") & is_blank(c))
        | formula_prefix(c)
        | has_unsafe_control(c)
        | email_in(c)
        | date_in(c)
        | time_in(c)
        | c.rlike(LONG_DIGITS)
    )
