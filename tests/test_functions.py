"""Column predicates against plain Python definitions of the same rules."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hushframe.functions import ids
from hushframe.functions import numbers as N
from hushframe.functions import spans as S
from hushframe.functions import text as X

VALUES = [
    "", " ", "\x1c", "　x", "ok", "two words", "a b c d", "a b c d e", " a", "a ", "=1", " \t+1", "-x", "@x",
    "tab\there", "line\nfeed", "del\x7f", "nul\x00", "a@b.co", "x a@b", "@b.c", "a@b.c@d.e", "2024-01-02", "1/2/24",
    "x2024-01-02", "2024-01-021", "14:30", "4:30:11.5", "1:2", "0412345678", "0412 345 678", "04123456 ext", "123456",
    "١٢٣٤٥٦٧", "x" * 64, "x" * 65, "x" * 4097, "Straße", "\U0001f9ea 14:30",
    "a@@b.c", "pre 2024-1-2,post", "1-2-2024", "(02) 1234 5678", "é14:30", "_14:30", "14:30:99", "a.b@c", "x" * 3000 + "@y.z",
]


def py_safe(v):
    email = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+")
    date = re.compile(r"\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b")
    time = re.compile(r"\b\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\b")
    digits = re.compile(r"(?:\d[ ()+.-]*){7,}")
    control = any(ord(c) < 32 or ord(c) == 127 for c in v)
    formula = v.lstrip().startswith(("=", "+", "-", "@")) or control
    ident = bool(email.search(v) or date.search(v) or time.search(v) or digits.fullmatch(v))
    free = len(v) > 64 or len(v.split()) > 4
    return {
        "control": control, "formula": formula, "ident": ident, "free": free,
        "safe": bool(v) and v == v.strip() and not formula and not ident and not free,
        "blank": not v.strip(), "strip": v.strip(),
        "email": [m.span() for m in email.finditer(v)], "date": [m.span() for m in date.finditer(v)],
        "time": [m.span() for m in time.finditer(v)], "digits": [m.span() for m in digits.finditer(v)],
    }


def test_predicates_and_spans_match_python(spark):
    v = F.col("v")

    def spans(pattern):
        return S.pattern_spans(v, pattern, "x")

    df = spark.createDataFrame([(x,) for x in VALUES], "v string").select(
        "v", X.has_control(v).alias("control"), X.formula_or_control(v).alias("formula"),
        X.identifier_shaped(v).alias("ident"), X.free_text_shaped(v).alias("free"),
        X.safe_category(v).alias("safe"), X.is_blank(v).alias("blank"), X.strip(v).alias("strip"),
        spans(X.EMAIL).alias("email"), spans(X.DATE).alias("date"), spans(X.TIME).alias("time"),
        spans(X.LONG_DIGITS).alias("digits"),
    )
    for row in df.collect():
        want = py_safe(row.v)
        for name, value in want.items():
            got = row[name]
            if isinstance(value, list):
                got = [(s.start, s.end) for s in got]
            assert got == value, (row.v[:40], name, got, value)


def test_issue_codes_and_utf16(spark):
    cases = {
        "write a@b.co": ["email"], "on 2026-01-01": ["date", "long_digits"], "at 14:30": ["time"], "call 0412345678": ["long_digits"],
        "=x": ["formula_prefix"], "  ": ["whitespace_only"], "a\x7f": ["control_character"], "x" * 4097: ["too_long"],
        "fine\n\ttext": [], "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.i for r in df.select("v", X.text_issues(F.col("v")).alias("i")).collect()}
    assert got == cases
    astral = spark.createDataFrame([("\U0001f9ea a@b.co, 14:30",)], "v string")
    row = astral.select(S.utf16_spans(F.col("v"), S.issue_spans(F.col("v"))).alias("s")).first().s
    assert [tuple(x) for x in row] == [("email", 3, 9), ("time", 11, 16)]
    many = spark.createDataFrame([("14:30 " * 200,)], "v string")
    assert len(many.select(S.utf16_spans(F.col("v"), S.issue_spans(F.col("v")))).first()[0]) == 200


@pytest.mark.parametrize(
    "value, want",
    [("", ""), ("04.20", "4.2"), ("007", "7"), ("0", "0"), ("0.0", "0"), ("7.000", "7"), ("4.123456789", "4.123456789"),
     (" ", None), ("NaN", None), ("Infinity", None), ("-1", None), ("7.1", None), ("x", None), ("4e0", None), ("+4.2", None),
     ("7.00000000000000000000000000000000000000000001", None), ("0" * 65, None), ("4.", None), (".5", None), ("4.2\n", None)],
)
def test_canonical_numeric(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(N.canonical_numeric(F.col("v"), (Decimal(0), Decimal(7)))).first()[0] == want


def test_places_and_bins(spark):
    df = spark.createDataFrame([("4.123",), ("4.12",)], "v string")
    got = [r[0] for r in df.select(N.canonical_numeric(F.col("v"), (Decimal(0), Decimal(7)), 2)).collect()]
    assert got == [None, "4.12"]
    bins = tuple((Decimal(a), Decimal(b)) for a, b in [(0, 4), (4, 5), (5, 6), (6, 7)])
    labels = ("[0, 4)", "[4, 5)", "[5, 6)", "[6, 7]")
    want = {"0": 0, "4": 1, "5": 2, "6": 3, "7": 3, "3.9999999999999999999999999": 0, "4e0": 1, " 5 ": 2, "+6.5": 3, "-0": 0,
            "7.0000000000000000000001": None, "-1": None, "": None, "NaN": None, "abc": None}
    df = spark.createDataFrame([(k,) for k in want], "v string")
    got = {r.v: r.b for r in df.select("v", N.bin_label(F.col("v"), bins, labels).alias("b")).collect()}
    assert got == {k: None if i is None else labels[i] for k, i in want.items()}


def test_number_shape_matches_decimal(spark):
    values = ["1", "1.0", "1.5", "1e3", "1.5e1", "1.55e1", "100e-2", "105e-2", "-3", "+0.0", "0e-5", "1_000", " 7 ", "x", "1.", ".5"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", N.finite_number(F.col("v")).alias("f"), N.integral_number(F.col("v")).alias("i")).collect():
        try:
            d = Decimal(r.v)
        except ArithmeticError:
            assert not r.f
            continue
        assert r.f and r.i == (d == d.to_integral_value()), r.v


@pytest.mark.parametrize("v", [0.1, 1.0, 1e7, 12345678.5, 1e16, 1.5e-5, 0.00012, -3.25, 1e22, 123456789012345.67, 0.0])
def test_double_text_is_shortest_repr(spark, v):
    assert spark.createDataFrame([(v,)], "v double").select(N.double_text(F.col("v"))).first()[0] == repr(v)


def test_random_ids_and_folding(spark):
    rows = spark.range(1000).select(ids.random_id(F.col("id")).alias("u"), ids.random_hex8(F.col("id")).alias("h"))
    got = rows.collect()
    assert len({r.u for r in got}) == 1000 and all(re.fullmatch("[0-9A-F]{8}", r.h) for r in got)
    bad = spark.createDataFrame([(r.u,) for r in got], "u string").filter(~X.is_uuid4(F.col("u")))
    assert bad.isEmpty()
    df = spark.createDataFrame([("Straße",)], "v string")
    assert df.select(ids.casefold("v").alias("f")).first().f == "strasse"


def test_bins_of_short_and_long_numbers_agree(spark):
    edges = [Decimal(e) for e in ("-10", "-0.5", "0", "1.25", "100")]
    bins, labels = tuple(zip(edges, edges[1:])), ("a", "b", "c", "d")
    values = ["-10", "-10.0", "-10.000000000000000001", "-0.5", "-0.50", "-0.500000000000000000001", "-0", "0", "00.0", "1.25", "1.249999999999999999",
              "1.2499999999999999999999", "100", "100.00", "100.000000000000000001", "1e2", "12_5e-2", ".5", "+7", "7.", "99999999999999999999", "x", "", " 3 "]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    rows = df.select("v", N.bin_label(F.col("v"), bins, labels).alias("short"), N._long_label(F.col("v"), bins, labels).alias("long")).collect()
    for r in rows:
        try:
            number = Decimal((r.v or "x").strip().replace("_", ""))
        except ArithmeticError:
            number = None
        want = None
        if number is not None and edges[0] <= number <= edges[-1]:
            want = next((x for (_, high), x in zip(bins, labels) if number < high), labels[-1])
        assert r.short == r.long == want, r
