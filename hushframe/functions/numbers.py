"""Exact decimal text: canonical form, bounds, bins and type shape without DOUBLE.

Numbers are compared as ``(digits before the point, integer text, fraction text)``,
which is exact at any length, unlike DECIMAL(38) or DOUBLE.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

PLAIN_NUMBER = r"^[0-9]+(?:\.[0-9]+)?\z"
MAX_NUMBER_CHARS = 64
FINITE = rf"^[{SPACE}]*[+-]?(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[{SPACE}]*\z"


def plain(number: Decimal) -> str:
    """A Decimal as digits, without an exponent."""
    text = f"{abs(number):f}"
    whole, _, fraction = text.partition(".")
    fraction = fraction.rstrip("0")
    whole = whole.lstrip("0") or "0"
    return whole + (f".{fraction}" if fraction else "")


def plain_signed(number: Decimal) -> str:
    return ("-" if number < 0 else "") + plain(number)


def _parts(text: str) -> tuple[int, str, str]:
    whole, _, fraction = text.partition(".")
    return len(whole), whole, fraction


def canonical(c: Column) -> Column:
    """Strip leading zeros (keeping one) and trailing fraction zeros of plain digits."""
    whole = F.regexp_replace(c, r"^0+(?=[0-9])", "")
    short = F.regexp_replace(whole, r"(\.[0-9]*?)0+\z", "$1")
    return F.regexp_replace(short, r"\.\z", "")


def magnitude(c: Column) -> Column:
    """Comparable struct of a canonical plain number."""
    whole = F.substring_index(c, ".", 1)
    fraction = F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", -1)).otherwise("")
    return F.struct(F.length(whole).alias("n"), whole.alias("w"), fraction.alias("f"))


def magnitude_of(number: Decimal) -> Column:
    n, whole, fraction = _parts(plain(number))
    return F.struct(F.lit(n).alias("n"), F.lit(whole).alias("w"), F.lit(fraction).alias("f"))


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated a single time per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain_canonical(c: Column) -> Column:
    """As ``canonical``, for plain digits only, by trimming."""
    short = F.ltrim(c, F.lit("0"))
    whole = F.when((short == "") | F.startswith(short, F.lit(".")), F.concat(F.lit("0"), short)).otherwise(short)
    return F.when(F.contains(c, F.lit(".")), F.rtrim(F.rtrim(whole, F.lit("0")), F.lit("."))).otherwise(whole)


def canonical_numeric(
    c: Column, bounds: tuple[Decimal, Decimal], places: int | None = None
) -> Column:
    """Canonical text of a bounded non-negative number; '' stays ''; NULL when refused.

    Numbers that a DECIMAL keeps for certain are compared as such, all others as exact text."""
    low, high = magnitude_of(bounds[0]), magnitude_of(bounds[1])
    ok = (F.length(c) <= MAX_NUMBER_CHARS) & c.rlike(PLAIN_NUMBER)
    if places is not None:
        ok = ok & ~c.rlike(rf"\.[0-9]{{{places + 1}}}")

    def inside(text: Column) -> Column:
        return once(magnitude(text), lambda size: F.when((size >= low) & (size <= high), text))

    out = F.when(c == "", F.lit(""))
    if all(_short(edge) for edge in bounds):
        least, most = (F.lit(plain_signed(edge)).cast("decimal(38,18)") for edge in bounds)
        short = F.when(c.try_cast("decimal(38,18)").between(least, most), _plain_canonical(c))
        out = out.when((F.length(c) <= _SHORT_CHARS) & ok, short)
    return out.when(ok, once(_plain_canonical(c), inside))


# A power of ten beyond this is far outside any bin, on either side; digits stop here.
_FAR_POWER = 4096


def _without_exponent(text: Column) -> Column:
    """``text`` with its exponent carried out by moving the decimal point."""
    shape = r"^([+-]?)([0-9]*)\.?([0-9]*)[eE]([+-]?[0-9]+)\z"
    sign, whole, part = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    # a power of more than nine digits doesn't fit an integer
    tail = F.regexp_extract(text, shape, 4)
    power = F.when(tail.rlike("^-"), -_FAR_POWER).otherwise(_FAR_POWER)
    power = F.coalesce(tail.try_cast("int"), power)
    power = F.least(F.greatest(power, F.lit(-_FAR_POWER)), F.lit(_FAR_POWER))
    digits, point = F.concat(whole, part), F.length(whole) + power
    n = F.length(digits)
    moved = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )
    return F.when(text.rlike(shape), F.concat(sign, moved))


def _plain_signed(c: Column) -> Column:
    """(negative?, comparable size) of a finite decimal text, each step evaluated once.

    Both plain and exponent forms stay exact: the decimal point is moved in the text.
    """

    def parts(expanded: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(expanded, r"^[+-]", ""), r"^\.", "0.")
        size = canonical(F.regexp_replace(digits, r"\.\z", ""))
        negative = F.startswith(expanded, F.lit("-"))
        return once(size, lambda z: F.struct((negative & (z != "0")).alias("negative"), magnitude(z).alias("size")))

    expanded = once(F.regexp_replace(c, rf"[{SPACE}_]", ""), lambda t: F.when(t.rlike("[eE]"), _without_exponent(t)).otherwise(t))
    return once(expanded, parts)


def _at_least(number: Column, bound: Decimal) -> Column:
    """Whether a ``(negative, size)`` struct is at or above a bound."""
    negative, size, limit = number["negative"], number["size"], magnitude_of(bound)
    if bound > 0:
        return ~negative & (size >= limit)
    return ~negative if bound == 0 else ~negative | (size <= limit)


def _bin_tree(number: Column, bins, labels) -> Column:
    """Binary search over contiguous bins, for a number inside their whole span."""
    if len(bins) == 1:
        return F.lit(labels[0])
    half = len(bins) // 2
    return F.when(
        _at_least(number, bins[half][0]), _bin_tree(number, bins[half:], labels[half:])
    ).otherwise(_bin_tree(number, bins[:half], labels[:half]))


# What a DECIMAL(38,18) keeps exactly.
_SHORT_NUMBER = r"^-?[0-9]{1,20}(?:\.[0-9]{1,18})?\z"
_SHORT_PLACES = 18
# Plain digits of so many characters are always kept.
_SHORT_CHARS = 20


def _short(bound: Decimal) -> bool:
    return abs(bound) < 10**20 and bound == round(bound, _SHORT_PLACES)


def _short_label(number: Column, bins, labels) -> Column:
    """As ``bin_label``, for a DECIMAL(38,18)."""

    def at_least(bound: Decimal) -> Column:
        return number >= F.lit(plain_signed(bound)).cast("decimal(38,18)")

    def tree(bins, labels) -> Column:
        if len(bins) == 1:
            return F.lit(labels[0])
        half = len(bins) // 2
        return F.when(at_least(bins[half][0]), tree(bins[half:], labels[half:])).otherwise(tree(bins[:half], labels[:half]))

    top = F.lit(plain_signed(bins[-1][1])).cast("decimal(38,18)")
    return F.when(at_least(bins[0][0]) & (number <= top), tree(bins, labels))


def bin_label(c: Column, bins: tuple[tuple[Decimal, Decimal], ...], labels: tuple[str, ...]) -> Column:
    """Label of the half-open bin holding the number (last bin closed); NULL when none.

    Plain numbers that a DECIMAL keeps are compared as such, all others as exact text."""
    if not all(_short(edge) for pair in bins for edge in pair):
        return _long_label(c, bins, labels)
    short = once(c.try_cast("decimal(38,18)"), lambda number: _short_label(number, bins, labels))
    return F.when(c.rlike(_SHORT_NUMBER), short).otherwise(_long_label(c, bins, labels))


def _long_label(c: Column, bins: tuple[tuple[Decimal, Decimal], ...], labels: tuple[str, ...]) -> Column:
    bottom, top = bins[0][0], bins[-1][1]

    def label(number: Column) -> Column:
        at_top = (number["size"] == magnitude_of(top)) & (number["negative"] == F.lit(top < 0))
        inside = _at_least(number, bottom) & (~_at_least(number, top) | at_top)
        return F.when(inside, _bin_tree(number, bins, labels))

    return F.when(c.rlike(FINITE), once(_plain_signed(c), label))


def finite_number(c: Column) -> Column:
    return c.rlike(FINITE)


def integral_number(c: Column) -> Column:
    """Whether a finite decimal text has no fractional part (``1.50e1`` has none)."""
    text = F.regexp_replace(c, rf"[{SPACE}_+]", "")
    mantissa = F.regexp_extract(text, r"^-?([0-9]*\.?[0-9]*)", 1)
    power = F.coalesce(
        F.regexp_extract(F.regexp_replace(c, rf"[{SPACE}_]", ""), r"[eE]([+-]?[0-9]+)\z", 1)
        .try_cast("long"),
        F.lit(0),
    )
    fraction = F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, r"0+\z", ""))
    return (zeros == F.length(digits)) | (F.length(fraction) - power - zeros <= 0)


def number_type(present: Column, finite: Column, integral: Column) -> Column:
    """Type from three aggregate counts."""
    return (
        F.when(present == 0, "empty")
        .when(finite < present, "text")
        .when(integral == present, "integer")
        .otherwise("decimal")
    )


def double_text(c: Column) -> Column:
    """Shortest decimal text of a DOUBLE, with at least one fraction digit and an
    exponent only outside 1e-4..1e16 (``1.0``, ``12345678.5``, ``1e+16``).

    What most numbers need is a short piece of generated code; the rest of the rule stays out of it, for the code of a
    table with several such columns would be too long for the JVM to compile."""
    size = F.abs(c)
    short = (size == 0) | ((size >= 1e-3) & (size < 1e7))
    return F.when(short, c.cast("string")).otherwise(once(c, _long_double_text))


def _long_double_text(c: Column) -> Column:
    size = F.abs(c)
    digits = F.regexp_replace(c.cast("decimal(38,22)").cast("string"), r"(\.[0-9]+?)0+\z", "$1")
    java = c.cast("string")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0\z", "")
    power = F.substring_index(java, "E", -1).try_cast("int")
    exponent = F.concat(
        F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-4) & (size < 1e16), digits)
        .otherwise(F.concat(mantissa, exponent))
    )


def survives_double(c: Column) -> Column:
    """Whether plain number text keeps its value through a DOUBLE cell (15 digits)."""
    digits = F.regexp_replace(F.replace(c, F.lit("."), F.lit("")), r"^0+|0+\z", "")
    back = double_text(c.try_cast("double"))
    same = canonical(F.regexp_replace(back, r"\.0\z", "")) == canonical(c)
    return (c == "") | ((F.length(digits) <= 15) & same)
