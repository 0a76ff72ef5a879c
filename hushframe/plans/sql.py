"""SQL spellings of the cell rules, for the statements beside the queries.

The engine that runs them has no look-around, so the rules are written differently here
than in ``functions.text``: an independent second reading of the same rules.
"""

from __future__ import annotations

SP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"\p{L}\p{N}_"
EMAIL = rf"[^{SP}@]+@[^{SP}@]+\.[^{SP}@]+"
DATE = (
    rf"(^|[^{W}])(\p{{Nd}}{{4}}[-/]\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{1,2}}"
    rf"|\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{2,4}})($|[^{W}])"
)
TIME = rf"(^|[^{W}])\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}(:\p{{Nd}}{{2}}(\.\p{{Nd}}+)?)?($|[^{W}])"
DIGITS = r"(\p{Nd}[ ()+.\-]*){7,}"
MAILBOX = rf"(?:^|[^{W}.+\-])([{W}.+\-]+@[{W}.\-]+\.[A-Za-z]{{2,}})(?:$|[^{W}.\-])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def blank(c: str) -> str:
    return f"(NOT {matches(c, f'[^{SP}]')})"


def control(c: str) -> str:
    return matches(c, r"[\x00-\x1f\x7f]")


def unsafe_control(c: str) -> str:
    return matches(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def formula(c: str) -> str:
    return matches(c, rf"^[{SP}]*[=+@\-]")


def identifier(c: str) -> str:
    return (
        f"({matches(c, EMAIL)} OR {matches(c, DATE)} OR {matches(c, TIME)}"
        f" OR regexp_full_match({c}, {q(DIGITS)}))"
    )


def free_text(c: str) -> str:
    return (
        f"(length({c}) > 64 OR len(list_filter(regexp_split_to_array({c}, {q(f'[{SP}]+')}), lambda w: w <> '')) > 4)"
    )


def safe(c: str) -> str:
    return (
        f"({c} <> '' AND NOT {matches(c, f'^[{SP}]')} AND NOT {matches(c, f'[{SP}]$')}"
        f" AND NOT {formula(c)} AND NOT {control(c)} AND NOT {identifier(c)} AND NOT {free_text(c)})"
    )


def text_issue(c: str) -> str:
    return (
        f"(length({c}) > 4096 OR ({c} <> '' AND {blank(c)}) OR {formula(c)} OR {unsafe_control(c)}"
        f" OR {matches(c, EMAIL)} OR {matches(c, DATE)} OR {matches(c, TIME)} OR {matches(c, DIGITS)})"
    )


def heading_class(c: str) -> str:
    words = (
        f"regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), {q(f'[^{W}]+')}, '_', 'g')"
    )
    direct = (
        r"(?i)(^|_)(name|email|phone|address|username|dob|identifier)(_|$)"
        r"|(^|_)(student|person|university|account)_(id|number)(_|$)"
    )
    verb = (
        r"(?i)(^|_)address_((?:(?:the|your|my|our|their|these|those|any)_)?(?:learning|development|research"
        r"|training|support|needs?|challenges?|issues?|concerns?|gaps?|problems?)(_|$))"
    )
    narrative = r"(?i)(^|_)(notes?|comments?|description|feedback|text)(_|$)"
    quasi = r"(?i)campus|subject|course|year|gpa|postcode|birth|date|gender"
    without = f"regexp_replace({words}, {q(verb)}, '\\1\\2', 'g')"
    return (
        f"CASE WHEN {matches(without, direct)} THEN 'direct_identifier'"
        f" WHEN {matches(words, narrative)} OR {matches(words, verb)} THEN 'free_text'"
        f" WHEN {matches(words, quasi)} THEN 'quasi_identifier' ELSE 'unknown' END"
    )


def iso(c: str) -> str:
    """Timestamp as ISO text, microseconds only when present."""
    return (
        f"CASE WHEN {c} IS NULL THEN '' WHEN microsecond({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S')"
        f" ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def txt(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


def canonical(c: str) -> str:
    """Canonical text of plain digits."""
    trimmed = f"regexp_replace({c}, '^0+([0-9])', '\\1')"
    return f"regexp_replace(regexp_replace({trimmed}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


# The text forms of the given tables, as common table expressions.
TEXT = {
    "customer": "SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, CAST(c_nationkey AS VARCHAR) c_nationkey,"
    " CAST(c_acctbal AS VARCHAR) c_acctbal, c_mktsegment FROM customer",
    "orders": "SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, CAST(o_custkey AS VARCHAR) o_custkey, o_orderstatus,"
    f" CAST(o_totalprice AS VARCHAR) o_totalprice, {iso('o_orderdate')} o_orderdate, o_orderpriority FROM orders",
    "lineitem": "SELECT CAST(l_orderkey AS VARCHAR) l_orderkey, CAST(l_partkey AS VARCHAR) l_partkey,"
    " CAST(l_suppkey AS VARCHAR) l_suppkey, CAST(l_linenumber AS VARCHAR) l_linenumber,"
    " CAST(l_quantity AS VARCHAR) l_quantity, CAST(l_extendedprice AS VARCHAR) l_extendedprice,"
    " CAST(l_discount AS VARCHAR) l_discount, CAST(l_tax AS VARCHAR) l_tax, l_returnflag, l_linestatus,"
    f" {iso('l_shipdate')} l_shipdate FROM lineitem",
    "supplier": "SELECT CAST(s_suppkey AS VARCHAR) s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) s_nationkey,"
    " CAST(s_acctbal AS VARCHAR) s_acctbal FROM supplier",
    "part": "SELECT CAST(p_partkey AS VARCHAR) p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) p_size,"
    " CAST(p_retailprice AS VARCHAR) p_retailprice FROM part",
    "documents": "SELECT CAST(doc_id AS VARCHAR) doc_id, text, lang, source, CAST(n_chars AS VARCHAR) n_chars FROM documents",
    "events": f"SELECT CAST(event_id AS VARCHAR) event_id, {iso('ts')} ts, CAST(user_id AS VARCHAR) user_id, event_type,"
    " CAST(\"value\" AS VARCHAR) \"value\", coalesce(props, '') props FROM events",
}
COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def long_form(*tables: str) -> str:
    """``(sheet, col, v)`` of every cell of the given tables."""
    return " UNION ALL ".join(
        f"SELECT '{t}' sheet, '{c}' col, \"{c}\" v FROM ({TEXT[t]})" for t in tables for c in COLUMNS[t]
    )
