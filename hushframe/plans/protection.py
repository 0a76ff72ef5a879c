"""Queries: protect transforms (D), disclosure checks (F), binding and key map (G).

Random tokens are never compared: the statements describe counts, decoded labels and
shapes, which coding cannot change because it is one-to-one.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..keymap import load_key_map, opened, save_key_map, sealed
from ..operators import binding as B
from ..operators import profile as P
from ..operators import risk as K
from ..operators.protect import (
    bad_key,
    check_schema,
    draw_entities,
    gate_counts,
    protect,
    protect_related,
    repeated_keys,
    simple_value,
)
from ..errors import Refused
from ..policy import SOURCE_LABELS, PolicyBuilder, shared_fields
from ..sources import tables as T
from ..sources.rows import ROW
from . import sql as S
from .registry import query
from .setups import LOOSE, bound_customer, customer_policy, orders_policy, protected_customer, related
from .shaping import union

BIN = "CASE WHEN c_acctbal < 0 THEN '[-1000, 0)' WHEN c_acctbal < 5000 THEN '[0, 5000)' ELSE '[5000, 10000]' END"


@query("d1_schema_gate", S.TEXT["customer"])
def schema_gate(c):
    """The rows of a table whose headings are the policy's, whatever their order, in the policy's columns."""
    df = c.text("customer")
    policy = customer_policy(df)
    turned = df.select(*[T.quoted(n) for n in reversed(T.data_columns(df))], ROW)
    check_schema(turned, policy)
    return turned.select(*[T.quoted(n) for n in policy.columns])


_KEYED = (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"), ("pages", "url"), ("lineitem", "l_shipdate"))


@query(
    "d2_key_gate",
    " UNION ALL ".join(
        f"SELECT '{t}' sheet, (SELECT count_if({S.blank('k')} OR {S.formula('k')} OR {S.control('k')}) FROM (SELECT CAST({k} AS VARCHAR) k FROM {t})) bad_keys,"
        f" (SELECT count(*) FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)) repeated_keys"
        for t, k in _KEYED
    ),
)
def key_gate(c):
    parts = []
    for t, k in _KEYED:
        df = c.text(t, [k])
        bad = df.agg(F.count_if(bad_key(F.col(k))).alias("bad_keys"))
        parts.append(bad.join(F.broadcast(repeated_keys(df, k))).withColumn("sheet", F.lit(t)))
    return union(parts)


@query(
    "d3_record_ids",
    "SELECT count(*) n_rows, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)) * 0 + count(*) distinct_ids, 0 bad_ids FROM lineitem",
)
def record_ids(c):
    """Every order line as its own record: the key is its row number."""
    df = c.kept("lineitem", ["l_returnflag"])
    keyed = df.select(F.col(ROW).cast("string").alias("line"), "l_returnflag", ROW)
    policy = PolicyBuilder().key("line").keep("l_returnflag", P.categories(keyed, "l_returnflag")).build()
    return P.id_counts(protect(keyed, policy, c.ws).table)


@query(
    "d4_dropped_values",
    "SELECT count(DISTINCT c_name) dropped_values, count(DISTINCT CASE WHEN c_name IN (SELECT c_mktsegment FROM customer) THEN c_name END) still_present FROM customer",
)
def dropped_values(c):
    source, p = protected_customer(c)
    shared = P.column_values(p.table).select("value").distinct().withColumn("hit", F.lit(1))
    names = source.select(F.col("c_name").alias("value")).distinct()
    return names.join(shared, "value", "left").agg(
        F.count(F.lit(1)).alias("dropped_values"), F.count("hit").alias("still_present")
    )


@query("d5_kept_categories", "SELECT o_orderstatus AS status, count(*) n FROM orders GROUP BY 1")
def kept_categories(c):
    _, p = related(c)
    return p.tables["orders"].groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "d6_code_shape",
    "SELECT 'c_mktsegment' AS \"column\", n FROM (SELECT count(*) n FROM customer GROUP BY c_mktsegment)"
    " UNION ALL SELECT 'c_nationkey', n FROM (SELECT count(*) n FROM customer GROUP BY c_nationkey)",
)
def code_shape(c):
    _, p = protected_customer(c)
    return P.distinct_values(p.table, ["c_mktsegment", "c_nationkey"]).select("column", "n")


@query(
    "d6_decoded_codes",
    "SELECT c_mktsegment AS label, count(*) n FROM customer GROUP BY 1 UNION ALL SELECT CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 1",
)
def decoded_codes(c):
    _, p = protected_customer(c)
    counts = P.distinct_values(p.table, ["c_mktsegment", "c_nationkey"])
    book = p.keymap.book.select(F.col("field").alias("column"), F.col("code").alias("value"), "label")
    return counts.join(book, ["column", "value"]).select("label", "n")


def large_domain(c):
    """Parts under a label of their own, more labels than a policy may list: coded as the source holds them."""
    source = c.text("part", ["p_partkey", "p_name"])
    label = F.concat_ws(" ", "p_name", "p_partkey")
    source = source.select("p_partkey", label.alias("article"), ROW)
    policy = PolicyBuilder().key("p_partkey").code("article", SOURCE_LABELS, "quasi_identifier").build()
    return source, protect(source, policy, c.ws, profile=LOOSE)


@query("d6_large_domain", "SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS label, count(*) n FROM part GROUP BY 1")
def coded_large_domain(c):
    """Every code of the shared table, put back by the codebook."""
    _, p = large_domain(c)
    book = p.keymap.book.select(F.col("code").alias("article"), "label")
    codes = p.table.groupBy("article").agg(F.count(F.lit(1)).alias("n"))
    return codes.join(book, "article").select("label", "n")


@query(
    "g5_large_codebook",
    "SELECT count(DISTINCT p_name || ' ' || CAST(p_partkey AS VARCHAR)) AS entries, count(DISTINCT p_brand) AS damaged FROM part",
)
def damaged_large_codebook(c):
    """The codebook of a large domain, where all articles of a brand were given one code: a merged code for each brand."""
    _, p = large_domain(c)
    brands = c.text("part", ["p_partkey", "p_brand"]).select(F.col("p_partkey").alias("source_key"), "p_brand")
    rows = p.stages["table"].select("source_key", F.col("article").alias("code")).join(brands, "source_key")
    least = rows.groupBy("p_brand").agg(F.min("code").alias("least"))
    book = p.keymap.book.join(rows.select("code", "p_brand"), "code").join(least, "p_brand")
    bad = replace(p.keymap, book=book.select("sheet", "field", "label", F.col("least").alias("code")))
    counts = B.book_faults(bad)
    return counts.join(F.broadcast(p.keymap.book.agg(F.count(F.lit(1)).alias("entries")))).select("entries", F.col("merged_codes").alias("damaged"))


@query(
    "d7_numeric_orders",
    f"SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, {S.canonical('CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)')} AS price FROM orders",
)
def numeric_orders(c):
    rule = PolicyBuilder().key("k").numeric("o_totalprice", 0, 1_000_000).build().columns["o_totalprice"]
    df = c.text("orders", ["o_orderkey", "o_totalprice"], places={"o_totalprice": 2})
    return df.select("o_orderkey", simple_value(rule, F.col("o_totalprice")).alias("price"))


@query(
    "d7_numeric_bounds",
    "SELECT count(*) n_rows, count_if(l_extendedprice BETWEEN 1000.5 AND 50000) in_bounds,"
    " count_if(l_extendedprice BETWEEN 1000.5 AND 50000 AND length(regexp_extract(CAST(l_extendedprice AS VARCHAR), '\\.([0-9]*)$', 1)) <= 1) one_place FROM lineitem",
)
def numeric_bounds(c):
    from decimal import Decimal

    v = F.col("l_extendedprice")
    bounds = (Decimal("1000.5"), Decimal(50000))
    return c.dealt("lineitem", ["l_extendedprice"]).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(N.canonical_numeric(v, bounds)).alias("in_bounds"),
        F.count(N.canonical_numeric(v, bounds, 1)).alias("one_place"),
    )


@query("d8_bins_acctbal", f"SELECT {BIN} AS label, count(*) n FROM customer GROUP BY 1")
def bins_acctbal(c):
    rule = PolicyBuilder().key("k").bins("c_acctbal", (-1000, 0, 5000, 10000)).build().columns["c_acctbal"]
    df = c.text("customer", ["c_acctbal"])
    return df.groupBy(simple_value(rule, F.col("c_acctbal")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "d8_many_bins",
    "WITH b AS (SELECT CAST(floor(l_extendedprice / 1000.0) AS BIGINT) b FROM lineitem)"
    " SELECT CASE WHEN b < 0 OR b > 99 THEN NULL WHEN b >= 99 THEN '[99000, 100000]' ELSE '[' || b * 1000 || ', ' || (b + 1) * 1000 || ')' END AS label,"
    " count(*) n FROM b GROUP BY 1",
)
def many_bins(c):
    edges = [1000 * i for i in range(101)]
    rule = PolicyBuilder().key("k").bins("l_extendedprice", edges).build().columns["l_extendedprice"]
    df = c.dealt("lineitem", ["l_extendedprice"])
    return df.groupBy(simple_value(rule, F.col("l_extendedprice")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "d10_entities",
    "SELECT CAST(k AS VARCHAR) source_key, count(*) n FROM (SELECT c_custkey k FROM customer UNION ALL SELECT o_custkey FROM orders) GROUP BY k",
)
def entities(c):
    keys = [
        c.text("customer", ["c_custkey"]).select(F.col("c_custkey").alias("source_key")),
        c.text("orders", ["o_custkey"]).select(F.col("o_custkey").alias("source_key")),
    ]
    return draw_entities(keys, c.ws).filter(X.is_uuid4(F.col("entity_id"))).select("source_key", "n")


@query(
    "d10_linked_rows",
    "SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, CAST(o_custkey AS VARCHAR) source_key FROM orders",
)
def linked_rows(c):
    sources, p = related(c)
    rows = p.keymap.records["orders"].join(p.keymap.entities, "entity_id")
    return rows.join(sources["orders"].select(ROW, "o_orderkey"), ROW).select("o_orderkey", "source_key")


def nation_tables(c):
    """Two tables coding the same heading, keyed by their own people."""
    a = c.text("customer", ["c_custkey", "c_nationkey"]).toDF("id", "nation", ROW)
    b = c.text("supplier", ["s_suppkey", "s_nationkey"]).toDF("id", "nation", ROW)
    policies = {n: PolicyBuilder().key("id").code("nation", P.categories(df, "nation")).build() for n, df in (("customer", a), ("supplier", b))}
    return {"customer": a, "supplier": b}, policies


@query(
    "d11_shared_codes",
    "WITH a AS (SELECT DISTINCT c_nationkey k FROM customer), b AS (SELECT DISTINCT s_nationkey k FROM supplier)"
    " SELECT true AS shared, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS entries, (SELECT count(*) FROM a JOIN b USING (k)) AS same_code"
    " UNION ALL SELECT false, (SELECT count(*) FROM a) + (SELECT count(*) FROM b), 0",
)
def shared_codes(c):
    sources, policies = nation_tables(c)
    parts = []
    for shared in (("nation",), ()):
        p = protect_related(sources, policies, c.ws, shared=shared)
        book = p.keymap.book
        per = book.groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per.agg(F.sum("n").alias("entries"), F.count_if(F.col("n") > 1).alias("same_code")).withColumn("shared", F.lit(bool(shared)))
        )
    return union(parts)


@query(
    "d12_shared_field_check",
    "SELECT CAST(k AS VARCHAR) AS label, count(*) sheets, CAST(1 AS BIGINT) codes"
    " FROM (SELECT DISTINCT c_nationkey k, 'c' t FROM customer UNION ALL SELECT DISTINCT s_nationkey, 's' FROM supplier) GROUP BY k",
)
def shared_field_check(c):
    """Labels of a heading that two policies may share: in how many tables, under how many codes."""
    sources, policies = nation_tables(c)
    p = protect_related(sources, policies, c.ws, shared=shared_fields(policies, ("nation",)))
    return p.keymap.book.groupBy("label").agg(F.countDistinct("sheet").alias("sheets"), F.countDistinct("code").alias("codes"))


@query(
    "d13_row_locator",
    "SELECT 'customer' sheet, count(*) n, 0 AS first_row, count(*) - 1 AS last_row, count(*) AS distinct_rows FROM customer"
    " UNION ALL SELECT 'orders', count(*), 0, count(*) - 1, count(*) FROM orders",
)
def row_locator(c):
    _, p = related(c)
    return union(
        [
            df.agg(
                F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row"), F.max(ROW).alias("last_row"),
                F.count_distinct(ROW).alias("distinct_rows"),
            ).withColumn("sheet", F.lit(n))
            for n, df in p.keymap.records.items()
        ]
    )


@query(
    "d_gate_violations",
    "SELECT count(*) n_rows, count_if(o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) bad_categories,"
    " count_if(NOT o_totalprice BETWEEN 0 AND 200000) bad_numbers, count_if(o_totalprice >= 300000) bad_bins FROM orders",
)
def gate_violations(c):
    """What the single gate pass counts when a policy is narrower than its source."""
    df = c.text("orders")
    wide = orders_policy(df)
    policy = replace(
        PolicyBuilder(5).key("key").code("prio", ["1-URGENT", "2-HIGH"]).numeric("price", 0, 200_000).bins("span", [0, 100_000, 300_000]).build()
    )
    assert wide.source_key == "o_custkey"
    rules = policy.columns
    stage = df.select(
        F.col("o_custkey").alias("source_key"),
        F.when(F.col("o_orderpriority").isin(list(rules["prio"].domain.values)), F.col("o_orderpriority")).alias("prio"),
        simple_value(rules["price"], F.col("o_totalprice")).alias("price"),
        simple_value(rules["span"], F.col("o_totalprice")).alias("span"),
    )
    return gate_counts(stage, policy).select(
        "n_rows", F.col("bad0").alias("bad_categories"), F.col("bad1").alias("bad_numbers"), F.col("bad2").alias("bad_bins")
    )


# --- F ---
@query(
    "f1_schema_check",
    "SELECT 'direct_identifier' AS class, 1 AS columns, count(*) n_rows FROM customer UNION ALL SELECT 'free_text', 1, count(*) FROM customer"
    " UNION ALL SELECT 'unknown', 1, count(*) FROM customer",
)
def schema_check(c):
    source, p = protected_customer(c)
    policy = p.keymap.policies["table"]
    leaked = p.stages["table"].select(*policy.output_columns, F.lit("x").alias("c_name"), F.lit("x").alias("notes"), F.lit("x").alias("extra"))
    found = K.assess(leaked, policy).findings.filter("code <> 'columns' and level = 'error'")
    rows = leaked.agg(F.count(F.lit(1)).alias("n_rows"))
    return found.select(F.col("code").alias("class"), F.col("n").cast("int").alias("columns")).join(F.broadcast(rows))


@query("f2_id_check", "SELECT count(*) n_rows, 0 bad_ids, count(*) distinct_ids FROM orders")
def id_check(c):
    _, p = related(c)
    return P.id_counts(p.tables["orders"])


@query(
    "f3_domain_check",
    f"SELECT count(*) n_rows, count_if(o_orderstatus NOT IN ('F', 'O')) v0, count(*) v1,"
    f" count_if(NOT (o_totalprice BETWEEN 0 AND 400000 AND {S.canonical('CAST(o_totalprice AS VARCHAR)')} = CAST(o_totalprice AS VARCHAR))) v2,"
    " count_if(o_orderpriority NOT IN ('[0, 1)', '[1, 2]')) v3 FROM orders",
)
def domain_check(c):
    """Raw orders held against a policy: which cells are outside the promised domains."""
    policy = (
        PolicyBuilder().key("k").keep("o_orderstatus", ["F", "O"]).code("o_custkey", ["x"])
        .numeric("o_totalprice", 0, 400_000).bins("o_orderpriority", [0, 1, 2]).build()
    )
    return K.domain_counts(c.text("orders"), policy)


_SMALL = " UNION ALL ".join(
    f"SELECT '{col}' AS \"column\", count(*) distinct_values, count_if(n < 10) small_cells, CAST(sum(n) AS BIGINT) n_rows"
    f" FROM (SELECT {expr} v, count(*) n FROM customer GROUP BY 1)"
    for col, expr in (("c_nationkey", "c_nationkey"), ("c_mktsegment", "c_mktsegment"), ("c_acctbal", BIN))
)


@query("f4_small_cells", _SMALL)
def small_cells(c):
    _, p = protected_customer(c)
    return K.cell_counts(p.table, ["c_nationkey", "c_mktsegment", "c_acctbal"], 10)


@query(
    "f4_small_cells_lineitem",
    " UNION ALL ".join(
        f"SELECT '{col}' AS \"column\", count(*) distinct_values, count_if(n < 5) small_cells, CAST(sum(n) AS BIGINT) n_rows"
        f" FROM (SELECT {col} v, count(*) n FROM lineitem GROUP BY 1)"
        for col in S.COLUMNS["lineitem"]
    ),
)
def small_cells_lineitem(c):
    df = c.dealt("lineitem")
    return K.cell_counts(df, T.data_columns(df), 5)


@query(
    "f5_high_cardinality",
    " UNION ALL ".join(
        f"SELECT '{t}' sheet, '{col}' AS \"column\", count(DISTINCT {col}) / count(*) > 0.5 AS high FROM {t}"
        for t in ("orders", "part", "events") for col in S.COLUMNS[t]
    ),
)
def high_cardinality(c):
    parts = []
    for t in ("orders", "part", "events"):
        df = c.text(t)
        counts = K.cell_counts(df, T.data_columns(df), 2)
        parts.append(counts.select(F.lit(t).alias("sheet"), "column", (F.col("distinct_values") / F.col("n_rows") > 0.5).alias("high")))
    return union(parts)


def class_sql(groups: str, source: str, k: int) -> str:
    return (
        f"SELECT CAST(sum(n) AS BIGINT) members, min(n) minimum_size, count_if(n = 1) unique_members,"
        f" CAST(coalesce(sum(CASE WHEN n < {k} THEN n END), 0) AS BIGINT) small_members, count_if(n = 1) / sum(n) unique_fraction"
        f" FROM (SELECT count(*) n FROM {source} GROUP BY {groups})"
    )


@query("f6_joint_classes", class_sql(f"c_nationkey, c_mktsegment, {BIN}", "customer", 5))
def joint_classes(c):
    _, p = protected_customer(c)
    return K.class_counts(p.table, list(p.keymap.policies["table"].retained), 5)


@query("f6_joint_classes_lineitem", class_sql("l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount", "lineitem", 5))
def joint_classes_lineitem(c):
    names = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"]
    return K.class_counts(c.dealt("lineitem", names), names, 5)


@query("f6_one_class", "SELECT count(*) members, count(*) minimum_size, 0 unique_members, 0 small_members, CAST(0 AS DOUBLE) unique_fraction FROM orders")
def one_class(c):
    return K.class_counts(c.text("orders", ["o_orderkey"]), [], 5)


_RISK = (
    f"s AS (SELECT count_if(n < 5) > 0 AS rare FROM (SELECT count(*) n FROM customer GROUP BY c_nationkey, c_mktsegment, {BIN}))"
)


@query(
    "f7_profiles",
    f"WITH {_RISK} SELECT 'strict' AS profile, NOT rare AS passed, CASE WHEN rare THEN 1 ELSE 0 END AS errors, 1 AS warnings FROM s"
    " UNION ALL SELECT 'controlled_pseudonymisation', true, 0, CASE WHEN rare THEN 2 ELSE 1 END FROM s",
)
def profiles(c):
    _, p = protected_customer(c)
    policy = p.keymap.policies["table"]
    return union([K.assess(p.table, policy, n, n).verdicts().select(F.col("sheet").alias("profile"), "passed", "errors", "warnings") for n in K.PROFILES])


_LINKED = (
    "WITH f AS (SELECT CAST(c_custkey AS BIGINT) e, ['customer', 'nation', CAST(c_nationkey AS VARCHAR)] x FROM customer"
    " UNION ALL SELECT c_custkey, ['customer', 'segment', c_mktsegment] FROM customer"
    f" UNION ALL SELECT c_custkey, ['customer', 'balance', {BIN}] FROM customer"
    " UNION ALL SELECT o_custkey, ['orders', 'status', o_orderstatus] FROM orders"
    " UNION ALL SELECT o_custkey, ['orders', 'priority', o_orderpriority] FROM orders),"
    " e AS (SELECT c_custkey e FROM customer UNION SELECT o_custkey FROM orders),"
    " p AS (SELECT e.e, list_sort(list(f.x)) fp FROM e LEFT JOIN f ON e.e = f.e GROUP BY e.e)"
)


@query(
    "f8_linked_fingerprints",
    f"{_LINKED}, s AS (SELECT count(*) n FROM p GROUP BY fp) SELECT CAST(sum(n) AS BIGINT) members, min(n) minimum_size, count_if(n = 1) unique_members,"
    " CAST(coalesce(sum(CASE WHEN n < 5 THEN n END), 0) AS BIGINT) small_members, count_if(n = 1) / sum(n) unique_fraction FROM s",
)
def linked_fingerprints(c):
    """Customers with all their orders and every retained column: how many look alike over both tables."""
    _, p = related(c)
    tables = {name: (df, list(p.keymap.policies[name].retained)) for name, df in p.tables.items()}
    return K.linked_counts(tables, p.keymap.entities, 5)


@query(
    "f8_linked_events",
    "WITH p AS (SELECT user_id, list_sort(list(event_type)) fp FROM events GROUP BY user_id), s AS (SELECT count(*) n FROM p GROUP BY fp)"
    " SELECT CAST(sum(n) AS BIGINT) members, min(n) minimum_size, count_if(n = 1) unique_members,"
    " CAST(coalesce(sum(CASE WHEN n < 5 THEN n END), 0) AS BIGINT) small_members, count_if(n = 1) / sum(n) unique_fraction FROM s",
)
def linked_events(c):
    df = c.text("events", ["user_id", "event_type"])
    return K.linked_counts({"events": (df, ["event_type"])}, df.select("user_id"), 5, entity="user_id")


@query("f9_cross_table_ids", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n_rows, 0 bad_ids, 0 repeated_ids, 0 unknown_entities, 0 bad_entities")
def cross_table_ids(c):
    _, p = related(c)
    return K.cross_table_id_counts(p.tables, p.keymap.entities)


@query(
    "f10_report",
    f"WITH cu AS (SELECT count(*) n FROM customer GROUP BY c_nationkey, c_mktsegment, {BIN}), o AS (SELECT count(*) n FROM orders GROUP BY o_orderstatus, o_orderpriority)"
    " SELECT 'customer' sheet, true passed, CAST(sum(n) AS BIGINT) n_rows, min(n) minimum_class_size, count_if(n = 1) unique_records, CAST(coalesce(sum(CASE WHEN n < 5 THEN n END), 0) AS BIGINT) small_class_records FROM cu"
    " UNION ALL SELECT 'orders', true, CAST(sum(n) AS BIGINT), min(n), count_if(n = 1), CAST(coalesce(sum(CASE WHEN n < 5 THEN n END), 0) AS BIGINT) FROM o",
)
def report(c):
    _, p = related(c)
    tables = K.assess_related(p.tables, p.keymap, LOOSE).verdicts().filter(F.col("sheet") != K.LINKED)
    return tables.select("sheet", "passed", "n_rows", "minimum_class_size", "unique_records", "small_class_records")


# --- G ---
def digest_sql(table: str, salt: str) -> str:
    columns = S.COLUMNS[table]
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[table]
    framed = " || ".join([f"length({c}) || ':' || {c}" for c in [S.q(salt), "at", *columns]])
    heads = json.dumps(columns)[1:-1]
    sums = " || '\", \"' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)), 0) AS VARCHAR)" for i in range(4))
    return (
        f"SELECT '{table}' sheet, sha256('[[{heads}], ' || count(*) || ', \"' || {sums} || '\"]') AS digest FROM (SELECT sha256({framed}) h"
        f" FROM (SELECT t.*, CAST(row_number() OVER (ORDER BY CAST({key} AS BIGINT)) - 1 AS VARCHAR) AS at FROM ({S.TEXT[table]}) t))"
    ).replace('"at"', "pos").replace(" AS at ", " AS pos ").replace(", at,", ", pos,").replace("length(at) || ':' || at", "length(pos) || ':' || pos")


@query("g1_table_digest", f"{digest_sql('customer', 's1')} UNION ALL {digest_sql('supplier', 's1')}")
def table_digest(c):
    rows = [(t, B.table_digest(c.text(t), "s1")) for t in ("customer", "supplier")]
    return c.spark.createDataFrame(rows, "sheet string, digest string")


@query(
    "g2_set_digest",
    f"WITH d AS ({digest_sql('customer', '')} UNION ALL {digest_sql('supplier', '')})"
    " SELECT sha256('[[\"customer\", \"' || (SELECT digest FROM d WHERE sheet = 'customer') || '\"], [\"supplier\", \"' || (SELECT digest FROM d WHERE sheet = 'supplier') || '\"]]') AS digest",
)
def set_digest(c):
    digests = B.table_digests({t: c.text(t) for t in ("customer", "supplier")})
    return c.spark.createDataFrame([(B.set_digest(digests),)], "digest string")


@query(
    "g3_staleness",
    "SELECT change, found AS noticed, (SELECT count(*) FROM orders) AS n_rows"
    " FROM (VALUES ('none', false), ('moved partitions', false), ('one value', true), ('order', true), ('a row', true), ('heading', true)) v(change, found)",
)
def staleness(c):
    df = c.text("orders")
    first = F.col(ROW) == 0
    last = df.agg(F.max(ROW)).first()[0]
    cases = {
        "none": df,
        "moved partitions": df.repartition(5, "o_custkey"),
        "one value": df.withColumn("o_orderstatus", F.when(first, F.lit("?")).otherwise(F.col("o_orderstatus"))),
        "order": df.withColumn(ROW, F.lit(last) - F.col(ROW)),
        "a row": df.filter(~first),
        "heading": df.withColumnRenamed("o_orderstatus", "status"),
    }
    before = B.table_digest(df)
    n = df.count()
    rows = [(name, B.table_digest(case) != before, n) for name, case in cases.items()]
    return c.spark.createDataFrame(rows, "change string, noticed boolean, n_rows long")


@query("g4_map_check", "SELECT count(*) entries, 0 bad_ids, 0 repeated_ids, 0 bad_keys, 0 repeated_keys FROM customer")
def map_check(c):
    _, p = protected_customer(c)
    return B.map_counts(p.keymap.records["table"])


@query(
    "g4_map_violations",
    "SELECT count(*) entries, count(DISTINCT o_orderkey) bad_ids, 0 repeated_ids, count(DISTINCT CASE WHEN o_orderstatus = '' THEN 1 END) bad_keys,"
    " (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) repeated_keys FROM orders",
)
def map_violations(c):
    """Orders taken for a key map: ids of the wrong shape, customers that repeat."""
    df = c.text("orders", ["o_orderkey", "o_custkey"])
    return B.map_counts(df.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("source_key")))


@query(
    "g5_codebook_check",
    "SELECT (SELECT count(DISTINCT c_mktsegment) + count(DISTINCT c_nationkey) FROM customer) AS entries, 0 bad_codes, 0 split_labels, 0 merged_codes",
)
def codebook_check(c):
    source, p = protected_customer(c)
    B.check_codebook(p.keymap)
    pairs = B.observed_codes(source, p.stages["table"], ["c_mktsegment", "c_nationkey"])
    return B.codebook_counts(pairs.select(F.lit("customer").alias("sheet"), "field", "label", "code"))


@query(
    "g5_codebook_violations",
    "WITH b AS (SELECT DISTINCT p_type l, p_brand k FROM part) SELECT count(*) entries, count(*) bad_codes,"
    " (SELECT count(*) FROM (SELECT l FROM b GROUP BY l HAVING count(*) > 1)) split_labels, (SELECT count(*) FROM (SELECT k FROM b GROUP BY k HAVING count(*) > 1)) merged_codes FROM b",
)
def codebook_violations(c):
    df = c.text("part", ["p_type", "p_brand"])
    return B.codebook_counts(
        df.select(F.lit("part").alias("sheet"), F.lit("f").alias("field"), F.col("p_type").alias("label"), F.col("p_brand").alias("code"))
    )


@query(
    "g6_related_map_check",
    "SELECT 0 repeated_ids, 0 bad_ids, 0 row_gaps, 0 unknown_entities, 0 repeated_keys, 0 bad_keys, 0 bad_entities, (SELECT count(*) FROM orders) AS n_rows",
)
def related_map_check(c):
    _, p = related(c)
    n = p.keymap.records["orders"].count()
    return B.related_map_counts(p.keymap).withColumn("n_rows", F.lit(n))


@query(
    "g4_opened_map",
    "SELECT count(*) entries, count(DISTINCT CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 70 END) bad_ids,"
    " (SELECT count(*) FROM (SELECT c_custkey % 70 FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1 HAVING count(*) > 1)) repeated_ids,"
    " CAST(count_if(c_custkey % 10 = 0) > 0 AS BIGINT) bad_keys, CAST(count_if(c_custkey % 10 = 0) > 1 AS BIGINT) repeated_keys,"
    " (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 2 = 1) missing, true AS refused FROM customer",
)
def opened_map(c):
    """A sealed map on disk with lost keys, wrong ids and lost labels: what opening it finds, and that it is refused."""
    _, p = protected_customer(c)
    key = F.col("source_key").cast("long")
    records = p.keymap.records["table"]
    damaged = records.select(
        F.when(key % 7 == 0, F.concat(F.lit("id "), (key % 70).cast("string"))).otherwise(F.col("record_id")).alias("record_id"), ROW,
        F.when(key % 10 != 0, F.col("source_key")).alias("source_key"),
    )
    odd = (F.col("field") == "c_nationkey") & (F.col("label").cast("long") % 2 == 1)
    book = p.keymap.book.withColumn("label", F.when(~odd, F.col("label")))
    path, secret = f"{c.ws.root}/private/damaged", "s" * 32
    save_key_map(c.spark, replace(p.keymap, records={"table": damaged}, book=book), path, secret)
    keymap = load_key_map(c.spark, path, secret)
    try:
        B.open_key_map(c.spark, path, secret)
        refused = False
    except Refused:
        refused = True
    lost = B.book_faults(keymap).select("missing")
    return B.map_counts(keymap.records["table"]).join(F.broadcast(lost)).withColumn("refused", F.lit(refused))


@query(
    "g6_related_map_violations",
    "WITH r AS (SELECT unnest(range((SELECT count(*) FROM orders))) r), ids AS (SELECT r % 26 i, count(*) n FROM r WHERE r % 13 = 0 GROUP BY 1)"
    " SELECT (SELECT count(*) FROM ids WHERE n > 1) repeated_ids, (SELECT count(*) FROM ids) bad_ids, 1 row_gaps,"
    " (SELECT count(DISTINCT r % 33) FROM r WHERE r % 11 = 0) unknown_entities,"
    " (SELECT count(*) FROM (SELECT k % 5 FROM (SELECT c_custkey k FROM customer UNION SELECT o_custkey FROM orders) WHERE k % 3 = 0 GROUP BY 1 HAVING count(*) > 1)) repeated_keys,"
    " 0 bad_keys, 0 bad_entities, (SELECT count(*) FROM orders) AS n_rows",
)
def related_map_violations(c):
    """A damaged map of customers and orders: ids of the wrong shape, a missing first row, unknown entities, keys that meet."""
    _, p = related(c)
    records, row = dict(p.keymap.records), F.col(ROW)
    records["orders"] = records["orders"].select(
        F.when(row % 13 == 0, F.concat(F.lit("r"), (row % 26).cast("string"))).otherwise(F.col("record_id")).alias("record_id"),
        (row + 1).alias(ROW),
        F.when(row % 11 == 0, F.concat(F.lit("gone "), (row % 33).cast("string"))).otherwise(F.col("entity_id")).alias("entity_id"),
    )
    key = F.col("source_key")
    number = key.cast("long")
    entities = p.keymap.entities.withColumn("source_key", F.when(number % 3 == 0, F.concat(F.lit("k"), (number % 5).cast("string"))).otherwise(key))
    n = records["orders"].count()
    return B.related_map_counts(replace(p.keymap, records=records, entities=entities)).withColumn("n_rows", F.lit(n))


@query(
    "g8_identity_violations",
    "SELECT count(*) source_rows, count_if(c_custkey % 9 <> 0) protected_rows, count_if(c_custkey % 9 = 0 OR c_custkey % 8 = 0) mismatches FROM customer",
)
def identity_violations(c):
    """Protected rows of which some are lost and some belong to another customer."""
    source, p = bound_customer(c)
    key = F.col("source_key").cast("long")
    stage = p.stages["table"].filter(key % 9 != 0)
    stage = stage.withColumn("source_key", F.when(key % 8 == 0, (key + 1).cast("string")).otherwise(F.col("source_key")))
    return B.identity_counts(source, stage, "c_custkey")


@query(
    "g7_sealed_map",
    "SELECT CAST(c_custkey AS VARCHAR) source_key, true AS sealed, true AS foreign_key_fails FROM customer",
)
def sealed_map(c):
    _, p = protected_customer(c)
    records = p.keymap.records["table"].select("source_key")
    key, export = "k" * 32, p.keymap.export_id
    shut = sealed(records.withColumn("clear", F.col("source_key")), ["source_key"], key, export)
    wrong = opened(shut.withColumn("wrong", F.col("source_key")), ["wrong"], "w" * 32, export)
    both = opened(wrong.withColumn("shut", F.col("source_key")), ["source_key"], key, export)
    return both.select(
        "source_key", (F.col("shut") != F.col("clear")).alias("sealed"), F.col("wrong").isNull().alias("foreign_key_fails")
    )


@query("g8_identity_check", "SELECT count(*) source_rows, count(*) protected_rows, 0 mismatches FROM customer")
def identity_check(c):
    source, p = bound_customer(c)
    return B.identity_counts(source, p.stages["table"], "c_custkey")
