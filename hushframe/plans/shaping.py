"""Queries: sources, shaping and sinks (A), profiles (B), policies (C)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import binding as B
from ..operators import profile as P
from ..operators.protect import protect, simple_value
from ..policy import PolicyBuilder, PolicyError, parse_policy, policy_dict
from ..sinks.publish import publish, write_table
from ..sources import regions as G
from ..sources import tables as T
from ..sources.rows import ROW
from . import sql as S
from .registry import query
from .setups import LOOSE, customer_policy


def union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("a1_text_scan_orders", S.TEXT["orders"])
def text_scan_orders(c):
    return c.text("orders").drop(ROW)


@query("a1_text_scan_events", S.TEXT["events"])
def text_scan_events(c):
    return c.text("events").drop(ROW)


@query(
    "a2_append_tables",
    "SELECT CAST(c_nationkey AS VARCHAR) nation, CAST(c_acctbal AS VARCHAR) balance, c_custkey AS row_number FROM customer"
    " UNION ALL SELECT CAST(s_nationkey AS VARCHAR), CAST(s_acctbal AS VARCHAR),"
    " s_suppkey + (SELECT count(*) FROM customer) FROM supplier",
)
def append_tables(c):
    a = c.text("customer", ["c_nationkey", "c_acctbal"]).toDF("nation", "balance", ROW)
    b = c.text("supplier", ["s_acctbal", "s_nationkey"]).toDF("balance", "nation", ROW)
    return T.append_tables([a, b], allow_reordered=True).withColumnRenamed(ROW, "row_number")


@query(
    "a3_related_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' sheet, {len(S.COLUMNS[t])} n_columns, count(*) n_rows, count(*) - 1 last_row,"
        f" sum(length(concat({', '.join(S.COLUMNS[t])}))) n_chars FROM ({S.TEXT[t]})"
        for t in ("customer", "orders", "lineitem")
    ),
)
def related_tables(c):
    tables = T.load_related(
        c.spark, {n: f"{c.folder}/{n}.parquet" for n in ("customer", "orders", "lineitem")}, c.ws
    )
    return union(
        [
            df.agg(
                F.lit(len(T.data_columns(df))).alias("n_columns"),
                F.count(F.lit(1)).alias("n_rows"),
                F.max(ROW).alias("last_row"),
                F.sum(F.length(F.concat(*T.data_columns(df)))).alias("n_chars"),
            ).withColumn("sheet", F.lit(n))
            for n, df in tables.items()
        ]
    )


@query(
    "a4_heading_check",
    f"SELECT lang, count(*) headings, count_if(NOT {S.blank('text')} AND length(text) <= 4096"
    f" AND NOT {S.unsafe_control('text')}) valid FROM documents GROUP BY lang",
)
def heading_check(c):
    return c.text("documents", ["lang", "text"]).groupBy("lang").agg(
        F.count(F.lit(1)).alias("headings"), F.count_if(X.valid_heading(F.col("text"))).alias("valid")
    )


@query(
    "a5_row_shape",
    " UNION ALL ".join(
        f"SELECT '{t}' sheet, count(*) n_rows, count_if({' AND '.join(f'{c} = {S.q('')}' for c in cols)}) blank_rows,"
        f" count_if({' OR '.join(f'length({c}) > 4096' for c in cols)}) bad_field_rows FROM ({src})"
        for t, cols, src in (
            ("documents", ["doc_id", "text", "lang"], S.TEXT["documents"]),
            ("lineitem", S.COLUMNS["lineitem"], S.TEXT["lineitem"]),
            ("pages", ["page_id", "url", "html"], "SELECT CAST(page_id AS VARCHAR) page_id, url, html FROM pages"),
        )
    ),
)
def row_shape(c):
    wanted = {"documents": ["doc_id", "text", "lang"], "lineitem": None, "pages": None}
    return union(
        [T.row_shape_counts(c.text(n, cols)).withColumn("sheet", F.lit(n)) for n, cols in wanted.items()]
    )


@query(
    "a6_conversion_counters",
    " UNION ALL ".join(
        f"SELECT '{t}' sheet, count(*) n_rows, count({d}) date_cells FROM {t}"
        for t, d in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
    )
    + " UNION ALL SELECT 'part', count(*), 0 FROM part",
)
def conversion_counters(c):
    return union(
        [
            T.conversion_counters(c.raw(t)).withColumn("sheet", F.lit(t))
            for t in ("orders", "lineitem", "events", "part")
        ]
    )


@query(
    "a6_cell_counters",
    "SELECT count_if(event_type = 'view') date_cells, count_if(event_type <> 'view' AND value >= 5) formula_cells,"
    " count_if(event_type <> 'view' AND NOT value >= 5) unsaved_formulas FROM events",
)
def cell_counters(c):
    e = c.raw("events")
    return T.cell_counters(
        e.select(
            F.when(F.col("event_type") == "view", "date").otherwise("formula").alias("kind"),
            F.when(F.col("value") >= 5, F.col("value").cast("string")).alias("text"),
        )
    )


def grid(c):
    """A sparse grid of the given data: one sheet per supplier, a row per order number."""
    return c.raw("lineitem").select(
        F.col("l_returnflag").alias("book"),
        F.col("l_suppkey").alias("sheet"),
        (F.col("l_orderkey") + 1).alias("row"),
        F.col("l_linenumber").cast("long").alias("col"),
        F.lit("text").alias("kind"),
        F.col("l_shipdate").cast("string").alias("text"),
    )


def declared(c):
    """Declared tables on those sheets: one rectangle per supplier and return flag."""
    s = c.raw("supplier")
    flags = c.raw("lineitem").select(F.col("l_returnflag").alias("book")).distinct()
    return s.join(F.broadcast(flags)).select(
        "book",
        F.col("s_suppkey").alias("sheet"),
        F.lit(1).cast("long").alias("left"),
        (F.col("s_suppkey") * 20 + 1).alias("top"),
        F.lit(4).cast("long").alias("right"),
        (F.col("s_suppkey") * 20 + 900).alias("bottom"),
    )


_GRID = "grid AS (SELECT l_returnflag book, l_suppkey sheet, l_orderkey + 1 r, l_linenumber c FROM lineitem)"
_ISLANDS = (
    "rows AS (SELECT book, sheet, r, min(c) lo, max(c) hi FROM {src} GROUP BY book, sheet, r),"
    " marked AS (SELECT *, r - row_number() OVER (PARTITION BY book, sheet ORDER BY r) g FROM rows),"
    " found AS (SELECT book, sheet, min(lo) AS l, min(r) AS t, max(hi) AS ri, max(r) AS b FROM marked"
    " GROUP BY book, sheet, g HAVING min(r) < max(r) AND min(lo) < max(hi))"
)
_AREA = "chr(CAST(64 + {0} AS INTEGER)) || {1} || ':' || chr(CAST(64 + {2} AS INTEGER)) || {3}"


@query(
    "a7_regions",
    f"WITH {_GRID}, {_ISLANDS.format(src='grid')} SELECT book, sheet, l AS \"left\", t AS top, ri AS \"right\", b AS bottom,"
    f" {_AREA.format('l', 't', 'ri', 'b')} AS range, t AS header_row, 'plain_range' kind FROM found",
)
def regions(c):
    return G.discover_regions(grid(c))


@query(
    "a7_regions_beside_tables",
    f"WITH {_GRID}, d AS (SELECT f.book, s_suppkey sheet, 1 l, s_suppkey * 20 + 1 t, 4 ri, s_suppkey * 20 + 900 b FROM supplier,"
    " (SELECT DISTINCT l_returnflag book FROM lineitem) f), free AS (SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM d"
    " WHERE d.book = g.book AND d.sheet = g.sheet AND g.r BETWEEN d.t AND d.b AND g.c BETWEEN d.l AND d.ri)),"
    f" {_ISLANDS.format(src='free')}, kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.book = f.book"
    " AND d.sheet = f.sheet AND f.l <= d.ri AND d.l <= f.ri AND f.t <= d.b AND d.t <= f.b)),"
    " every AS (SELECT *, 'plain_range' kind FROM kept UNION ALL SELECT *, 'declared_table' FROM d)"
    f" SELECT book, sheet, l AS \"left\", t AS top, ri AS \"right\", b AS bottom, {_AREA.format('l', 't', 'ri', 'b')} AS range,"
    " t AS header_row, kind FROM every",
)
def regions_beside_tables(c):
    return G.discover_regions(grid(c), declared(c))


@query("a8_read_region", S.TEXT["orders"])
def read_region(c):
    df = c.text("orders")
    names = T.data_columns(df)
    cells = [
        F.struct(F.lit(i + 1).alias("col"), T.quoted(n).alias("text")) for i, n in enumerate(names)
    ]
    body = df.select((F.col(ROW) + 2).alias("row"), F.explode(F.array(*cells)).alias("c")).select(
        "row", "c.col", "c.text"
    )
    head = c.spark.createDataFrame([(1, i + 1, n) for i, n in enumerate(names)], "row long, col int, text string")
    grid_cells = body.unionByName(head).select(
        F.lit("b").alias("book"), F.lit("s").alias("sheet"), "row", "col", F.lit("text").alias("kind"), "text"
    )
    return G.read_region(grid_cells, "b", "s", (1, 1, len(names), df.count() + 1)).drop(ROW)


@query(
    "a9_region_selections",
    "WITH r AS (SELECT l_orderkey book, l_linenumber n, l_suppkey % 3 s, l_partkey % 40 l, l_partkey % 40 + CAST(l_quantity AS BIGINT) ri,"
    " l_suppkey % 25 t, l_suppkey % 25 + l_linenumber b FROM lineitem), p AS (SELECT a.book, count(*) k FROM r a JOIN r z"
    " ON a.book = z.book AND a.s = z.s AND a.n < z.n AND a.l <= z.ri AND z.l <= a.ri AND a.t <= z.b AND z.t <= a.b GROUP BY a.book)"
    " SELECT r.book, count(*) regions, coalesce(max(p.k), 0) overlapping_pairs, coalesce(max(p.k), 0) = 0 AS valid"
    " FROM r LEFT JOIN p USING (book) GROUP BY r.book",
)
def region_selections(c):
    rect = c.raw("lineitem").select(
        F.col("l_orderkey").alias("book"),
        F.format_string("%06d", "l_linenumber").alias("name"),
        (F.col("l_suppkey") % 3).alias("sheet"),
        (F.col("l_partkey") % 40).alias("left"),
        (F.col("l_suppkey") % 25).alias("top"),
        (F.col("l_partkey") % 40 + F.col("l_quantity").cast("long")).alias("right"),
        (F.col("l_suppkey") % 25 + F.col("l_linenumber")).alias("bottom"),
    )
    return G.selection_verdicts(rect)


@query(
    "a10_unsafe_cells",
    f"SELECT count(*) cells FROM ({S.long_form('documents')}) WHERE {S.control('v')}",
)
def unsafe_cells(c):
    return T.unsafe_cells(c.text("documents"))[0]


@query(
    "a10_first_unsafe_cells",
    f"WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)"
    f" SELECT n AS _row, 1 AS _col, 'text' AS \"column\" FROM d WHERE {S.control('text')}",
)
def first_unsafe_cells(c):
    return T.unsafe_cells(c.text("documents"))[1]


@query("a11_write_table", S.TEXT["customer"])
def write_customer(c):
    df = c.text("customer")
    path = f"{c.ws.root}/out/customer"
    write_table(df, T.data_columns(df), path)
    return c.spark.read.parquet(path)


@query(
    "a12_publish",
    "SELECT CAST(c_custkey AS VARCHAR) source_key, c_mktsegment segment,"
    " CASE WHEN c_acctbal < 0 THEN '[-1000, 0)' WHEN c_acctbal < 5000 THEN '[0, 5000)' ELSE '[5000, 10000]' END balance FROM customer",
)
def publish_customer(c):
    source = c.text("customer")
    p = protect(source, customer_policy(source), c.ws, profile="controlled_pseudonymisation")
    B.bind_source(p.keymap, {"table": source})
    data, private = f"{c.ws.root}/shared/data", f"{c.ws.root}/private/map"
    publish(c.spark, p, {"table": source}, data, private, approved=True, secret="0" * 32)
    keymap = B.open_key_map(c.spark, private, "0" * 32)
    labels = keymap.book.filter("field = 'c_mktsegment'").select(F.col("code").alias("c_mktsegment"), F.col("label").alias("segment"))
    return (
        c.spark.read.parquet(f"{data}/table")
        .join(keymap.records["table"], "record_id")
        .join(labels, "c_mktsegment")
        .select("source_key", "segment", F.col("c_acctbal").alias("balance"))
    )


_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
           " conversations").split()


@query(
    "a13_table_inventory",
    " UNION ALL ".join(f"SELECT '{t}' sheet, count(*) n_rows FROM {t}" for t in _TABLES),
)
def table_inventory(c):
    found = T.list_tables(c.spark, c.folder)
    T.extra_tables(found, ["customer"])
    return union(
        [c.raw(t).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("sheet", F.lit(t)) for t in found]
    )


# --- B ---
@query(
    "b1_heading_class",
    f"WITH h AS (SELECT unnest(string_split(text, chr(10))) h FROM documents UNION ALL SELECT url FROM pages)"
    f" SELECT {S.heading_class('h')} AS class, count(*) n FROM h GROUP BY 1",
)
def heading_class(c):
    lines = c.text("documents", ["text"]).select(F.explode(F.split("text", "\n")).alias("h"))
    every = lines.unionByName(c.text("pages", ["url"]).select(F.col("url").alias("h")))
    return every.groupBy(X.heading_class(F.col("h")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_VALUES = (
    "SELECT 'documents' src, text v FROM documents UNION ALL SELECT 'conversations', text FROM conversations"
    " UNION ALL SELECT 'url', url FROM pages UNION ALL SELECT 'props', props FROM events UNION ALL SELECT 'part', p_name FROM part"
    " UNION ALL SELECT 'date', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders"
    " UNION ALL SELECT 'price', CAST(o_totalprice AS VARCHAR) FROM orders"
)


def mixed_values(c):
    parts = [
        ("documents", "documents", "text"), ("conversations", "conversations", "text"), ("url", "pages", "url"),
        ("props", "events", "props"), ("part", "part", "p_name"), ("date", "orders", "o_orderdate"), ("price", "orders", "o_totalprice"),
    ]
    return union([c.dealt(t, [col]).select(F.lit(s).alias("src"), F.col(col).alias("v")) for s, t, col in parts])


@query(
    "b2_cell_predicates",
    f"SELECT src, count(*) n, count_if({S.control('v')}) control, count_if({S.unsafe_control('v')}) unsafe,"
    f" count_if({S.formula('v')} OR {S.control('v')}) formula_or_control, count_if({S.identifier('v')}) identifier,"
    f" count_if({S.free_text('v')}) free_text, count_if({S.safe('v')}) safe FROM ({_VALUES}) GROUP BY src",
)
def cell_predicates(c):
    v = F.col("v")
    return mixed_values(c).groupBy("src").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(X.has_control(v)).alias("control"),
        F.count_if(X.has_unsafe_control(v)).alias("unsafe"),
        F.count_if(X.formula_or_control(v)).alias("formula_or_control"),
        F.count_if(X.identifier_shaped(v)).alias("identifier"),
        F.count_if(X.free_text_shaped(v)).alias("free_text"),
        F.count_if(X.safe_category(v)).alias("safe"),
    )


_FINITE = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_TYPE = (
    f"CASE WHEN count_if(v <> '') = 0 THEN 'empty' WHEN count_if(regexp_full_match(v, {S.q(_FINITE)})) < count_if(v <> '') THEN 'text'"
    f" WHEN count_if(regexp_full_match(v, {S.q(_FINITE)}) AND CAST(TRY_CAST(v AS DECIMAL(38,8)) AS DECIMAL(38,0)) = TRY_CAST(v AS DECIMAL(38,8)))"
    " = count_if(v <> '') THEN 'integer' ELSE 'decimal' END"
)


@query(
    "b3_types",
    f"SELECT sheet, col AS \"column\", {_TYPE} AS type FROM ({S.long_form('customer', 'orders', 'part', 'events')}) GROUP BY sheet, col",
)
def types(c):
    return union(
        [P.type_counts(c.text(t)).withColumn("sheet", F.lit(t)) for t in ("customer", "orders", "part", "events")]
    )


def profile_sql(table: str) -> str:
    return (
        f"WITH cells AS ({S.long_form(table)}), dist AS (SELECT col, v, count(*) n FROM cells GROUP BY col, v),"
        f" typed AS (SELECT col, {_TYPE} AS type FROM cells GROUP BY col)"
        f" SELECT col AS \"column\", {S.heading_class('col')} AS inferred_classification, any_value(type) AS type, count(*) cardinality,"
        f" CAST(sum(n) AS BIGINT) n_rows, CAST(coalesce(sum(CASE WHEN {S.blank('v')} THEN n END), 0) AS BIGINT) blank_count,"
        f" count_if(n < 2) categories_below_2, concat_ws(',', CASE WHEN bool_or({S.identifier('v')}) THEN 'identifier_or_date_shape' END,"
        f" CASE WHEN bool_or({S.free_text('v')} OR {S.formula('v')} OR {S.control('v')}) THEN 'free_text_or_unsafe_cell' END,"
        f" CASE WHEN count(*) / sum(n) > 0.5 THEN 'high_cardinality' END,"
        rf" CASE WHEN bool_or(regexp_matches(v, '\.\p{{Nd}}{{3,}}')) THEN 'precise_number' END) AS flags"
        " FROM dist JOIN typed USING (col) GROUP BY col"
    )


for _table in ("customer", "orders", "lineitem", "documents", "events"):

    @query(f"b4_profile_{_table}", profile_sql(_table))
    def profile_table(c, table=_table):
        return P.profile(c.dealt(table) if table == "lineitem" else c.text(table)).withColumn("flags", F.concat_ws(",", "flags"))


@query(
    "b5_category_review",
    f"WITH dist AS (SELECT sheet, col, v, count(*) n FROM ({S.long_form('customer', 'orders', 'part', 'supplier')}) GROUP BY ALL)"
    f" SELECT sheet, col AS \"column\", count_if(NOT {S.blank('v')}) labels,"
    f" CAST(coalesce(sum(CASE WHEN {S.blank('v')} THEN n END), 0) AS BIGINT) blank_count,"
    f" count_if(NOT {S.blank('v')} AND NOT {S.safe('v')}) unsafe_labels FROM dist GROUP BY sheet, col",
)
def category_review(c):
    return union(
        [P.category_stats(c.text(t)).withColumn("sheet", F.lit(t)) for t in ("customer", "orders", "part", "supplier")]
    )


@query(
    "b5_categories",
    "SELECT 'c_mktsegment' AS \"column\", v AS label, row_number() OVER (ORDER BY v) AS pos FROM (SELECT DISTINCT c_mktsegment v FROM customer)"
    " UNION ALL SELECT 'p_brand', v, row_number() OVER (ORDER BY v) FROM (SELECT DISTINCT p_brand v FROM part)",
)
def category_lists(c):
    rows = [
        (col, label, i + 1)
        for t, col in (("customer", "c_mktsegment"), ("part", "p_brand"))
        for i, label in enumerate(P.categories(c.text(t, [col]), col))
    ]
    return c.spark.createDataFrame(rows, "column string, label string, pos long")


@query(
    "b6_review_entries",
    "SELECT sha256(text) AS digest, length(text) AS n_chars, count(*) AS count FROM documents GROUP BY text",
)
def review_entries(c):
    return P.review_entries(c.text("documents", ["text"]), "text").select(
        "digest", F.length("original").alias("n_chars"), "count"
    )


@query(
    "b7_returned_inspection",
    "SELECT count(*) n_rows, 'c_acctbal,c_mktsegment,c_nationkey,outcome' AS headings FROM customer",
)
def returned_inspection(c):
    source = c.text("customer")
    p = protect(source, customer_policy(source), c.ws)
    n, headings = P.inspect_returned(p.table.withColumn("outcome", F.lit("Pass")))
    return c.spark.createDataFrame([(n, ",".join(sorted(headings)))], "n_rows long, headings string")


@query("b8_decisions", "SELECT count(*) n_rows, 1 dropped, 2 coded, 1 retained FROM customer")
def decisions(c):
    source = c.text("customer")
    return P.decision_summary(source, customer_policy(source))


# --- C ---
_ACCEPTED = (
    "CASE WHEN class = 'direct_identifier' THEN 'identifier_retention' WHEN class = 'free_text' THEN 'narrative_action'"
    " WHEN labels = 0 OR labels > 1000 OR bad > 0 THEN 'categories' ELSE 'accepted' END"
)


@query(
    "c1_policy_verdicts",
    f"WITH dist AS (SELECT DISTINCT sheet, col, v FROM ({S.long_form('customer', 'orders', 'part', 'documents')})),"
    f" per AS (SELECT sheet, col, {S.heading_class('col')} AS class, count(*) labels, count_if(NOT {S.safe('v')}) bad FROM dist GROUP BY sheet, col)"
    f" SELECT sheet, col AS \"column\", {_ACCEPTED} AS verdict FROM per",
)
def policy_verdicts(c):
    """Could each column be kept with the values it holds? Asked of the policy check itself."""
    rows = []
    for t in ("customer", "orders", "part", "documents"):
        df = c.text(t)
        stats = P.category_stats(df).collect()
        # Only bounded domains of safe labels are listed; a larger or unsafe domain is
        # refused for what it is, which an unsafe stand-in shows as well.
        listed = [r.column for r in stats if r.labels <= 1000 and not r.unsafe_labels and not r.blank_count]
        domains = {r.column: [] for r in stats if r.column in listed}
        for r in P.distinct_values(df, listed).select("column", "value").collect():
            domains[r.column].append(r.value)
        for r in stats:
            values = domains.get(r.column, [""])
            raw = {
                "version": 3, "min_group_size": 2,
                "columns": {"key": {"action": "pseudonymise", "classification": "direct_identifier"},
                            r.column: {"action": "keep", "classification": "quasi_identifier", "allowed_values": values}},
            }
            try:
                parse_policy(raw)
                rows.append((t, r.column, "accepted"))
            except PolicyError as e:
                rows.append((t, r.column, e.code))
    return c.spark.createDataFrame(rows, "sheet string, column string, verdict string")


@query(
    "c2_authored_policy",
    "SELECT CAST(c_custkey AS VARCHAR) source_key, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
)
def authored_policy(c):
    """Customers under a policy authored from their own categories, and what its codes stand for."""
    df = c.text("customer")
    policy = (
        PolicyBuilder()
        .key("c_custkey")
        .code("c_mktsegment", P.categories(df, "c_mktsegment"))
        .code("c_nationkey", P.categories(df, "c_nationkey"))
        .drop("c_name", "direct_identifier")
        .drop("c_acctbal")
        .build()
    )
    p = protect(df, policy, c.ws, profile=LOOSE)
    out = p.stages["table"]
    for field, name in (("c_mktsegment", "segment"), ("c_nationkey", "nation")):
        out = out.join(p.keymap.book_of("table").filter(F.col("field") == field).select(F.col("code").alias(field), F.col("label").alias(name)), field)
    return out.select("source_key", "segment", "nation")


@query(
    "c3_output_projection",
    "SELECT * FROM (VALUES (1, 'record_id'), (2, 'c_nationkey'), (3, 'c_mktsegment'), (4, 'c_acctbal')) v(pos, \"column\"),"
    " (SELECT count(*) filled FROM customer)",
)
def output_projection(c):
    source = c.text("customer")
    table = protect(source, customer_policy(source), c.ws).table
    one = table.agg(*[F.count_if(F.col(n) != "").alias(n) for n in table.columns])
    cells = [
        F.struct(F.lit(i + 1).alias("pos"), F.lit(n).alias("column"), F.col(n).alias("filled"))
        for i, n in enumerate(table.columns)
    ]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


@query(
    "c4_narrowed_domains",
    "SELECT DISTINCT 'c_mktsegment' AS \"column\", c_mktsegment AS label FROM customer"
    " UNION ALL SELECT DISTINCT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer",
)
def narrowed_domains(c):
    source = c.text("customer")
    wide = customer_policy(source, spare=("SPARE ONE", "SPARE TWO"))
    p = protect(source, wide, c.ws).keymap.policies["table"]
    rows = [(n, v) for n in p.of_action("code") for v in p.columns[n].domain.values]
    return c.spark.createDataFrame(rows, "column string, label string")


@query(
    "c5_policy_serialised",
    "WITH c AS (SELECT c_acctbal v, floor(min(c_acctbal) OVER ())::BIGINT lo, ceil(max(c_acctbal) OVER ())::BIGINT hi FROM customer)"
    " SELECT 'c_acctbal' AS \"column\", CASE WHEN v < 0 THEN '[' || lo || ', 0)' ELSE '[0, ' || hi || ']' END AS label, count(*) n FROM c GROUP BY 2"
    " UNION ALL SELECT 'o_totalprice', 'in bounds', count(*) FROM orders",
)
def policy_serialised(c):
    """Values under policies that were written as JSON values and read again."""
    parts = []
    for t, col in (("orders", "o_totalprice"), ("customer", "c_acctbal")):
        df = c.text(t, [col])
        r = c.raw(t).agg(F.floor(F.min(col)).alias("lo"), F.ceil(F.max(col)).alias("hi")).first()
        lo, hi = int(r.lo), int(r.hi)
        b = PolicyBuilder().key("key")
        policy = (b.numeric(col, lo, hi) if lo >= 0 else b.bins(col, [lo, 0, hi])).build()
        rule = parse_policy(json.loads(json.dumps(policy_dict(policy)))).columns[col]
        value = simple_value(rule, F.col(col))
        label = F.when(value.isNotNull(), "in bounds") if lo >= 0 else value
        parts.append(df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("column", F.lit(col)))
    return union(parts)
