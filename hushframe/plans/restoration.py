"""Queries: restore and edit (H), result tables (I), participant reconciliation (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import numbers as N
from ..operators import binding as B
from ..operators import reconcile as J
from ..operators import restore as R
from ..operators import results as I
from ..operators.protect import protect, protect_related, protected_values
from ..policy import PolicyBuilder, editable_fields, permissions
from ..sources import tables as T
from ..sources.rows import ROW
from . import sql as S
from .registry import query
from .setups import LOOSE, bound_customer, related, returned
from .shaping import union
from .protection import nation_tables

def grade():
    return F.when(F.col("c_acctbal") == "[-1000, 0)", "Overdrawn").otherwise("Solid")


GRADE_SQL = "CASE WHEN c_acctbal < 0 THEN 'Overdrawn' ELSE 'Solid' END"


@query("h1_results", f"SELECT CAST(c_custkey AS VARCHAR) c_custkey, {GRADE_SQL} AS grade FROM customer")
def results_by_map(c):
    _, p = bound_customer(c)
    back = returned(p, grade=grade()).select("record_id", "grade", ROW)
    return R.restore_results(back, p.keymap.records["table"], "c_custkey", ["grade"], c.ws).drop(ROW)


@query(
    "h1_coverage",
    f"SELECT count_if(c_acctbal >= 0) returned_rows, 0 unknown_ids, count_if(c_acctbal < 0) missing_ids, 0 bad_ids FROM customer",
)
def coverage(c):
    """Overdrawn customers left out of the return are missing, not silently ignored."""
    _, p = bound_customer(c)
    back = returned(p).filter("c_acctbal <> '[-1000, 0)'")
    return R.coverage_counts(back, p.keymap.records["table"])


@query("h2_result_labels", f"SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_mktsegment, {GRADE_SQL} AS grade FROM customer")
def result_labels(c):
    source, p = bound_customer(c)
    back = returned(p, grade=grade()).select("record_id", "c_mktsegment", "grade", ROW)
    return R.restore_results(
        back, p.keymap.records["table"], "c_custkey", ["c_mktsegment", "grade"], c.ws,
        source=source, policy=p.keymap.policies["table"],
    ).drop(ROW)


@query(
    "h2_bijection",
    "WITH b AS (SELECT DISTINCT o_orderstatus l, o_orderpriority k FROM orders) SELECT (SELECT count(*) FROM (SELECT l FROM b GROUP BY l HAVING count(*) > 1)) split_labels,"
    " (SELECT count(*) FROM (SELECT k FROM b GROUP BY k HAVING count(*) > 1)) merged_codes",
)
def bijection(c):
    return R.bijection_counts(c.text("orders"), F.col("o_orderstatus"), F.col("o_orderpriority"))


@query("h3_expected_values", "SELECT count(*) n_rows, 0 different, 0 refused FROM customer")
def expected_values(c):
    """Recompute every protected cell from source and stored codebook; compare."""
    source, p = bound_customer(c)
    policy = p.keymap.policies["table"]
    df, values = protected_values(source, policy, p.keymap.book_of("table"))
    want = df.select(ROW, *[v.alias(f"w{i}") for i, v in enumerate(values.values())])
    pairs = want.join(p.stages["table"].select(ROW, *values), ROW)
    off = F.lit(False)
    gone = F.lit(False)
    for i, n in enumerate(values):
        off = off | ~F.col(f"w{i}").eqNullSafe(F.col(n))
        gone = gone | F.col(f"w{i}").isNull()
    return pairs.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(off).alias("different"), F.count_if(gone).alias("refused"))


@query(
    "h4_review_counts",
    "SELECT 0 unknown_ids, 0 missing_ids, 0 no_source_row, 0 changed_links, count_if(c_acctbal < 0 AND c_mktsegment <> 'BUILDING') altered_rows,"
    " 0 refused_edits, count_if(c_acctbal < 0) unsafe_results, 0 source_controls, 0 repeated_ids FROM customer",
)
def review_counts(c):
    """A return where overdrawn rows got another segment code and an unsafe result."""
    source, p = bound_customer(c)
    code = p.keymap.code("table", "c_mktsegment", "BUILDING")
    low = F.col("c_acctbal") == "[-1000, 0)"
    back = returned(p, grade=F.when(low, "=1+1").otherwise("Solid")).withColumn(
        "c_mktsegment", F.when(low, F.lit(code)).otherwise(F.col("c_mktsegment"))
    )
    return R.return_counts(R.marked_return("table", source, back, p.keymap, c.ws), p.keymap)


@query("h5_round_trip_customer", f"SELECT t.*, CASE WHEN CAST(c_acctbal AS DOUBLE) < 0 THEN 'Overdrawn' ELSE 'Solid' END AS grade FROM ({S.TEXT['customer']}) t")
def round_trip_customer(c):
    source, p = bound_customer(c)
    rev = R.review(source, returned(p, grade=grade()), p.keymap, c.ws)
    return R.reconstruct(rev, ["grade"]).drop(ROW)


@query("h5_round_trip_lineitem", f"SELECT t.*, l_returnflag || l_linestatus AS outcome FROM ({S.TEXT['lineitem']}) t")
def round_trip_lineitem(c):
    """Every order line protected under its own row key, returned, and put back."""
    df = c.kept("lineitem").withColumn("line", F.col(ROW).cast("string"))
    b = PolicyBuilder(2).key("line")
    for n in S.COLUMNS["lineitem"]:
        if n in ("l_returnflag", "l_linestatus"):
            b.keep(n, ["A", "F", "N", "O", "R"])
        elif n in ("l_quantity", "l_extendedprice"):
            b.numeric(n, 0, 10_000_000)
        else:
            b.drop(n)
    # Values like 23.0 are canonicalised on the way out and come back from the source.
    p = protect(df, b.build(), c.ws, profile=LOOSE)
    B.bind_source(p.keymap, {"table": df})
    back = returned(p, outcome=F.concat("l_returnflag", "l_linestatus"))
    return R.reconstruct(R.review(df, back, p.keymap, c.ws), ["outcome"]).drop(ROW, "line")


@query("h6_approvals", f"SELECT *, CASE WHEN CAST(c_acctbal AS DOUBLE) < 0 THEN 'Overdrawn' ELSE 'Solid' END AS grade FROM ({S.TEXT['customer']})")
def approvals(c):
    """The source with the one new column, which was approved by name."""
    source, p = bound_customer(c)
    rev = R.review(source, returned(p, grade=grade()), p.keymap, c.ws)
    return R.reconstruct(rev, ["grade"]).drop(ROW)


_EXTRA = ("customer", "supplier", "part", "events", "orders")


@query(
    "h7_extra_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' sheet, (SELECT count(*) FROM {t}) n_rows, count_if(v <> '' AND (length(v) > 4096 OR NOT {S.safe('v')})) bad_cells FROM ({S.long_form(t)})"
        for t in _EXTRA
    ),
)
def extra_tables(c):
    R.check_extra_names(list(_EXTRA), ["lineitem"])
    return union([R.bad_extra_cells(c.text(t)).withColumn("sheet", F.lit(t)) for t in _EXTRA])


@query(
    "h8_related_review",
    "SELECT 'customer' sheet, count(*) n_rows, 0 altered_rows, 0 changed_links, 0 wrong_entity_key FROM customer"
    " UNION ALL SELECT 'orders', count(*), count_if(o_orderstatus = 'F'), count_if(o_orderstatus = 'P'), 0 FROM orders",
)
def related_review(c):
    """Orders come back with finished ones reopened and pending ones unlinked."""
    sources, p = related(c)
    status = F.col("o_orderstatus")
    back = {
        "customer": returned(p, "customer"),
        "orders": returned(p, "orders")
        .withColumn("entity_id", F.when(status == "P", F.col("record_id")).otherwise(F.col("entity_id")))
        .withColumn("o_orderstatus", F.when(status == "F", "O").otherwise(status)),
    }
    parts = []
    for n in sources:
        rev = R.marked_return(n, sources[n], back[n], p.keymap, c.ws)
        counts = R.return_counts(rev, p.keymap).select("altered_rows", "changed_links")
        keys = R.entity_key_mismatches(rev.stage, p.keymap, n)
        total = rev.stage.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counts.join(F.broadcast(keys)).join(F.broadcast(total)).withColumn("sheet", F.lit(n)))
    return union(parts)


def edited(c):
    """Finished orders set to open with urgent priority; dear ones capped at 400000."""
    sources, p = related(c, numbers=True, editable=True)
    urgent = p.keymap.code("orders", "o_orderpriority", "1-URGENT")
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    back = {
        "customer": returned(p, "customer"),
        "orders": returned(p, "orders")
        .withColumn("o_orderpriority", F.when(status == "F", F.lit(urgent)).otherwise(F.col("o_orderpriority")))
        .withColumn("o_totalprice", F.when(price.cast("double") > 400_000, "0400000.00").otherwise(price))
        .withColumn("o_orderstatus", F.when(status == "F", "O").otherwise(status)),
    }
    return sources, p, back


_EDITED = (
    f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE o_orderstatus END AS o_orderstatus,"
    " CASE WHEN CAST(o_totalprice AS DOUBLE) > 400000 THEN '400000' ELSE o_totalprice END AS o_totalprice, o_orderdate,"
    f" CASE WHEN o_orderstatus = 'F' THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM ({S.TEXT['orders']})"
)
_CHANGES = (
    "SELECT 'orders' sheet, 'o_orderstatus' AS field, count_if(o_orderstatus = 'F') changed FROM orders"
    " UNION ALL SELECT 'orders', 'o_orderpriority', count_if(o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') FROM orders"
    " UNION ALL SELECT 'orders', 'o_totalprice', count_if(o_totalprice > 400000) FROM orders"
)


@query("h9_related_restore", _EDITED)
def related_restore(c):
    sources, p, back = edited(c)
    reviews = R.review_related(sources, back, p.keymap, c.ws)
    changes = R.change_counts(reviews)
    out = R.reconstruct_related(
        reviews, p.keymap, {n: [] for n in sources}, {n: list(f) for n, f in changes.items()}
    )
    return out["orders"].drop(ROW)


@query("h10_edit_permissions", _CHANGES)
def edit_permissions(c):
    """Every permitted heading and the number of its cells that came back changed."""
    sources, p, back = edited(c)
    permitted = permissions(c.spark, editable_fields(p.keymap.editable, p.keymap.policies))
    counts = R.change_counts(R.review_related(sources, back, p.keymap, c.ws))
    joined = permitted.join(R.change_table(c.spark, counts), ["sheet", "field"], "left")
    return joined.select("sheet", "field", F.coalesce("changed", F.lit(0)).cast("long").alias("changed"))


@query(
    "h11_decoded_edits",
    "SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS status, o_orderpriority AS priority, count(*) n,"
    " count_if(o_totalprice > 300000) refused_numbers FROM orders GROUP BY 1, 2",
)
def decoded_edits(c):
    """Statuses written as unknown words and numbers above the bound are refused."""
    sources, p = related(c, numbers=True, editable=True)
    df = p.tables["orders"].withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "Finished").otherwise(F.col("o_orderstatus"))).withColumn(
        "o_totalprice", F.when(F.col("o_totalprice").cast("double") > 300_000, "1000000.01").otherwise(F.col("o_totalprice"))
    )
    book = R.edit_book(p.keymap, "orders")
    looked, decoded = R.decode_edits(df, p.keymap.policies["orders"], p.keymap.editable["orders"], book, get=T.quoted)
    return looked.groupBy(decoded["o_orderstatus"].alias("status"), decoded["o_orderpriority"].alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(decoded["o_totalprice"].isNull()).alias("refused_numbers")
    )


@query(
    "h12_changed_values",
    "SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, '400000' AS new_price FROM orders WHERE o_totalprice > 400000",
)
def changed_values(c):
    sources, p, back = edited(c)
    rev = R.marked_return("orders", sources["orders"], back["orders"], p.keymap, c.ws)
    price = rev.edits["o_totalprice"]
    return rev.stage.filter(price.isNotNull()).select(R.src("o_orderkey").alias("o_orderkey"), price.alias("new_price"))


@query("h13_change_counts", _CHANGES)
def change_counts(c):
    sources, p, back = edited(c)
    reviews = R.review_related(sources, back, p.keymap, c.ws)
    return R.change_table(c.spark, R.change_counts(reviews))


@query("h14_applied_edits", _EDITED)
def applied_edits(c):
    sources, p, back = edited(c)
    rev = R.review_related(sources, back, p.keymap, c.ws)["orders"]
    return R.apply_edits(sources["orders"], rev).drop(ROW)


@query(
    "h15_number_precision",
    "WITH v AS (SELECT CAST(l_orderkey + 1 AS VARCHAR) || '.' || CAST(l_partkey AS VARCHAR) || CAST(l_suppkey AS VARCHAR) || CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR) AS v FROM lineitem)"
    " SELECT count(*) n_rows, count_if(length(regexp_replace(replace(v, '.', ''), '0+$', '')) > 15) imprecise FROM v",
)
def number_precision(c):
    line = c.raw("lineitem")
    v = F.concat(
        (F.col("l_orderkey") + 1).cast("string"), F.lit("."), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
    )
    return line.select(v.alias("v")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~N.survives_double(F.col("v"))).alias("imprecise"))


@query(
    "h15_imprecise_edits",
    "SELECT count_if(o_totalprice > 400000) imprecise, count_if(o_totalprice > 400000) > 0 AS refused, count(*) n_rows FROM orders",
)
def imprecise_edits(c):
    """Dear orders get a price of 16 digits, which a DOUBLE cell would not keep: such a return is refused."""
    sources, p = related(c, numbers=True, editable=True)
    price = F.col("o_totalprice")
    long = F.concat(F.col("o_totalprice").cast("double").cast("long").cast("string"), F.lit(".0000000001"))
    back = {
        "customer": returned(p, "customer"),
        "orders": returned(p, "orders").withColumn("o_totalprice", F.when(price.cast("double") > 400_000, long).otherwise(price)),
    }
    rev, policy = R.review_related(sources, back, p.keymap, c.ws)["orders"], p.keymap.policies["orders"]
    try:
        R.apply_edits(sources["orders"], rev, policy, ("o_totalprice",))
        refused = False
    except Refused:
        refused = True
    counted = R.imprecise_edits(rev, policy, ["o_totalprice"])
    return counted.select("imprecise", F.lit(refused).alias("refused"), F.lit(sources["orders"].count()).alias("n_rows"))


# --- I ---
@query(
    "i1_domains",
    "SELECT 'nation' AS field, (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS labels,"
    " 2 AS tables, 0 AS conflicts, true AS ambiguous",
)
def result_domains(c):
    sources, policies = nation_tables(c)
    p = protect_related(sources, policies, c.ws)
    d = I.domains(p.keymap)
    assert d.ambiguous == {"nation"}
    return I.domain_table(p.keymap.book, p.keymap.shared)


def result_rows(c):
    """Results about orders: entity, priority code (or a new word), and a verdict."""
    sources, p = related(c)
    dear = F.col("o_orderstatus") == "P"
    rows = p.stages["orders"].select(
        "entity_id", "record_id",
        F.when(dear, F.concat(F.lit("Team "), F.col("o_orderstatus"))).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.concat(F.lit("Was "), F.col("o_orderstatus")).alias("verdict"), ROW,
    )
    return sources, p, rows


_PRIORITY = "CASE WHEN o_orderstatus = 'P' THEN 'Team P' ELSE o_orderpriority END"


@query(
    "i2_decoded_results",
    f"SELECT {_PRIORITY} AS value, o_orderstatus = 'P' AS novel, false AS bad, count(*) n FROM orders GROUP BY 1, 2",
)
def decoded_results(c):
    _, p, rows = result_rows(c)
    df, value, novel, bad = I.decode_results(rows, ["o_orderpriority"], I.domains(p.keymap))
    n = "o_orderpriority"
    return df.groupBy(value[n].alias("value"), novel[n].alias("novel"), bad[n].alias("bad")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "i3_linked_rows",
    "SELECT 0 unknown_entities, count_if(o_orderstatus = 'F') wrong_records, count_if(o_orderstatus = 'P') blank_record_ids FROM orders",
)
def linked_result_rows(c):
    """Pending rows lose their record id (allowed); finished ones name an unknown one."""
    _, p, rows = result_rows(c)
    status = F.substring("verdict", 5, 1)
    rec = F.when(status == "P", "").when(status == "F", F.concat(F.lit("x"), F.col("record_id"))).otherwise(F.col("record_id"))
    return I.link_counts(rows.withColumn("record_id", rec), p.keymap).select("unknown_entities", "wrong_records", "blank_record_ids")


@query("i4_repeated_entities", "SELECT count(*) repeated_entities FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def repeated_entities(c):
    _, p, rows = result_rows(c)
    return I.repeated_entities(rows)


@query(
    "i5_join_settings",
    "SELECT c_mktsegment, 'Was ' || o_orderstatus AS verdict, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
)
def join_settings(c):
    """Results beside a source column that the checked settings name, counted."""
    sources, p, rows = result_rows(c)
    joins = {"verdicts": I.Join("customer", ("c_mktsegment",))}
    I.check_joins(joins, {"verdicts": rows}, p.keymap)
    out = I.prepare_results({"verdicts": rows}, sources, p.keymap, c.ws, joins).tables["verdicts"]
    return out.groupBy("c_mktsegment", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "i6_result_join",
    f"SELECT c_name, {_PRIORITY} AS o_orderpriority, 'Was ' || o_orderstatus AS verdict FROM orders JOIN customer ON o_custkey = c_custkey",
)
def result_join(c):
    sources, p, rows = result_rows(c)
    joins = {"verdicts": I.Join("customer", ("c_name",), "entity_id")}
    return I.prepare_results({"verdicts": rows}, sources, p.keymap, c.ws, joins).tables["verdicts"].drop(ROW)


@query(
    "i6_record_join",
    f"SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, {_PRIORITY} AS o_orderpriority, 'Was ' || o_orderstatus AS verdict FROM orders",
)
def record_join(c):
    sources, p, rows = result_rows(c)
    joins = {"verdicts": I.Join("orders", ("o_orderkey",), "record_id")}
    return I.prepare_results({"verdicts": rows}, sources, p.keymap, c.ws, joins).tables["verdicts"].drop(ROW)


@query(
    "i7_novel_categories",
    "SELECT 'o_orderpriority' AS field, 1 AS novel, count(*) AS n_rows, false AS ready FROM orders"
    " UNION ALL SELECT 'verdict', count(DISTINCT o_orderstatus), count(*), false FROM orders",
)
def novel_categories(c):
    sources, p, rows = result_rows(c)
    rev = I.prepare_results({"verdicts": rows}, sources, p.keymap, c.ws)
    s = rev.summary["verdicts"]
    out = [(f, n, s["rows"], rev.ready) for f, n in s["new_categories"].items()]
    return c.spark.createDataFrame(out, "field string, novel long, n_rows long, ready boolean")


@query(
    "i8_approved_results",
    f"SELECT c_mktsegment, {_PRIORITY} AS o_orderpriority, 'Was ' || o_orderstatus AS verdict, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3",
)
def approved_results(c):
    sources, p, rows = result_rows(c)
    joins = {"verdicts": I.Join("customer", ("c_mktsegment",), "entity_id")}
    tables = {"verdicts": rows}
    rev = I.prepare_results(tables, sources, p.keymap, c.ws, joins)
    out = I.approve_results(
        rev, tables, sources, p.keymap, c.ws, joins, {"verdicts": ["o_orderpriority", "verdict"]},
        {"verdicts": list(rev.summary["verdicts"]["new_categories"])}, ["verdicts"], True,
    )
    return out["verdicts"].groupBy("c_mktsegment", "o_orderpriority", "verdict").agg(F.count(F.lit(1)).alias("n"))


# --- J: customers ordering in 1997 (target) against those ordering in 1998 (reference) ---
def participants(c, additions=True, removals=True, propose=True):
    orders = c.kept("orders", ["o_custkey", "o_orderdate", "o_orderpriority"])

    def of_year(year):
        per = orders.filter(F.substring("o_orderdate", 1, 4) == year).groupBy("o_custkey").agg(
            F.count(F.lit(1)).cast("string").alias("n"), F.min("o_orderpriority").alias("prio"), F.max("o_orderdate").alias("last")
        )
        return per.join(c.text("customer", ["c_custkey", "c_mktsegment"]).drop(ROW), F.col("o_custkey") == F.col("c_custkey"))

    from ..sources.rows import with_row_number

    target = of_year("1997").select(F.col("o_custkey").alias("person"), F.col("n").alias("orders"), F.col("prio").alias("priority"), F.col("c_mktsegment").alias("segment"))
    reference = of_year("1998").select(F.col("o_custkey").alias("person"), F.col("last").alias("seen"), F.col("c_mktsegment").alias("sector"))
    sources = {"target": with_row_number(target, c.ws, ["person"]), "reference": with_row_number(reference, c.ws, ["person"])}
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    policies = {
        "target": PolicyBuilder().key("person").numeric("orders", 0, 1000).code("priority", priorities).drop("segment").build(),
        "reference": PolicyBuilder().key("person").drop("seen").code("sector", segments).build(),
    }
    p = protect_related(sources, policies, c.ws, profile=LOOSE, editable={"target": ["orders", "priority"], "reference": []})
    B.bind_source(p.keymap, sources)
    back = {n: returned(p, n) for n in sources}
    settings = J.Settings("target", "reference", "added", additions, removals, {"segment": ("reference", "sector")})
    if propose:
        new = J.incoming(p.keymap.records["target"], p.keymap.records["reference"])
        code = p.keymap.code("target", "priority", "5-LOW")
        back["added"] = new.select("entity_id", F.lit("0").alias("orders"), F.lit(code).alias("priority"), F.col("_at").alias(ROW))
    return sources, p, back, settings


_YEARS = (
    "t AS (SELECT o_custkey k, CAST(count(*) AS VARCHAR) n, min(o_orderpriority) prio FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),"
    " r AS (SELECT DISTINCT o_custkey k FROM orders WHERE year(o_orderdate) = 1998)"
)


@query("j1_settings", f"WITH {_YEARS} SELECT CAST(k AS VARCHAR) person, n AS orders, prio AS priority, k IN (SELECT k FROM r) AS in_reference FROM t")
def participant_settings(c):
    """The rows of the table that the checked settings rebuild, and whether the reference knows their person."""
    sources, p, back, s = participants(c)
    J.check_settings(s, p.keymap, list(back))
    target, reference = (sources[n] for n in (s.target, s.reference))
    known = reference.select("person").distinct().withColumn("in_reference", F.lit(True))
    return target.join(known, "person", "left").select("person", "orders", "priority", F.coalesce("in_reference", F.lit(False)).alias("in_reference"))


@query("j2_one_row_per_entity", f"WITH {_YEARS} SELECT 'target' sheet, count(*) n_rows, 0 repeated_entities FROM t UNION ALL SELECT 'reference', count(*), 0 FROM r")
def one_row_per_entity(c):
    sources, p, _, _ = participants(c, propose=False)
    return union(
        [
            I.repeated_entities(p.keymap.records[n]).join(F.broadcast(sources[n].agg(F.count(F.lit(1)).alias("n_rows")))).withColumn("sheet", F.lit(n))
            for n in sources
        ]
    )


@query(
    "j3_incoming_outgoing",
    f"WITH {_YEARS} SELECT 'incoming' AS side, CAST(k AS VARCHAR) person FROM (SELECT k FROM r EXCEPT SELECT k FROM t)"
    " UNION ALL SELECT 'outgoing', CAST(k AS VARCHAR) FROM (SELECT k FROM t EXCEPT SELECT k FROM r)",
)
def incoming_outgoing(c):
    _, p, _, _ = participants(c, propose=False)
    t, r = p.keymap.records["target"], p.keymap.records["reference"]
    names = p.keymap.entities.select("entity_id", F.col("source_key").alias("person"))
    return union(
        [
            df.join(names, "entity_id").select(F.lit(side).alias("side"), "person")
            for side, df in (("incoming", J.incoming(t, r)), ("outgoing", J.outgoing(t, r)))
        ]
    )


@query(
    "j4_column_plan",
    f"WITH {_YEARS} SELECT 'segment' AS \"column\", 'reference' AS sheet, 'sector' AS source_column, c_mktsegment AS label, count(*) n FROM r JOIN customer ON k = c_custkey GROUP BY 4",
)
def column_plan(c):
    """Where each column that new rows need comes from, and the values found there."""
    sources, p, _, s = participants(c, propose=False)
    needed, plan = J.column_plan(p.keymap, s, J.usable_sources(p.keymap, s))
    return union(
        [
            sources[plan[col][0]].groupBy(T.quoted(plan[col][1]).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(col).alias("column"), F.lit(plan[col][0]).alias("sheet"), F.lit(plan[col][1]).alias("source_column"), "label", "n")
            for col in needed
        ]
    )


@query(
    "j5_completeness",
    f"WITH {_YEARS} SELECT 'segment' AS \"column\", (SELECT count(*) FROM (SELECT k FROM r EXCEPT SELECT k FROM t)) - (SELECT count(*) FROM (SELECT k FROM r EXCEPT SELECT k FROM t) JOIN customer ON k = c_custkey WHERE c_mktsegment <> 'BUILDING') AS missing",
)
def completeness(c):
    """Incoming people of one sector have it blanked in the reference: they are missing."""
    sources, p, _, s = participants(c, propose=False)
    new = J.incoming(p.keymap.records["target"], p.keymap.records["reference"])
    blanked = sources["reference"].withColumn("sector", F.when(F.col("sector") == "BUILDING", "").otherwise(F.col("sector")))
    plan = {"segment": ("reference", "sector")}
    return J.incomplete_columns(J.mapped_values(new, plan, {**sources, "reference": blanked}, p.keymap), plan)


@query(
    "j6_proposals",
    f"WITH {_YEARS} SELECT (SELECT count(*) FROM (SELECT k FROM t INTERSECT SELECT k FROM r)) AS not_incoming, 0 AS repeated, (SELECT count(*) FROM r) AS refused_values",
)
def proposals(c):
    """Everybody of the reference proposed, with a number above its bound."""
    _, p, back, _ = participants(c, propose=False)
    code = p.keymap.code("target", "priority", "5-LOW")
    everyone = p.keymap.records["reference"].select("entity_id", F.lit("1001").alias("orders"), F.lit(code).alias("priority"), ROW)
    new = J.incoming(p.keymap.records["target"], p.keymap.records["reference"])
    return J.decode_proposals(everyone, new, p.keymap, "target")[1]


@query(
    "j7_rebuilt_target",
    f"WITH {_YEARS} SELECT CAST(t.k AS VARCHAR) person, t.n AS orders, t.prio AS priority, c_mktsegment AS segment FROM t JOIN customer ON t.k = c_custkey WHERE t.k IN (SELECT k FROM r)"
    " UNION ALL SELECT CAST(r.k AS VARCHAR), '0', '5-LOW', c_mktsegment FROM r JOIN customer ON r.k = c_custkey WHERE r.k NOT IN (SELECT k FROM t)",
)
def rebuilt_target(c):
    sources, p, back, s = participants(c)
    return J.prepare_participants(sources, back, p.keymap, s, c.ws).table.drop(ROW)


@query(
    "j8_summary",
    f"WITH {_YEARS}, a AS (SELECT (SELECT count(*) FROM (SELECT k FROM r EXCEPT SELECT k FROM t)) i, (SELECT count(*) FROM (SELECT k FROM t EXCEPT SELECT k FROM r)) o, (SELECT count(*) FROM t) n)"
    " SELECT true AS approved, n + i - o AS target_rows, i AS additions, o AS removals, 0 AS missing_assignments FROM a"
    " UNION ALL SELECT false, n + i - o, i, o, i FROM a",
)
def participant_summary(c):
    out = []
    for propose in (True, False):
        sources, p, back, s = participants(c, propose=propose)
        rev = J.prepare_participants(sources, back, p.keymap, s, c.ws)
        none = {n: [] for n in sources}
        try:
            J.approve_participants(rev, sources, back, p.keymap, s, c.ws, none, True, True, True)
            ok = True
        except Refused:
            ok = False
        m = rev.summary
        out.append((ok, m["target_rows"], m["additions"], m["removals"], m["missing_assignments"]))
    return c.spark.createDataFrame(out, "approved boolean, target_rows long, additions long, removals long, missing_assignments long")
