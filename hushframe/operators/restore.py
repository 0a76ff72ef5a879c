"""Restore: verify a returned table cell by cell, then join identities, edits, results.

Each path joins once, writes the joined rows once, counts every violation in one
aggregate over them, and projects the answer from the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import refuse_any, refuse_if
from ..functions import numbers as N
from ..functions import text as X
from ..keymap import KeyMap
from ..policy import Policy, Rule
from ..sources.rows import ROW
from ..sources.tables import check_headings, data_columns, heading_ok, quoted
from ..workspace import Workspace
from .binding import check_map, check_unchanged
from .joins import dictionary_bytes, looked_up
from .profile import any_of
from .protect import bad_key, protected_values

RET, SRC = "_ret", "_src"
#: Returned tables of more rows are joined slice by slice, in so many slices at most: only one slice's rows lie in shuffle files.
SLICE_ROWS, SLICES = 4_000_000, 4


def cells(df: DataFrame, names: list[str]) -> Column:
    return F.struct(*[quoted(n).alias(n) for n in names])


def ret(name: str) -> Column:
    return F.col(RET).getField(name)


def src(name: str) -> Column:
    return F.col(SRC).getField(name)


def same_set(given: Iterable[str], actual: Iterable[str], what: str) -> None:
    """Approvals must name exactly what is there, once each."""
    given = list(given)
    refuse_if(
        any(not isinstance(g, str) for g in given)
        or len(given) != len(set(given))
        or set(given) != set(actual),
        f"every {what} needs explicit approval",
    )


# --- results joined by the key map alone ---
def coverage_counts(returned: DataFrame, records: DataFrame) -> DataFrame:
    """One row: rows and ids on each side, ids on one side only, malformed ids.

    ``records`` holds every id once, so equal counts with nothing one-sided prove that
    the returned ids are exactly the map's, each once.
    """
    a = returned.select("record_id", F.lit(1).alias("a"))
    b = records.select("record_id", F.lit(1).alias("b"))
    return a.join(b, "record_id", "full_outer").agg(
        F.count("a").alias("returned_rows"),
        F.count_if(F.col("b").isNull()).alias("unknown_ids"),
        F.count_if(F.col("a").isNull()).alias("missing_ids"),
        F.count_if(F.col("a").isNotNull() & ~X.is_uuid4(F.col("record_id"))).alias("bad_ids"),
    )


def restore_results(
    analysed: DataFrame,
    records: DataFrame,
    source_key: str,
    results: list[str],
    ws: Workspace,
    source: DataFrame | None = None,
    policy: Policy | None = None,
) -> DataFrame:
    """Source key + allow-listed results, in returned order; with the source and its
    policy, coded result columns get their labels back."""
    refuse_if((source is None) != (policy is None), "labels need both the source and its policy")
    refuse_if(
        len(set(results)) != len(results)
        or any(not heading_ok(c) or c in ("record_id", source_key) for c in results),
        "result list",
    )
    refuse_if(set(data_columns(analysed)) != {"record_id", *results}, "returned schema")
    check_map(records, source_key)
    joined = analysed.select("record_id", ROW, cells(analysed, results).alias(RET)).join(
        records.select("record_id", "source_key"), "record_id", "full_outer"
    )
    coded: list[str] = []
    if policy is not None:
        refuse_if(
            policy.source_key != source_key or set(data_columns(source)) != set(policy.columns),
            "source, policy and key map do not match",
        )
        coded = [n for n in results if n in policy.columns and policy.columns[n].action == "code"]
        refuse_if(not coded, "no coded result to restore")
        side = source.select(
            quoted(source_key).alias("_key"), cells(source, data_columns(source)).alias(SRC)
        )
        joined = joined.join(side, F.col("source_key") == F.col("_key"), "full_outer")
    stage = ws.keep(joined, "results")
    extra = []
    if policy is not None:
        n_source = source.count()
        extra = [
            F.count_if(F.col("_key").isNull()).alias("no_source_row"),
            F.count_if(F.col("source_key").isNull()).alias("unmapped_source"),
            F.count_if(bad_key(F.col("_key"))).alias("bad_source_keys"),
            (F.count(F.lit(1)) - F.lit(n_source)).alias("repeated_source_keys"),
        ]
        for i, n in enumerate(coded):
            label = src(n)
            bad = ~label.isin(list(policy.columns[n].domain.values)) | ~X.safe_category(label)
            extra.append(F.count_if(bad | ~X.is_uuid4(ret(n))).alias(f"bad_code{i}"))
    outputs = [src(n) if n in coded else ret(n) for n in results]
    unsafe = any_of([X.formula_or_control(c) for c in [F.col("source_key"), *outputs]])
    row = stage.agg(
        F.count_if(F.col("source_key").isNull()).alias("unknown_ids"),
        F.count_if(F.col(RET).isNull()).alias("missing_ids"),
        (F.count(RET) - F.count("source_key")).alias("count_difference"),
        F.count_if(F.col("record_id").isNotNull() & ~X.is_uuid4(F.col("record_id"))).alias("bad_ids"),
        F.count_if(unsafe).alias("unsafe_values"),
        *extra,
    ).first()
    repeated = stage.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("n")
    ).first().n
    refuse_any("returned results", {**row.asDict(), "repeated_ids": repeated})
    for n in coded:
        refuse_any("coded results", bijection_counts(stage, src(n), ret(n)).first().asDict())
    return stage.select(
        F.col("source_key").alias(source_key),
        *[o.alias(n) for o, n in zip(outputs, results, strict=True)],
        ROW,
    )


def bijection_counts(df: DataFrame, label: Column, code: Column) -> DataFrame:
    """One row: labels with several codes and codes with several labels."""
    pairs = df.groupBy(label.alias("label"), code.alias("code")).agg(F.lit(1).alias("one"))
    a = pairs.groupBy("label").agg(F.sum("one").alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("split_labels")
    )
    b = pairs.groupBy("code").agg(F.sum("one").alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("merged_codes")
    )
    return a.join(F.broadcast(b))


# --- edits ---
def edit_book(keymap: KeyMap, name: str) -> DataFrame:
    """``(field, code, label)`` of one table; shared columns see the codes of every table."""
    mine = (F.col("sheet") == name) | F.col("field").isin(list(keymap.shared))
    return keymap.book.filter(mine).select("field", "code", "label").distinct()


def decode_edits(
    df: DataFrame, policy: Policy, names: list[str], book: DataFrame, get=ret
) -> tuple[DataFrame, dict[str, Column]]:
    """(``df`` with codebook lookups, decoded value per editable column; NULL = refused)."""
    decoded: dict[str, Column] = {}
    sizes = dictionary_bytes(book) if set(names) & set(policy.of_action("code")) else {}
    for i, name in enumerate(names):
        rule = policy.columns[name]
        if rule.action == "code":
            side = book.filter(F.col("field") == name).select(F.col("code").alias(f"_ec{i}"), F.col("label").alias(f"_el{i}"))
            df = looked_up(df, get(name), side, f"_ec{i}", sizes.get(name, 0))
            decoded[name] = F.col(f"_el{i}")
        elif rule.action == "keep":
            decoded[name] = F.when(get(name).isin(list(rule.domain.values)), get(name))
        else:
            decoded[name] = N.canonical_numeric(get(name), rule.domain.bounds, rule.domain.places)
    return df, decoded


def changed(decoded: Column, original: Column, rule: Rule) -> Column:
    """The new value where an edit differs from the (canonical) source, else NULL."""
    before = (
        N.canonical_numeric(original, rule.domain.bounds, rule.domain.places)
        if rule.action == "keep_numeric"
        else original
    )
    return F.when(~decoded.eqNullSafe(before), decoded)


# --- full reconstruction ---
@dataclass
class Review:
    """A verified return, joined to its source and written once."""

    name: str
    stage: DataFrame
    source_columns: list[str]
    new_columns: list[str]
    editable: list[str] = field(default_factory=list)

    @property
    def edits(self) -> dict[str, Column]:
        return {n: F.col(f"_edit{i}") for i, n in enumerate(self.editable)}


def source_controls(policy: Policy, names: list[str], get=src) -> Column:
    """Whether a source row holds a forbidden control character."""
    return any_of(
        [
            X.has_unsafe_control(get(n))
            if policy.columns[n].action == "review_text"
            else X.has_control(get(n))
            for n in names
        ]
    )


def bad_result(c: Column) -> Column:
    return ~F.coalesce(X.safe_category(c), F.lit(False)) | (F.length(c) > X.MAX_FIELD)


def new_headings(name: str, returned: DataFrame, keymap: KeyMap) -> list[str]:
    columns = data_columns(returned)
    protected = keymap.protected_columns(name)
    refuse_if(not set(protected) <= set(columns), "protected columns are missing")
    refuse_if(len(columns) != len(set(columns)), "returned columns repeat")
    fresh = [c for c in columns if c not in protected]
    if fresh:
        check_headings(fresh)
    refuse_if(bool(set(fresh) & set(keymap.source_columns[name])), "a new column collides")
    refuse_if(bool(fresh) and keymap.editable is not None, "edited sets keep their columns only")
    return fresh


def in_slice(key: str, i: int, slices: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slices)) == i


def joined_return(
    name: str, source: DataFrame, returned: DataFrame, keymap: KeyMap, ws: Workspace
) -> tuple[list[DataFrame], list[str]]:
    """Returned rows beside their map entry and source row; one-sided rows included. A table of many rows first meets its map
    entries in slices of ids, written to ``ws``, and then comes in slices of source rows: ``returned`` is read once a slice."""
    fresh = new_headings(name, returned, keymap)
    wanted = [*keymap.protected_columns(name)[1:], *fresh]
    left = returned.select("record_id", F.col(ROW).alias("_at"), cells(returned, wanted).alias(RET))
    private = "entity_id" if keymap.related else "source_key"
    records = keymap.records[name].select("record_id", F.col(ROW).alias("_src_row"), F.col(private).alias("_who"))
    rows = source.select(
        F.col(ROW).alias("_src_row"), cells(source, keymap.source_columns[name]).alias(SRC)
    )
    slices = min(SLICES, 1 + keymap.records[name].count() // SLICE_ROWS)
    if slices == 1:
        return [left.join(records, "record_id", "full_outer").drop("record_id").join(rows, "_src_row", "left")], fresh
    met = []
    for i in range(slices):
        mine = in_slice("record_id", i, slices)
        met.append(ws.keep(left.filter(mine).join(records.filter(mine), "record_id", "full_outer").drop("record_id"), "met"))
    both = reduce(DataFrame.unionByName, met)
    parts = [in_slice("_src_row", i, slices) for i in range(slices)]
    return [both.filter(mine).join(rows.filter(mine), "_src_row", "left") for mine in parts], fresh


def marked_return(
    name: str, source: DataFrame, returned: DataFrame, keymap: KeyMap, ws: Workspace, reviews=None
) -> Review:
    """The joined rows, written once, with every cell judged but nothing refused yet. The stage has the source's cells, the new
    ones and the edits; ids and returned cells that were judged are left out."""
    policy = keymap.policies[name]
    editable = (keymap.editable or {}).get(name, [])
    fixed = [n for n in policy.retained if n not in editable]
    owner = ret("entity_id") if keymap.related else src(policy.source_key)
    # of what came back, what was judged is not written again
    left = [*(["entity_id"] if keymap.related else []), *new_headings(name, returned, keymap)]

    def marked(both: DataFrame) -> DataFrame:
        both, expected = protected_values(
            both.withColumn(ROW, F.col("_at")), policy, keymap.book_of(name), get=src, reviews=reviews
        )
        both, decoded = decode_edits(both, policy, editable, edit_book(keymap, name))
        return both.select(
            "_at",
            "_src_row",
            *(["_who"] if keymap.related else []),
            F.when(F.col(RET).isNotNull(), F.struct(*[ret(n).alias(n) for n in left] or [F.lit(True).alias("_here")])).alias(RET),
            SRC,
            F.col("_who").isNotNull().alias("_known"),
            (~owner.eqNullSafe(F.col("_who"))).alias("_moved"),
            F.coalesce(
                any_of([~F.coalesce(ret(n) == expected[n], F.lit(False)) for n in fixed]), F.lit(False)
            ).alias("_altered"),
            F.coalesce(any_of([decoded[n].isNull() for n in editable]), F.lit(False)).alias("_refused_edit"),
            *[
                changed(decoded[n], src(n), policy.columns[n]).alias(f"_edit{i}")
                for i, n in enumerate(editable)
            ],
        )

    met = Workspace(ws.spark, ws.root)
    try:
        parts, fresh = joined_return(name, source, returned, keymap, met)
        stage = reduce(DataFrame.unionByName, [ws.keep(marked(both), "restore") for both in parts])
    finally:
        met.release()
    return Review(name, stage, keymap.source_columns[name], fresh, editable)


def return_counts(rev: Review, keymap: KeyMap) -> DataFrame:
    """One row of violations of a returned table; all zero means it may be restored."""
    policy = keymap.policies[rev.name]
    here = F.col(RET).isNotNull() & F.col("_known")
    return rev.stage.agg(
        F.count_if(~F.col("_known")).alias("unknown_ids"),
        F.count_if(F.col(RET).isNull()).alias("missing_ids"),
        F.count_if(here & F.col(SRC).isNull()).alias("no_source_row"),
        F.count_if(here & F.col("_moved")).alias("changed_links"),
        F.count_if(here & F.col("_altered")).alias("altered_rows"),
        F.count_if(here & F.col("_refused_edit")).alias("refused_edits"),
        F.count_if(here & any_of([bad_result(ret(n)) for n in rev.new_columns])).alias("unsafe_results"),
        F.count_if(source_controls(policy, rev.source_columns)).alias("source_controls"),
        (F.count_if("_known") - F.lit(keymap.records[rev.name].count())).alias("repeated_ids"),
    )


def _verify(
    name: str, source: DataFrame, returned: DataFrame, keymap: KeyMap, ws: Workspace, reviews=None
) -> Review:
    rev = marked_return(name, source, returned, keymap, ws, reviews)
    refuse_any("returned table", return_counts(rev, keymap).first().asDict())
    return rev


def review(
    source: DataFrame, returned: DataFrame, keymap: KeyMap, ws: Workspace, reviews=None
) -> Review:
    """Verify one returned table against its source and key map."""
    (name,) = keymap.names
    check_unchanged(keymap, {name: source})
    return _verify(name, source, returned, keymap, ws, reviews)


def reconstruct(rev: Review, approved: list[str]) -> DataFrame:
    """Every source column (dropped ones too) plus the approved results.

    ``_row`` is the returned order; for an edited table it is the source order.
    """
    same_set(approved, rev.new_columns, "new result column")
    edits = rev.edits
    order = "_src_row" if rev.editable else "_at"
    return rev.stage.select(
        *[
            (F.coalesce(edits[n], src(n)) if n in edits else src(n)).alias(n)
            for n in rev.source_columns
        ],
        *[ret(n).alias(n) for n in approved],
        F.col(order).alias(ROW),
    )


def entity_key_mismatches(stage: DataFrame, keymap: KeyMap, name: str) -> DataFrame:
    """One row: (entity, source key) pairs of a table that differ from the entity map.

    Only distinct pairs are joined, so a busy entity costs one row.
    """
    key = keymap.policies[name].source_key
    pairs = stage.select(F.col("_who").alias("entity_id"), src(key).alias("k")).distinct()
    known = keymap.entities.select("entity_id", "source_key")
    return pairs.join(known, "entity_id", "left").agg(
        F.count_if(~F.col("k").eqNullSafe(F.col("source_key"))).alias("wrong_entity_key")
    )


def review_related(
    sources: dict[str, DataFrame], returned: dict[str, DataFrame], keymap: KeyMap, ws: Workspace
) -> dict[str, Review]:
    """Verify a returned set: coverage, links, fixed cells, edits and new results."""
    refuse_if(set(returned) != set(keymap.policies), "returned tables do not match the key map")
    check_unchanged(keymap, sources)
    out = {}
    for name in keymap.names:
        rev = _verify(name, sources[name], returned[name], keymap, ws)
        refuse_any("returned links", entity_key_mismatches(rev.stage, keymap, name).first().asDict())
        out[name] = rev
    return out


def change_counts(reviews: dict[str, Review]) -> dict[str, dict[str, int]]:
    """Per table and column: how many cells an edit changed; zeros left out."""
    found = {}
    for name, rev in reviews.items():
        if not rev.editable:
            found[name] = {}
            continue
        row = rev.stage.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(rev.edits.values())]).first()
        found[name] = {n: row[f"n{i}"] for i, n in enumerate(rev.edits) if row[f"n{i}"]}
    return found


def change_table(spark, counts: dict[str, dict[str, int]]) -> DataFrame:
    rows = [(t, n, c) for t, fields in counts.items() for n, c in fields.items()]
    return spark.createDataFrame(rows, "sheet string, field string, changed long")


def reconstruct_related(
    reviews: dict[str, Review],
    keymap: KeyMap,
    approved_results: dict[str, list[str]],
    approved_changes: dict[str, list[str]] | None = None,
    extra: dict[str, DataFrame] | None = None,
    approved_extra: list[str] = (),
) -> dict[str, DataFrame]:
    if keymap.editable is not None:
        counts = change_counts(reviews)
        refuse_if(
            not isinstance(approved_changes, dict) or set(approved_changes) != set(counts),
            "every changed field needs explicit approval",
        )
        for name, fields in counts.items():
            same_set(approved_changes[name], fields, "changed field")
    refuse_if(set(approved_results) != set(reviews), "every new result field needs explicit approval")
    out = {n: reconstruct(r, approved_results[n]) for n, r in reviews.items()}
    out.update(approved_tables(extra or {}, keymap.names, list(approved_extra)))
    return out


# --- extra result tables ---
def check_extra_names(names: list[str], reserved: list[str]) -> None:
    folded = [n.casefold() for n in names]
    refuse_if(
        len(set(folded)) != len(folded)
        or bool(set(folded) & {r.casefold() for r in reserved})
        or any(not heading_ok(n) for n in names),
        "added table names",
    )


def bad_extra_cells(df: DataFrame) -> DataFrame:
    """One row: rows, and cells that are neither blank nor a safe category."""
    bad = [
        F.when((quoted(n) != "") & ((F.length(quoted(n)) > X.MAX_FIELD) | ~X.safe_category(quoted(n))), 1)
        .otherwise(0)
        for n in data_columns(df)
    ]
    total = bad[0]
    for b in bad[1:]:
        total = total + b
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(total), F.lit(0)).alias("bad_cells"))


def review_extra(tables: dict[str, DataFrame], reserved: list[str]) -> list[str]:
    check_extra_names(list(tables), reserved)
    for df in tables.values():
        check_headings(data_columns(df))
        refuse_any("added table", {"bad_cells": bad_extra_cells(df).first().bad_cells})
    return list(tables)


def approved_tables(
    tables: dict[str, DataFrame], reserved: list[str], approved: list[str]
) -> dict[str, DataFrame]:
    same_set(approved, review_extra(tables, reserved), "added table")
    return dict(tables)


# --- writing edits back to a copy of the source ---
def apply_edits(source: DataFrame, rev: Review, policy: Policy | None = None, doubles: tuple[str, ...] = ()) -> DataFrame:
    """The source with only changed cells of permitted columns replaced; with no change,
    the source itself. ``doubles`` are the columns whose cells are kept as DOUBLE: an edit
    that such a cell would not keep exactly is refused."""
    if policy is not None and doubles:
        refuse_any("edits", {"imprecise": imprecise_edits(rev, policy, list(doubles)).first().imprecise})
    changed_rows = any_of([c.isNotNull() for c in rev.edits.values()])
    edits = rev.stage.filter(changed_rows).select(
        F.col("_src_row").alias(ROW), *[c.alias(f"_e{i}") for i, c in enumerate(rev.edits.values())]
    )
    at = {n: i for i, n in enumerate(rev.edits)}
    joined = source.join(edits, ROW, "left")
    return joined.select(
        *[
            (F.coalesce(F.col(f"_e{at[n]}"), quoted(n)) if n in at else quoted(n)).alias(n)
            for n in rev.source_columns
        ],
        ROW,
    )


def imprecise_edits(rev: Review, policy: Policy, double_columns: list[str]) -> DataFrame:
    """One row: edited numbers that a DOUBLE cell would not keep exactly."""
    hits = [
        F.when(c.isNotNull() & ~N.survives_double(c), 1).otherwise(0)
        for n, c in rev.edits.items()
        if n in double_columns and policy.columns[n].action == "keep_numeric"
    ]
    total = F.lit(0)
    for h in hits:
        total = total + h
    return rev.stage.agg(F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("imprecise"))
