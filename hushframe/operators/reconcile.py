"""Reconcile participants: bring a target table in line with a reference table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused, refuse_any, refuse_if
from ..keymap import KeyMap
from ..sources.rows import ROW
from ..sources.tables import data_columns, quoted
from ..workspace import Workspace
from .binding import table_digest
from .profile import any_of
from .restore import (
    cells,
    change_counts,
    decode_edits,
    edit_book,
    reconstruct_related,
    review_related,
    same_set,
)
from .results import repeated_entities


@dataclass(frozen=True)
class Settings:
    target: str
    reference: str
    proposals: str = ""
    include_additions: bool = False
    include_removals: bool = False
    # target column -> None (blank), column of the reference, or (table, column)
    column_sources: dict | None = None


def check_settings(s: Settings, keymap: KeyMap, found: list[str]) -> None:
    names = keymap.names
    refuse_if(keymap.version != 4, "reconciliation needs an editable key map")
    refuse_if(
        not all(isinstance(x, str) for x in (s.target, s.reference, s.proposals))
        or type(s.include_additions) is not bool
        or type(s.include_removals) is not bool,
        "settings",
    )
    refuse_if(s.target == s.reference, "target and reference are the same table")
    refuse_if(s.target not in names or s.reference not in names, "a chosen table is not in the key map")
    refuse_if(not keymap.editable[s.target], "the target has no editable column")
    refuse_if(bool(keymap.editable[s.reference]), "the reference is editable")
    refuse_if(s.proposals in names, "the proposal table's name is taken")
    allowed = set(names) | ({s.proposals} if s.proposals else set())
    refuse_if(not set(names) <= set(found) or bool(set(found) - allowed), "unexpected tables")


def membership(records: DataFrame) -> DataFrame:
    return records.select("entity_id", F.col(ROW).alias("_at"))


def incoming(target: DataFrame, reference: DataFrame) -> DataFrame:
    """Entities of the reference the target lacks, with their reference row."""
    return membership(reference).join(target.select("entity_id"), "entity_id", "left_anti")


def outgoing(target: DataFrame, reference: DataFrame) -> DataFrame:
    """Entities of the target the reference lacks, with their target row."""
    return membership(target).join(reference.select("entity_id"), "entity_id", "left_anti")


def usable_sources(keymap: KeyMap, s: Settings) -> list[str]:
    """Read-only tables with one row per entity; target and reference must be such."""
    usable = []
    for name in keymap.names:
        if name != s.target and keymap.editable[name]:
            continue
        repeats = repeated_entities(keymap.records[name]).first().repeated_entities
        if name in (s.target, s.reference):
            refuse_any("one row per entity is required", {"repeated_entities": repeats})
        if name != s.target and not repeats:
            usable.append(name)
    return usable


def column_plan(keymap: KeyMap, s: Settings, usable: list[str]) -> tuple[list[str], dict]:
    """(target columns that need a source, chosen sources as (table, column) or None)."""
    policy = keymap.policies[s.target]
    needed = [
        c
        for c in keymap.source_columns[s.target]
        if c not in keymap.editable[s.target] and c != policy.source_key
    ]
    chosen = s.column_sources or {}
    refuse_if(not isinstance(chosen, dict) or bool(set(chosen) - set(needed)), "column sources")
    plan = {}
    for column, value in chosen.items():
        origin = (s.reference, value) if isinstance(value, str) else value
        if origin is not None:
            good = isinstance(origin, tuple) and len(origin) == 2 and origin[0] in usable
            refuse_if(
                not good or origin[1] not in keymap.source_columns[origin[0]], "column sources"
            )
        plan[column] = origin
    return needed, plan


def mapped_values(
    new: DataFrame, plan: dict, sources: dict[str, DataFrame], keymap: KeyMap
) -> DataFrame:
    """``new`` (entity_id, _at) with one struct ``_m{i}`` per source table in the plan;
    one left join per table, however many columns it feeds."""
    tables = sorted({origin[0] for origin in plan.values() if origin is not None})
    for i, table in enumerate(tables):
        columns = sorted({o[1] for o in plan.values() if o is not None and o[0] == table})
        rows = sources[table].select(ROW, cells(sources[table], columns).alias(f"_m{i}"))
        side = keymap.records[table].select("entity_id", ROW).join(rows, ROW).drop(ROW)
        new = new.join(side, "entity_id", "left")
    return new


def mapped_column(plan: dict, column: str):
    origin = plan.get(column)
    if origin is None:
        return F.lit("")
    tables = sorted({o[0] for o in plan.values() if o is not None})
    return F.col(f"_m{tables.index(origin[0])}").getField(origin[1])


def incomplete_columns(new: DataFrame, plan: dict) -> DataFrame:
    """``(column, missing)``: incoming entities without a value, per mapped column."""
    mapped = [c for c, origin in plan.items() if origin is not None]
    if not mapped:
        return new.sparkSession.createDataFrame([], "column string, missing long")
    aggs = [
        F.count_if(mapped_column(plan, c).isNull() | (mapped_column(plan, c) == "")).alias(f"n{i}")
        for i, c in enumerate(mapped)
    ]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("missing")) for i, c in enumerate(mapped)]
    return new.agg(*aggs).select(F.explode(F.array(*rows)).alias("c")).select("c.*").filter("missing > 0")


def decode_proposals(
    proposals: DataFrame, new: DataFrame, keymap: KeyMap, target: str
) -> tuple[DataFrame, DataFrame]:
    """(``entity_id`` + decoded editable columns, one row of violation counts)."""
    editable = keymap.editable[target]
    refuse_if(set(data_columns(proposals)) != {"entity_id", *editable}, "proposal columns")
    looked, decoded = decode_edits(proposals, keymap.policies[target], editable, edit_book(keymap, target), get=quoted)
    out = looked.select("entity_id", *[decoded[n].alias(n) for n in editable])
    per_entity = out.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(any_of([quoted(n).isNull() for n in editable]).cast("long")).alias("bad"),
    )
    counts = per_entity.join(new.select("entity_id", F.lit(1).alias("wanted")), "entity_id", "left").agg(
        F.count_if(F.col("wanted").isNull()).alias("not_incoming"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("refused_values"),
    )
    return out, counts


@dataclass
class ParticipantReview:
    summary: dict
    ready: bool
    table: DataFrame | None
    tables: dict[str, DataFrame] | None
    digest: str


def prepare_participants(
    sources: dict[str, DataFrame],
    returned: dict[str, DataFrame],
    keymap: KeyMap,
    settings: Settings,
    ws: Workspace,
) -> ParticipantReview:
    """Verify the return, compare memberships, and rebuild the target when complete."""
    s = settings
    check_settings(s, keymap, list(returned))
    reviews = review_related(sources, {n: returned[n] for n in keymap.names}, keymap, ws)
    changes = change_counts(reviews)
    usable = usable_sources(keymap, s)
    needed, plan = column_plan(keymap, s, usable)
    target_rec, ref_rec = keymap.records[s.target], keymap.records[s.reference]
    new = ws.keep(incoming(target_rec, ref_rec), "incoming")
    gone = ws.keep(outgoing(target_rec, ref_rec), "outgoing")
    n_new, n_gone = new.count(), gone.count()

    filled = mapped_values(new, plan, sources, keymap)
    no_plan = [c for c in needed if c not in plan] if s.include_additions and n_new else []
    short = (
        sorted(r.column for r in incomplete_columns(filled, plan).collect())
        if s.include_additions
        else []
    )
    proposed, n_proposed = None, 0
    if s.proposals and s.proposals in returned:
        proposed, counts = decode_proposals(returned[s.proposals], new, keymap, s.target)
        refuse_any("proposals", counts.first().asDict())
        proposed = ws.keep(proposed, "proposals")
        n_proposed = proposed.count()
    unassigned = n_new - n_proposed if s.include_additions else 0
    ready = not no_plan and not short and not unassigned
    added = n_new if s.include_additions else 0
    removed = n_gone if s.include_removals else 0
    rows = sources[s.target].count() + added - removed
    refuse_if(rows < 1, "nobody would be left")
    summary = {
        "ready": ready,
        "target_rows": rows,
        "available_additions": n_new,
        "available_removals": n_gone,
        "additions": added,
        "removals": removed,
        "missing_assignments": unassigned,
        "missing_fields": no_plan,
        "missing_source_fields": short,
        "mapping_fields": needed,
        "source_columns": {n: keymap.source_columns[n] for n in usable},
        "changes": changes,
    }
    if not ready:
        return ParticipantReview(summary, False, None, None, "")
    restored = reconstruct_related(
        reviews, keymap, {n: [] for n in keymap.names}, {n: list(c) for n, c in changes.items()}
    )
    table = rebuild(
        restored[s.target],
        gone if removed else None,
        filled if added else None,
        proposed,
        plan,
        keymap,
        s.target,
    )
    table = ws.keep(table, "rebuilt")
    restored[s.target] = table
    return ParticipantReview(summary, True, table, restored, table_digest(table))


def rebuild(
    restored: DataFrame,
    gone: DataFrame | None,
    filled: DataFrame | None,
    proposed: DataFrame | None,
    plan: dict,
    keymap: KeyMap,
    target: str,
) -> DataFrame:
    """Surviving rows in source order, then incoming ones in reference order.

    ``_row`` keeps the source numbers and continues after them for incoming rows.
    """
    columns = keymap.source_columns[target]
    key = keymap.policies[target].source_key
    out = restored
    if gone is not None:
        out = out.join(gone.select(F.col("_at").alias(ROW)), ROW, "left_anti")
    out = out.select(*[quoted(c) for c in columns], ROW)
    if filled is None:
        return out
    last = restored.agg(F.max(ROW)).first()[0] + 1
    editable = keymap.editable[target]
    rows = filled.join(proposed, "entity_id").join(
        keymap.entities.select("entity_id", F.col("source_key").alias("_key")), "entity_id"
    )

    def value(c: str):
        if c == key:
            return F.col("_key")
        return quoted(c) if c in editable else mapped_column(plan, c)

    added = rows.select(*[value(c).alias(c) for c in columns], (F.col("_at") + F.lit(last)).alias(ROW))
    return out.unionByName(added)


def approve_participants(
    rev: ParticipantReview,
    sources: dict[str, DataFrame],
    returned: dict[str, DataFrame],
    keymap: KeyMap,
    settings: Settings,
    ws: Workspace,
    approved_changes: dict[str, list[str]],
    additions: bool,
    removals: bool,
    authorised: bool,
) -> dict[str, DataFrame]:
    """The rebuilt set, when changes, additions and removals were each approved."""
    refuse_if(authorised is not True or not rev.ready, "not ready or not authorised")
    refuse_if(
        additions is not bool(rev.summary["additions"]) or removals is not bool(rev.summary["removals"]),
        "additions and removals need their own approval",
    )
    same_set(list(approved_changes), rev.summary["changes"], "table")
    for name, fields in rev.summary["changes"].items():
        same_set(approved_changes[name], fields, "changed field")
    fresh = prepare_participants(sources, returned, keymap, settings, ws)
    if fresh.digest != rev.digest or fresh.summary != rev.summary:
        raise Refused("a table changed after its review")
    return fresh.tables


