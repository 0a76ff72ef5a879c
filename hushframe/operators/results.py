"""Free-form result tables: decode codes, check links, join chosen source columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import refuse_any, refuse_if
from ..functions import text as X
from ..keymap import KeyMap
from ..sources.rows import ROW
from ..sources.tables import data_columns, quoted
from ..workspace import Workspace
from .binding import check_unchanged, table_digests
from .joins import dictionary_bytes, keyed_join, looked_up
from .profile import any_of
from .restore import cells, same_set, src

IDS = ("entity_id", "record_id")


@dataclass
class Domains:
    """``codes`` is ``(field, code, label)`` over all tables, ``known`` is ``(field, label)``; ``ambiguous`` and ``headings`` are
    headings, of which there are as many as coded columns."""

    codes: DataFrame
    known: DataFrame
    ambiguous: set[str] = field(default_factory=set)
    headings: set[str] = field(default_factory=set)


def domains(keymap: KeyMap) -> Domains:
    """Codes and known labels as tables of any size; a code that stands for two labels is refused."""
    book = keymap.book
    split = book.groupBy("field", "code").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    refuse_any("a code stands for two labels", {"codes": split.filter("a <> b").count()})
    kept = [
        (n, v) for p in keymap.policies.values() for n in p.of_action("keep") for v in p.columns[n].domain.values
    ]
    known = book.select("field", "label").union(book.sparkSession.createDataFrame(kept, "field string, label string"))
    coded = [n for p in keymap.policies.values() for n in p.of_action("code")]
    ambiguous = {n for n in coded if coded.count(n) > 1 and n not in keymap.shared}
    return Domains(book.select("field", "code", "label").distinct(), known.distinct(), ambiguous, set(coded))


def domain_table(book: DataFrame, shared: tuple[str, ...]) -> DataFrame:
    """Per heading of a codebook table: labels, tables, conflicts, and ambiguity."""
    per_code = book.groupBy("field", "code").agg(F.count_distinct("label").alias("labels"))
    conflict = per_code.groupBy("field").agg(F.count_if(F.col("labels") > 1).alias("conflicts"))
    size = book.groupBy("field").agg(
        F.count_distinct("label").alias("labels"), F.count_distinct("sheet").alias("tables")
    )
    return size.join(conflict, "field").withColumn(
        "ambiguous", (F.col("tables") > 1) & ~F.col("field").isin(list(shared))
    )


def decode_results(
    df: DataFrame, names: list[str], d: Domains
) -> tuple[DataFrame, dict[str, Column], dict[str, Column], dict[str, Column]]:
    """(``df`` with lookups, value, is-novel and is-bad per result column)."""
    value, novel, bad = {}, {}, {}
    code_bytes, label_bytes = dictionary_bytes(d.codes), dictionary_bytes(d.known, texts=("label",))
    for i, n in enumerate(names):
        c = quoted(n)
        label, known = F.lit(None).cast("string"), F.lit(False)
        if n in code_bytes:
            side = d.codes.filter(F.col("field") == n).select(F.col("code").alias(f"_c{i}"), F.col("label").alias(f"_l{i}"))
            df = looked_up(df, c, side, f"_c{i}", code_bytes[n])
            label = F.col(f"_l{i}")
        if n in label_bytes:
            side = d.known.filter(F.col("field") == n).select(F.col("label").alias(f"_k{i}"), F.lit(True).alias(f"_known{i}"))
            df = looked_up(df, c, side, f"_k{i}", label_bytes[n])
            known = F.coalesce(F.col(f"_known{i}"), F.lit(False))
        is_code = label.isNotNull()
        blank = c == ""
        bad[n] = ~blank & (
            ~X.safe_category(c)
            | (is_code & F.lit(n in d.ambiguous))
            | (~is_code & X.is_uuid_shaped(c))
        )
        novel[n] = ~blank & ~is_code & ~known
        value[n] = F.coalesce(label, c)
    return df, value, novel, bad


def link_counts(df: DataFrame, keymap: KeyMap) -> DataFrame:
    """One row: unknown entities, record ids unknown or bound to another entity, blank
    record ids. Ids are de-duplicated before they are joined, so a busy entity is one row."""
    has_record = "record_id" in df.columns
    pair = ["entity_id", *(["record_id"] if has_record else [])]
    distinct = df.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))
    known = keymap.entities.select("entity_id", F.lit(1).alias("known"))
    out = (
        distinct.groupBy("entity_id").agg(F.sum("n").alias("n"))
        .join(known, "entity_id", "left")
        .agg(F.count_if(F.col("known").isNull() | ~X.is_uuid4(F.col("entity_id"))).alias("unknown_entities"))
    )
    if not has_record:
        return out.withColumns({"wrong_records": F.lit(0).cast("long"), "blank_record_ids": F.lit(0).cast("long")})
    records = all_records(keymap).select("record_id", F.col("entity_id").alias("owner"))
    # blank ids own nothing and may be very many: they aren't joined
    wrong = distinct.filter(F.col("record_id") != "").join(records, "record_id", "left").agg(
        F.count_if(~F.col("owner").eqNullSafe(F.col("entity_id"))).alias("wrong_records")
    )
    blank = distinct.agg(F.coalesce(F.sum(F.when(F.col("record_id") == "", F.col("n"))), F.lit(0)).alias("blank_record_ids"))
    return out.join(F.broadcast(wrong)).join(F.broadcast(blank))


def all_records(keymap: KeyMap) -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            df.select(F.lit(n).alias("sheet"), "record_id", ROW, "entity_id")
            for n, df in keymap.records.items()
        ],
    )


def repeated_entities(df: DataFrame) -> DataFrame:
    """One row: entities occurring more than once."""
    return df.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("repeated_entities")
    )


@dataclass(frozen=True)
class Join:
    source: str
    fields: tuple[str, ...]
    by: str = "entity_id"
    unique_entities: bool = False


def check_joins(joins: dict[str, Join], returned: dict[str, DataFrame], keymap: KeyMap) -> None:
    for name, j in joins.items():
        refuse_if(name not in returned, "join for an unknown result table")
        columns = data_columns(returned[name])
        good = (
            "entity_id" in columns
            and j.source in keymap.policies
            and bool(j.fields)
            and len(set(j.fields)) == len(j.fields)
            and j.by in IDS
            and j.by in columns
            and set(j.fields) <= set(keymap.source_columns[j.source])
            and not set(j.fields) & (set(columns) - set(IDS))
        )
        refuse_if(not good, "join settings")


def source_index(source: DataFrame, keymap: KeyMap, j: Join) -> DataFrame:
    """``(key, _src)``: one source row per entity or record; several per key are refused."""
    records = keymap.records[j.source]
    if j.by == "entity_id":
        n = repeated_entities(records).first().repeated_entities
        refuse_any("join source has several rows per entity", {"entities": n})
    rows = source.select(ROW, cells(source, list(j.fields)).alias("_src"))
    return records.join(rows, ROW).select(F.col(j.by).alias(j.by), "_src")


@dataclass
class ResultReview:
    summary: dict
    ready: bool
    tables: dict[str, DataFrame]
    digests: dict[str, str]


def prepare_results(
    returned: dict[str, DataFrame],
    sources: dict[str, DataFrame],
    keymap: KeyMap,
    ws: Workspace,
    joins: dict[str, Join] | None = None,
) -> ResultReview:
    """Check and decode every result table; join source columns where asked to."""
    joins = joins or {}
    refuse_if(not keymap.related or keymap.version == 5, "result tables need a related key map")
    check_unchanged(keymap, sources)
    check_joins(joins, returned, keymap)
    d = domains(keymap)
    summary, tables = {}, {}
    for name, df in returned.items():
        columns = data_columns(df)
        linked = "entity_id" in columns
        fields = [c for c in columns if c not in IDS]
        refuse_if("record_id" in columns and not linked, "record_id without entity_id")
        refuse_if(not fields, "no result column")
        looked, value, novel, bad = decode_results(df, fields, d)
        stage = ws.keep(
            looked.select(
                ROW,
                *[c for c in IDS if c in columns],
                *[value[n].alias(n) for n in fields],
                *[novel[n].alias(f"_new{i}") for i, n in enumerate(fields)],
                any_of(list(bad.values())).alias("_bad"),
            ),
            "results",
        )
        row = stage.agg(F.count(F.lit(1)).alias("rows"), F.count_if("_bad").alias("bad")).first()
        counts = {"bad_values": row.bad}
        blank_records = 0
        if linked:
            links = link_counts(stage, keymap).first()
            blank_records = links.blank_record_ids
            counts |= {"unknown_entities": links.unknown_entities, "wrong_records": links.wrong_records}
            if name in joins and joins[name].unique_entities:
                counts["repeated_entities"] = repeated_entities(stage).first().repeated_entities
        refuse_any("result table", counts)
        summary[name] = {
            "rows": row.rows,
            "linked": linked,
            "has_record_id": "record_id" in columns,
            "blank_record_ids": blank_records,
            "result_fields": fields,
            "new_categories": {r.field: r.novel for r in novel_categories(stage, fields).collect()},
        }
        plain = stage.select(ROW, *[quoted(n) for n in fields])
        if not linked:
            tables[name] = plain
        elif name in joins:
            tables[name] = join_source(stage, fields, sources, keymap, joins[name], ws)
    ready = all(not s["linked"] or n in joins for n, s in summary.items())
    return ResultReview(summary, ready, tables, table_digests(tables) if ready else {})


def novel_categories(stage: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, novel)``: distinct new labels per result column, zeros left out."""
    cell = [
        F.when(F.col(f"_new{i}"), F.struct(F.lit(n).alias("field"), quoted(n).alias("value")))
        for i, n in enumerate(fields)
    ]
    return (
        stage.select(F.explode(F.array_compact(F.array(*cell))).alias("c"))
        .groupBy("c.field", "c.value").agg(F.lit(1).alias("one"))
        .groupBy("field").agg(F.sum("one").alias("novel"))
    )


def join_source(
    stage: DataFrame, fields: list[str], sources: dict, keymap: KeyMap, j: Join, ws: Workspace
) -> DataFrame:
    """Source columns, then results; every row must find exactly one safe source row."""
    index = source_index(sources[j.source], keymap, j)
    joined = keyed_join(stage, index, j.by, ROW)  # blank record ids may be many, too
    out = ws.keep(joined.select(ROW, "_src", *[quoted(n) for n in fields]), "joined")
    row = out.agg(
        F.count_if(F.col("_src").isNull()).alias("unmatched"),
        F.count_if(any_of([X.has_control(src(n)) for n in j.fields])).alias("controls"),
    ).first()
    refuse_any("result join", row.asDict())
    return out.select(ROW, *[src(n).alias(n) for n in j.fields], *[quoted(n) for n in fields])


def approve_results(
    rev: ResultReview,
    returned: dict[str, DataFrame],
    sources: dict[str, DataFrame],
    keymap: KeyMap,
    ws: Workspace,
    joins: dict[str, Join],
    approved_fields: dict[str, list[str]],
    approved_categories: dict[str, list[str]],
    approved_joins: list[str],
    authorised: bool,
) -> dict[str, DataFrame]:
    """The restored tables, when everything shown was approved and nothing moved since."""
    refuse_if(authorised is not True or not rev.ready, "results are not ready or not authorised")
    same_set(approved_joins, [n for n, s in rev.summary.items() if s["linked"]], "join")
    same_set(list(approved_fields), rev.summary, "result table")
    same_set(list(approved_categories), rev.summary, "result table")
    for name, s in rev.summary.items():
        same_set(approved_fields[name], s["result_fields"], "result field")
        same_set(approved_categories[name], s["new_categories"], "field with new categories")
    fresh = prepare_results(returned, sources, keymap, ws, joins)
    refuse_if(fresh.digests != rev.digests, "a table changed after its review")
    return fresh.tables
