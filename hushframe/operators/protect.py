"""Protect: one scan of the source, one written stage, everything else reads the stage.

The stage holds the row number, the private key, the random ids and the protected
values (NULL where a value breaks its rule). All gates are counted on it; the key map
and the protected table are two column-pruned views of it, so nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import refuse_any, refuse_if
from ..functions import ids
from ..functions import numbers as N
from ..functions import text as X
from ..keymap import BOOK_SCHEMA, KeyMap, lookup_table
from ..policy import Limits, Policy, Rule, shared_fields, with_domains
from ..sources.rows import ROW
from ..sources.tables import RESERVED, data_columns, quoted
from ..workspace import Workspace, small_side
from .joins import dictionary_bytes, keyed_join, looked_up
from .textreview import check_review_source

Getter = Callable[[str], Column]


@dataclass
class Protected:
    tables: dict[str, DataFrame]
    stages: dict[str, DataFrame]
    keymap: KeyMap

    @property
    def table(self) -> DataFrame:
        (only,) = self.tables.values()
        return only

    @property
    def candidate_ids(self) -> dict[str, DataFrame]:
        return {n: s.select("record_id") for n, s in self.stages.items()}


def simple_value(rule: Rule, c: Column) -> Column:
    """Protected value of the rules needing no lookup; NULL where refused."""
    if rule.action == "keep":
        return F.when(c.isin(list(rule.domain.values)), c)
    if rule.action == "keep_numeric":
        return N.canonical_numeric(c, rule.domain.bounds, rule.domain.places)
    return N.bin_label(c, rule.domain.pairs, rule.domain.labels)


def protected_values(
    df: DataFrame,
    policy: Policy,
    book: DataFrame,
    get: Getter = quoted,
    reviews: dict[str, DataFrame] | None = None,
) -> tuple[DataFrame, dict[str, Column]]:
    """(``df`` with lookups attached, protected value per retained column).

    ``book`` is the table's ``(field, label, code)``: dictionaries are sent around while they
    are small and joined by label otherwise. Review maps of a policy are small; a review
    *table* of any size joins on the digest. Hot labels and texts are spread.
    """
    values: dict[str, Column] = {}
    spark = df.sparkSession
    sizes = dictionary_bytes(book) if policy.of_action("code") else {}
    for i, name in enumerate(policy.retained):
        rule = policy.columns[name]
        if rule.action == "code":
            side = book.filter(F.col("field") == name).select(F.col("label").alias(f"_l{i}"), F.col("code").alias(f"_c{i}"))
            df = looked_up(df, get(name), side, f"_l{i}", sizes.get(name, 0))
            values[name] = F.col(f"_c{i}")
        elif rule.domain.from_table:
            refuse_if(name not in (reviews or {}), "a review table is missing")
            side = reviews[name].select(
                F.col("digest").alias(f"_d{i}"), F.col("approved").alias(f"_c{i}")
            )
            df = keyed_join(df.withColumn(f"_d{i}", X.digest(get(name))), side, f"_d{i}", ROW)
            values[name] = F.col(f"_c{i}")
        elif rule.action == "review_text":
            side = lookup_table(spark, dict(rule.domain.approved), f"_d{i}", f"_c{i}")
            df = df.join(side, X.digest(get(name)) == F.col(f"_d{i}"), "left")
            values[name] = F.col(f"_c{i}")
        else:
            values[name] = simple_value(rule, get(name))
    return df, values


def check_schema(df: DataFrame, policy: Policy, reserved: tuple[str, ...] = ("record_id",)) -> None:
    names = data_columns(df)
    refuse_if(
        len(names) != len(set(names)) or set(names) != set(policy.columns),
        "source schema differs from policy",
    )
    refuse_if(bool(set(names) & set(reserved)), "source uses a reserved heading")
    refuse_if(ROW not in df.columns, "source rows are not numbered")


def bad_key(c: Column) -> Column:
    return X.is_blank(c) | X.formula_or_control(c)


def gate_counts(stage: DataFrame, policy: Policy, key: str = "source_key") -> DataFrame:
    """One row of violation counts and, per column of kept categories, the observed ones
    (at most as many as the policy lists)."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(bad_key(F.col(key))).alias("bad_keys")]
    for i, name in enumerate(policy.retained):
        c = quoted(name)
        aggs.append(F.count_if(c.isNull()).alias(f"bad{i}"))
        if policy.columns[name].action == "keep":
            aggs.append(F.collect_set(c).alias(f"seen{i}"))
    return stage.agg(*aggs)


def _gate(stage: DataFrame, policy: Policy) -> dict[str, set[str]]:
    row = gate_counts(stage, policy).first()
    refuse_if(row.n_rows == 0, "empty table")
    counts = {"bad_keys": row.bad_keys}
    for i, name in enumerate(policy.retained):
        label = {"keep": "category", "code": "category", "keep_numeric": "number", "bin": "bin"}
        kind = label.get(policy.columns[name].action, "review")
        counts[kind] = counts.get(kind, 0) + row[f"bad{i}"]
    refuse_any("source values violate the policy", counts)
    return {
        name: set(row[f"seen{i}"])
        for i, name in enumerate(policy.retained)
        if policy.columns[name].action == "keep"
    }


def repeated_keys(df: DataFrame, key: str = "source_key") -> DataFrame:
    """One row: how many keys occur more than once (partial counts, no row gathered)."""
    return (
        df.groupBy(quoted(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    )


def draw_book(
    sources: dict[str, DataFrame], policies: dict[str, Policy], ws: Workspace, shared: tuple[str, ...] = ()
) -> DataFrame:
    """``(sheet, field, label, code)``: a fresh code for every allowed label of every coded column, drawn in the
    tasks and written once. Labels are those that a policy lists, or all safe ones of the source. A shared
    heading has one code for a label, whatever table it stands in."""
    spark = ws.spark
    listed, parts = [], []
    for name, policy in policies.items():
        for heading in policy.of_action("code"):
            if policy.columns[heading].domain.from_table:
                label = quoted(heading)
                own = sources[name].filter(X.safe_category(label)).select(label.alias("label")).distinct()
                parts.append(own.select(F.lit(name).alias("sheet"), F.lit(heading).alias("field"), "label"))
            else:
                listed += [(name, heading, v) for v in policy.columns[heading].domain.values]
    parts.append(spark.createDataFrame(listed, "sheet string, field string, label string"))
    labels = reduce(lambda a, b: a.unionByName(b), parts)
    owner = F.when(~F.col("field").isin(list(shared)), F.col("sheet"))
    drawn = labels.groupBy(owner.alias("owner"), "field", "label").agg(F.collect_set("sheet").alias("sheets"))
    drawn = ws.keep(drawn.withColumn("code", ids.random_id(F.col("label"))), "drawn")
    return drawn.select(F.explode("sheets").alias("sheet"), "field", "label", "code")


def _observed(
    policies: dict[str, Policy], stages: dict[str, DataFrame], book: DataFrame, seen: dict[str, dict[str, set[str]]], ws: Workspace
) -> tuple[DataFrame, dict[str, dict[str, list[str]]]]:
    """(book cut to observed codes, observed labels per column that a policy lists labels for)."""
    used = []
    for name, policy in policies.items():
        coded = policy.of_action("code")
        if coded:
            cells = [F.struct(F.lit(n).alias("field"), quoted(n).alias("code")) for n in coded]
            pairs = stages[name].select(F.explode(F.array(*cells)).alias("c")).select("c.*").distinct()
            used.append(pairs.withColumn("sheet", F.lit(name)))
    if not used:
        return ws.spark.createDataFrame([], BOOK_SCHEMA), seen
    pairs = reduce(lambda a, b: a.unionByName(b), used)
    kept = ws.keep(book.join(pairs, ["sheet", "field", "code"], "left_semi").select("sheet", "field", "label", "code"), "book")
    from_source = [(n, c) for n, p in policies.items() for c in p.of_action("code") if p.columns[c].domain.from_table]
    labels = {n: dict(found) for n, found in seen.items()}
    several = kept.filter(~any_pair(from_source)) if from_source else kept
    for r in several.select("sheet", "field", "label").collect():  # as many as the policies list
        labels.setdefault(r.sheet, {}).setdefault(r.field, []).append(r.label)
    return kept, {n: {c: list(v) for c, v in found.items()} for n, found in labels.items()}


def any_pair(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("sheet") == s) & (F.col("field") == f) for s, f in pairs])


def protect(
    source: DataFrame,
    policy: Policy,
    ws: Workspace,
    name: str = "table",
    profile: str = "strict",
    reviews: dict[str, DataFrame] | None = None,
    limits: Limits = Limits(),
) -> Protected:
    """Protect one table: unique keys, a random record id per row, codes per column."""
    check_schema(source, policy)
    check_review_source(source, policy, reviews)
    book = draw_book({name: source}, {name: policy}, ws)
    df, values = protected_values(source, policy, book.drop("sheet"), reviews=reviews)
    staged = df.select(
        ROW,
        quoted(policy.source_key).alias("source_key"),
        *[values[n].alias(n) for n in policy.retained],
    ).withColumn("record_id", ids.random_id(F.col(ROW)))
    stage = ws.keep(staged, "stage")
    seen = _gate(stage, policy)
    refuse_any("source keys", {"repeated": repeated_keys(stage).first().repeated_keys})
    kept, labels = _observed({name: policy}, {name: stage}, book, {name: seen}, ws)
    keymap = KeyMap(
        {name: with_domains(policy, labels[name], limits)},
        {name: stage.select("record_id", ROW, "source_key")},
        kept,
        {name: data_columns(source)},
        profile=profile,
        limits=limits,
    )
    table = stage.select(*[quoted(c) for c in policy.output_columns])
    return Protected({name: table}, {name: stage}, keymap)


def draw_entities(keys: list[DataFrame], ws: Workspace) -> DataFrame:
    """``(source_key, n, entity_id)``: one random id per distinct key over all tables.

    Only key columns are read; repeats collapse map-side before the shuffle.
    """
    everyone = reduce(lambda a, b: a.unionByName(b), keys)
    distinct = everyone.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    return ws.keep(distinct.withColumn("entity_id", ids.random_id(F.col("n"))), "entities")


def protect_related(
    sources: dict[str, DataFrame],
    policies: dict[str, Policy],
    ws: Workspace,
    shared: tuple[str, ...] = (),
    profile: str = "strict",
    editable: dict[str, list[str]] | None = None,
    limits: Limits = Limits(),
) -> Protected:
    """Protect tables that share people: keys may repeat, one entity id per person."""
    refuse_if(not sources or set(sources) != set(policies), "every table needs a policy")
    shared_fields(policies, shared)
    for name, source in sources.items():
        check_schema(source, policies[name], RESERVED)
        check_review_source(source, policies[name])
    entities = draw_entities(
        [s.select(quoted(policies[n].source_key).alias("source_key")) for n, s in sources.items()],
        ws,
    )
    bad = entities.agg(F.count_if(bad_key(F.col("source_key"))).alias("bad")).first().bad
    refuse_any("source keys", {"blank_or_unsafe": bad})
    n_entities = entities.count()

    book = draw_book(sources, policies, ws, shared)
    stages, tables, records, seen = {}, {}, {}, {}
    for name, source in sources.items():
        policy = policies[name]
        own = book.filter(F.col("sheet") == name).drop("sheet")
        df, values = protected_values(source, policy, own)
        flat = df.select(
            ROW,
            quoted(policy.source_key).alias("source_key"),
            *[values[n].alias(n) for n in policy.retained],
        )
        right = entities.select("source_key", "entity_id")
        if n_entities <= 200_000:
            linked = flat.join(small_side(right, n_entities), "source_key", "left")
        else:
            linked = keyed_join(flat, right, "source_key", ROW, counts=entities)
        stage = ws.keep(linked.withColumn("record_id", ids.random_id(F.col(ROW))), "stage")
        seen[name] = _gate(stage, policy)
        stages[name] = stage
        records[name] = stage.select("record_id", ROW, "entity_id")
        tables[name] = stage.select(*[quoted(c) for c in policy.related_columns])
    kept, labels = _observed(policies, stages, book, seen, ws)
    keymap = KeyMap(
        {n: with_domains(p, labels.get(n, {}), limits) for n, p in policies.items()},
        records,
        kept,
        {n: data_columns(s) for n, s in sources.items()},
        entities=entities.select("entity_id", "source_key"),
        shared=tuple(shared),
        editable=editable,
        profile=profile,
        limits=limits,
    )
    return Protected(tables, stages, keymap)
