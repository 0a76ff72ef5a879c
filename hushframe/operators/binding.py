"""Binding a key map to its source: digests, map checks, staleness."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import refuse_any, refuse_if
from ..functions import text as X
from ..functions.hashing import framed, lane_sum, sha_lanes
from ..keymap import KeyMap, load_key_map
from ..policy import Limits
from ..sources.rows import ROW
from ..sources.tables import data_columns, heading_ok, quoted
from .joins import DICTIONARY_BYTES, dictionary_bytes
from .protect import bad_key


def digest_sums(df: DataFrame, salt: str = "") -> DataFrame:
    """One row: row count and four sums over salted row hashes.

    Each row hash covers the row number, so order counts; sums need no shuffle of rows.
    The salt is a key map's private export id, which keeps the sums unforgeable.
    """
    cells = [F.lit(salt), F.col(ROW).cast("string"), *[quoted(c) for c in data_columns(df)]]
    lanes = df.select(*[lane.alias(f"s{i}") for i, lane in enumerate(sha_lanes(framed(cells)))])
    return lanes.agg(F.count(F.lit(1)).alias("n_rows"), *[lane_sum(f"s{i}").alias(f"s{i}") for i in range(4)])


def table_digest(df: DataFrame, salt: str = "") -> str:
    """Digest of headings, rows and their order."""
    row = digest_sums(df, salt).first()
    body = json.dumps([data_columns(df), row.n_rows, *[str(row[f"s{i}"]) for i in range(4)]])
    return hashlib.sha256(body.encode()).hexdigest()


def set_digest(digests: dict[str, str]) -> str:
    """Digest of several named tables, in their order."""
    return hashlib.sha256(json.dumps(list(digests.items())).encode()).hexdigest()


def table_digests(tables: dict[str, DataFrame], salt: str = "") -> dict[str, str]:
    return {name: table_digest(df, salt) for name, df in tables.items()}


def bind_source(keymap: KeyMap, sources: dict[str, DataFrame]) -> KeyMap:
    """Record the digests of the sources in the key map."""
    keymap.digests = table_digests(sources, keymap.export_id)
    return keymap


def check_unchanged(keymap: KeyMap, sources: dict[str, DataFrame]) -> None:
    """Refuse when a source is not the one the key map was bound to."""
    refuse_if(set(sources) != set(keymap.policies), "tables do not match the key map")
    for name, df in sources.items():
        refuse_if(
            data_columns(df) != keymap.source_columns[name], "source headings do not match the key map"
        )
        refuse_if(
            table_digest(df, keymap.export_id) != keymap.digests.get(name),
            "the source changed after it was bound",
        )


def map_counts(records: DataFrame, key: str = "source_key") -> DataFrame:
    """One row: entries, malformed ids, repeated ids, unusable keys, repeated keys."""
    k = quoted(key)
    by_id = records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    id_part = by_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.count_if(~X.is_uuid4(F.col("record_id"))).alias("bad_ids"),
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
    )
    by_key = records.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    # what cannot be unsealed opens as NULL
    unusable = F.coalesce(X.is_blank(F.col("k")) | (F.length("k") > X.MAX_FIELD), F.lit(True))
    key_part = by_key.agg(
        F.count_if(unusable).alias("bad_keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
    )
    return id_part.join(F.broadcast(key_part))


def check_map(records: DataFrame, source_column: str) -> None:
    refuse_if(not heading_ok(source_column) or source_column == "record_id", "key map column")
    row = map_counts(records).first()
    refuse_any(
        "key map",
        {"empty": int(row.entries == 0), "bad_ids": row.bad_ids, "repeated_ids": row.repeated_ids,
         "bad_keys": row.bad_keys, "repeated_keys": row.repeated_keys},
    )


def observed_codes(source: DataFrame, stage: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, label, code)`` pairs seen side by side in source and protected rows."""
    labels = source.select(ROW, F.struct(*[quoted(f).alias(f) for f in fields]).alias("src"))
    codes = stage.select(ROW, F.struct(*[quoted(f).alias(f) for f in fields]).alias("got"))
    cells = [
        F.struct(
            F.lit(f).alias("field"),
            F.col("src").getField(f).alias("label"),
            F.col("got").getField(f).alias("code"),
        )
        for f in fields
    ]
    return (
        labels.join(codes, ROW)
        .select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .groupBy("field", "label", "code")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def codebook_counts(book: DataFrame) -> DataFrame:
    """One row over ``(sheet, field, label, code)``: labels with several codes, codes with
    several labels inside a field, malformed codes."""
    pairs = book.select("sheet", "field", "label", "code").distinct()
    per_label = pairs.groupBy("sheet", "field", "label").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("split_labels")
    )
    per_code = pairs.groupBy("sheet", "field", "code").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("merged_codes")
    )
    shape = pairs.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(~X.is_uuid4(F.col("code"))).alias("bad_codes"),
    )
    return shape.join(F.broadcast(per_label)).join(F.broadcast(per_code))


def book_faults(keymap: KeyMap) -> DataFrame:
    """One row of violations of a key map's codebook: codes of the wrong shape, labels with several codes and codes with
    several labels in a heading, labels that a policy doesn't list, codes of more than one owner (a heading of a table, or a
    shared heading), shared labels whose code differs between tables, codes that double as a record or entity id, entries
    with a NULL (what could not be unsealed)."""
    book = keymap.book
    spark = book.sparkSession
    shared = F.col("field").isin(list(keymap.shared))
    owner = F.struct(F.when(~shared, F.col("sheet")).alias("sheet"), "field", "label")
    owners = book.groupBy("code").agg(F.min(owner).alias("a"), F.max(owner).alias("b")).agg(
        F.count_if(F.col("a") != F.col("b")).alias("several_owners")
    )
    between = book.filter(shared).groupBy("field", "label").agg(F.min("code").alias("a"), F.max("code").alias("b")).agg(
        F.count_if(F.col("a") != F.col("b")).alias("unlike_shared")
    )
    listed = [
        (n, c, v) for n, p in keymap.policies.items() for c in p.of_action("code") for v in p.columns[c].domain.values
    ]
    closed = spark.createDataFrame(listed, "sheet string, field string, label string")
    unlisted = book.join(closed.select("sheet", "field").distinct(), ["sheet", "field"], "left_semi").join(
        closed, ["sheet", "field", "label"], "left_anti"
    ).agg(F.count(F.lit(1)).alias("unlisted"))
    every = [df.select(F.col("record_id").alias("code")) for df in keymap.records.values()]
    every += [keymap.entities.select(F.col("entity_id").alias("code"))] if keymap.related else []
    codes = book.select("code").distinct()
    size = sum(dictionary_bytes(book, texts=("code",)).values())
    codes = F.broadcast(codes) if size <= DICTIONARY_BYTES else codes
    clash = reduce(lambda a, b: a.unionByName(b), every).join(codes, "code", "left_semi").agg(
        F.count(F.lit(1)).alias("shared_with_ids")
    )
    lost = book.agg(F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in book.columns])).alias("missing"))
    out = codebook_counts(book).drop("entries")
    for part in (owners, between, unlisted, clash, lost):
        out = out.join(F.broadcast(part))
    return out


def check_codebook(keymap: KeyMap) -> None:
    """Refuse a codebook that lacks a coded column, has one too many, or breaks a rule of ``book_faults``."""
    wanted = {(n, c) for n, p in keymap.policies.items() for c in p.of_action("code")}
    held = {(r.sheet, r.field) for r in keymap.book.select("sheet", "field").distinct().collect()}  # a row for each heading
    refuse_any("codebook", {"columns": len(wanted ^ held)})
    if held:
        refuse_any("codebook", book_faults(keymap).first().asDict())


def related_map_counts(keymap: KeyMap) -> DataFrame:
    """One row of violations over a related key map (see :func:`check_related_map`)."""
    tagged = reduce(
        lambda a, b: a.unionByName(b),
        [
            df.select(F.lit(n).alias("sheet"), "record_id", ROW, "entity_id")
            for n, df in keymap.records.items()
        ],
    )
    ids = tagged.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
        F.count_if(~X.is_uuid4(F.col("record_id"))).alias("bad_ids"),
    )
    # 0..n-1 exactly once each: no row number repeats, none is below 0 or above n-1.
    rows = (
        tagged.groupBy("sheet", ROW).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("sheet")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min(ROW).alias("low"), F.max(ROW).alias("high"))
        .agg(
            F.count_if(
                (F.col("most") > 1) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1)
            ).alias("row_gaps")
        )
    )
    known = keymap.entities.select("entity_id")
    used = tagged.select("entity_id").distinct()
    missing = used.join(known, "entity_id", "left_anti").agg(
        F.count(F.lit(1)).alias("unknown_entities")
    )
    keys = keymap.entities.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.count_if(F.coalesce(bad_key(F.col("source_key")), F.lit(True))).alias("bad_keys"),
    )
    entity_ids = keymap.entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if((F.col("n") > 1) | ~X.is_uuid4(F.col("entity_id"))).alias("bad_entities")
    )
    out = ids
    for part in (rows, missing, keys, entity_ids):
        out = out.join(F.broadcast(part))
    return out


def check_related_map(keymap: KeyMap) -> None:
    refuse_any("related key map", related_map_counts(keymap).first().asDict())
    check_codebook(keymap)


def map_faults(keymap: KeyMap) -> dict[str, int]:
    """Violations of every rule of a key map, by name: its entries, its row numbers, its entities."""
    if keymap.related:
        return related_map_counts(keymap).first().asDict()
    found = {}
    for df in keymap.records.values():
        rows = df.agg(
            (F.count(F.lit(1)) - F.count(ROW)).alias("no_row"), F.min(ROW).alias("low"), F.max(ROW).alias("high"),
            F.count(F.lit(1)).alias("n"),
        ).first()
        found |= map_counts(df).first().asDict()
        found["empty"] = int(found.pop("entries") == 0)
        repeated = df.groupBy(ROW).count().filter("count > 1").count()
        found["row_gaps"] = rows.no_row + repeated + int(rows.n > 0 and (rows.low != 0 or rows.high != rows.n - 1))
    return found


def open_key_map(spark, path: str, secret: str | None = None, limits: Limits = Limits()) -> KeyMap:
    """The map at ``path``, refused unless its records, entities, codebook and editable headings keep every rule."""
    keymap = load_key_map(spark, path, secret, limits)
    refuse_any("key map", map_faults(keymap))
    for name, edits in (keymap.editable or {}).items():
        refuse_if(name not in keymap.policies or not set(edits) <= set(keymap.policies[name].retained), "editable headings")
    check_codebook(keymap)
    return keymap


def identity_counts(source: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """One row: source rows, protected rows, and rows whose private key is not the source's."""
    a = source.select(ROW, quoted(key).alias("k"))
    b = stage.select(ROW, F.col("source_key").alias("p"))
    return a.join(b, ROW, "full_outer").agg(
        F.count("k").alias("source_rows"),
        F.count("p").alias("protected_rows"),
        F.count_if(~F.col("k").eqNullSafe(F.col("p"))).alias("mismatches"),
    )


def check_identity(source: DataFrame, stage: DataFrame, key: str) -> None:
    row = identity_counts(source, stage, key).first()
    refuse_any("protected records do not match the source", {"mismatches": row.mismatches})
