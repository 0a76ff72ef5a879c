"""The private side of a protected set: everything needed to restore it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Refused, refuse_if
from .policy import Limits, Policy, parse_policy, policy_dict

BOOK_SCHEMA = "sheet string, field string, label string, code string"


@dataclass
class KeyMap:
    """Records, entities and codebooks are tables of any size.

    ``records[name]`` is ``(record_id, _row, source_key)`` for one table and
    ``(record_id, _row, entity_id)`` in a related set, with ``entities`` beside it.
    ``book`` is ``(sheet, field, label, code)``.
    """

    policies: dict[str, Policy]
    records: dict[str, DataFrame]
    book: DataFrame
    source_columns: dict[str, list[str]]
    entities: DataFrame | None = None
    shared: tuple[str, ...] = ()
    editable: dict[str, list[str]] | None = None
    regions: dict | None = None
    profile: str = "strict"
    digests: dict[str, str] = field(default_factory=dict)
    export_id: str = field(default_factory=lambda: str(uuid4()))
    limits: Limits = Limits()

    @property
    def related(self) -> bool:
        return self.entities is not None

    @property
    def version(self) -> int:
        """2 one table; 3 related; 4 related with edits; 5 with regions."""
        if not self.related:
            return 2
        return 5 if self.regions is not None else 4 if self.editable is not None else 3

    @property
    def names(self) -> list[str]:
        return list(self.policies)

    def protected_columns(self, name: str) -> list[str]:
        policy = self.policies[name]
        return list(policy.related_columns if self.related else policy.output_columns)

    def book_of(self, name: str) -> DataFrame:
        """``(field, label, code)`` of one table."""
        return self.book.filter(F.col("sheet") == name).select("field", "label", "code")

    def code(self, name: str, field: str, label: str) -> str:
        """The code of one label."""
        found = self.book_of(name).filter((F.col("field") == field) & (F.col("label") == label)).first()
        refuse_if(found is None, "the codebook has no such label")
        return found.code

    def manifest(self) -> dict:
        return {
            "version": self.version,
            "export_id": self.export_id,
            "profile": self.profile,
            "digests": self.digests,
            "shared": list(self.shared),
            "editable": self.editable,
            "regions": self.regions,
            "source_columns": self.source_columns,
            "policies": {n: policy_dict(p) for n, p in self.policies.items()},
        }


def lookup_table(spark: SparkSession, pairs: dict[str, str], key: str, value: str) -> DataFrame:
    """The approved texts of a policy, which limits their bytes, as a broadcast side."""
    return F.broadcast(spark.createDataFrame(list(pairs.items()), f"{key} string, {value} string"))


# --- persistence: private columns are sealed with AES-GCM, bound to the export id ---
def _key(spark: SparkSession, secret: str):
    """The key as a scalar subquery over one row: Spark reads it when it runs, so neither plans nor the event log hold it."""
    raw = secret.encode()
    refuse_if(len(raw) != 32, "the sealing key must have 32 bytes")
    return spark.createDataFrame([(bytearray(raw),)], "sealing_key binary").scalar()


def sealed(df: DataFrame, columns: list[str], secret: str, export_id: str) -> DataFrame:
    key = _key(df.sparkSession, secret)
    fixed = (F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.lit(export_id))
    return df.withColumns({c: F.base64(F.aes_encrypt(F.col(c), key, *fixed)) for c in columns})


def opened(df: DataFrame, columns: list[str], secret: str, export_id: str) -> DataFrame:
    """Sealed columns in clear; a wrong key or foreign export id gives NULL."""
    key = _key(df.sparkSession, secret)
    fixed = (F.lit("GCM"), F.lit("DEFAULT"), F.lit(export_id))
    return df.withColumns({c: F.try_aes_decrypt(F.unbase64(F.col(c)), key, *fixed).cast("string") for c in columns})


def save_key_map(spark: SparkSession, keymap: KeyMap, path: str, secret: str | None = None) -> None:
    """Write the map; the manifest comes last, so a map without one is incomplete."""
    private = "entity_id" if keymap.related else "source_key"
    for i, name in enumerate(keymap.names):
        records = keymap.records[name].select("record_id", "_row", private)
        if secret is not None and not keymap.related:
            records = sealed(records, ["source_key"], secret, keymap.export_id)
        records.write.mode("errorifexists").parquet(f"{path}/records/{i}")
    if keymap.related:
        entities = keymap.entities.select("entity_id", "source_key")
        if secret is not None:
            entities = sealed(entities, ["source_key"], secret, keymap.export_id)
        entities.write.mode("errorifexists").parquet(f"{path}/entities")
    book = keymap.book
    manifest = spark.createDataFrame([(keymap.export_id, json.dumps(keymap.manifest()))], "export_id string, body string")
    if secret is not None:
        book = sealed(book, ["label"], secret, keymap.export_id)
        manifest = sealed(manifest, ["body"], secret, keymap.export_id)
    book.write.mode("errorifexists").parquet(f"{path}/codebook")
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def load_key_map(spark: SparkSession, path: str, secret: str | None = None, limits: Limits = Limits()) -> KeyMap:
    """The map as it was written; ``binding.open_key_map`` also refuses a damaged one."""
    row = spark.read.parquet(f"{path}/manifest").first()
    export_id = row.export_id
    body = row.body
    if secret is not None:
        body = opened(spark.createDataFrame([(body,)], "body string"), ["body"], secret, export_id).first().body
    if body is None:
        raise Refused("the key map could not be authenticated")
    m = json.loads(body)
    policies = {n: parse_policy(p, limits) for n, p in m["policies"].items()}
    records = {}
    related = m["version"] != 2
    for i, name in enumerate(policies):
        df = spark.read.parquet(f"{path}/records/{i}")
        if secret is not None and not related:
            df = opened(df, ["source_key"], secret, export_id)
        records[name] = df
    entities = spark.read.parquet(f"{path}/entities") if related else None
    book = spark.read.parquet(f"{path}/codebook")
    if secret is not None:
        book = opened(book, ["label"], secret, export_id)
        entities = opened(entities, ["source_key"], secret, export_id) if related else None
    return KeyMap(
        policies, records, book, m["source_columns"], entities, tuple(m["shared"]),
        m["editable"], m["regions"], m["profile"], m["digests"], export_id, limits,
    )
