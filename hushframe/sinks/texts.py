"""Publishing redacted texts: the private record first, the texts next, the manifest that makes them visible last."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import refuse_any, refuse_if
from ..keymap import opened, sealed
from ..operators.binding import table_digest
from ..operators.redact import Redacted, check_review_digest, replacement_counts, replacement_totals, restore_counts, restore_texts
from .publish import exists, separate

RECORD = ["doc_id", "at", "token", "original", "kind", "count"]
PLACE = ["doc_id", "part", "para", "run", "text"]


def texts_digest(runs: DataFrame) -> tuple[int, int, str]:
    """(runs, characters, digest) whatever their order: sums of 64-bit pieces of each run's SHA-256, built before the shuffle."""
    framed = F.to_json(F.struct(*PLACE), {"ignoreNullFields": "false"})
    whole = F.sha2(framed, 256)
    pieces = [F.conv(F.substring(whole, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    row = runs.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0)), *[F.coalesce(F.sum(p), F.lit(0)) for p in pieces]
    ).first()
    return row[0], row[1], "-".join(str(x) for x in row[2:])


def _manifest(spark: SparkSession, export_id: str, numbers: dict, path: str) -> None:
    rows = [(export_id, name, str(value)) for name, value in numbers.items()]
    spark.createDataFrame(rows, "export_id string, name string, value string").coalesce(1).write.mode("errorifexists").parquet(path)


def _opened_manifest(spark: SparkSession, path: str, what: str) -> tuple[str, dict[str, str]]:
    refuse_if(not exists(spark, f"{path}/_SUCCESS"), f"{what} without a manifest")
    rows = spark.read.parquet(path).collect()  # a few numbers
    return rows[0].export_id, {r.name: r.value for r in rows}


def publish_texts(
    spark: SparkSession,
    redacted: Redacted,
    source: DataFrame,
    reviewed: str,
    texts_path: str,
    record_path: str,
    approved: bool,
    secret: str | None = None,
) -> str:
    """Write a redacted corpus; returns its export id. ``source`` must have the digest that was ``reviewed``.

    The replacement record goes first (originals sealed if a secret is given), then its manifest, then the texts, and at last
    their manifest. A run that is cut leaves texts without a manifest, which ``open_texts`` refuses, and a record that
    restores nothing. Nothing is overwritten. A corpus without replacements has an empty record."""
    refuse_if(approved is not True, "publishing needs explicit approval")
    separate(texts_path, record_path)
    refuse_if(exists(spark, texts_path) or exists(spark, record_path), "a target already exists")
    check_review_digest(reviewed, table_digest(source))
    refuse_any("replacement record", replacement_counts(redacted.replacements).first().asDict())
    texts = redacted.runs.select(*PLACE)
    if redacted.attributes is None and redacted.links is None:  # counts of the record cover these as well
        refuse_any("tokens were not preserved", restore_counts(texts.select("doc_id", "text"), redacted.replacements).first().asDict())
    export_id = str(uuid4())
    record = redacted.replacements.select(*RECORD)
    if secret is not None:
        record = sealed(record, ["original"], secret, export_id)
    record.write.mode("errorifexists").parquet(f"{record_path}/replacements")
    totals = replacement_totals(redacted.replacements).first().asDict()
    _manifest(spark, export_id, totals, f"{record_path}/manifest")
    for name, df in (("attributes", redacted.attributes), ("links", redacted.links)):
        if df is not None:
            df.write.mode("errorifexists").parquet(f"{texts_path}/{name}")
    texts.write.mode("errorifexists").parquet(f"{texts_path}/runs")
    n_runs, n_chars, digest = texts_digest(spark.read.parquet(f"{texts_path}/runs"))
    refuse_if((n_runs, n_chars, digest) != texts_digest(texts), "the texts were not written as they are")
    _manifest(spark, export_id, {"runs": n_runs, "characters": n_chars, "digest": digest}, f"{texts_path}/manifest")
    return export_id


def open_texts(spark: SparkSession, texts_path: str) -> tuple[str, DataFrame]:
    """(export id, runs) of a published corpus; one without a manifest, or with other runs than it states, is refused."""
    export_id, stated = _opened_manifest(spark, f"{texts_path}/manifest", "texts")
    runs = spark.read.parquet(f"{texts_path}/runs").select(*PLACE)
    n_runs, n_chars, digest = texts_digest(runs)
    refuse_if([str(n_runs), str(n_chars), digest] != [stated["runs"], stated["characters"], stated["digest"]], "texts differ from their manifest")
    return export_id, runs


def open_record(spark: SparkSession, record_path: str, secret: str | None = None) -> tuple[str, DataFrame]:
    """(export id, replacements) of a published corpus; a damaged record, or another key, is refused."""
    export_id, stated = _opened_manifest(spark, f"{record_path}/manifest", "a replacement record")
    record = spark.read.parquet(f"{record_path}/replacements").select(*RECORD)
    if secret is not None:
        record = opened(record, ["original"], secret, export_id)
    refuse_any("the replacement record could not be opened", {"originals": record.filter(F.col("original").isNull()).count()})
    totals = {k: str(v) for k, v in replacement_totals(record).first().asDict().items()}
    refuse_if(totals != stated, "the replacement record differs from its manifest")
    refuse_any("replacement record", replacement_counts(record).first().asDict())
    return export_id, record


def restore_published(
    spark: SparkSession, texts_path: str, record_path: str, secret: str | None = None, returned: DataFrame | None = None
) -> DataFrame:
    """The runs of a published corpus, or the ``returned`` ones, with their originals. Texts and record must belong together;
    every token must be there as often as recorded."""
    export_id, runs = open_texts(spark, texts_path)
    other, record = open_record(spark, record_path, secret)
    refuse_if(export_id != other, "texts and replacement record do not belong together")
    sides = exists(spark, f"{texts_path}/attributes") or exists(spark, f"{texts_path}/links")
    return restore_texts(runs if returned is None else returned, record, check=not sides)
