"""Publishing: the private map first, the shared table last, nothing overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import Refused, refuse_if
from ..keymap import KeyMap, save_key_map
from ..operators.binding import check_codebook, check_identity, check_related_map, check_unchanged
from ..operators.protect import Protected
from ..operators.risk import assess, assess_related
from ..policy import Policy
from ..sources.rows import ROW
from ..sources.tables import CSV, data_columns, quoted


def exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(target))


def write_table(df: DataFrame, columns: list[str], path: str, fmt: str = "parquet") -> None:
    """Write exactly the given columns, all text, into a new directory."""
    refuse_if(set(data_columns(df)) != set(columns), "columns do not match the output")
    out = df.select(*[quoted(c) for c in columns])
    refuse_if(any(f.dataType.simpleString() != "string" for f in out.schema), "non-text output")
    writer = out.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.options(**CSV)
    writer.format(fmt).save(path)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One directory per table."""
    refuse_if(any("/" in n or n.startswith((".", "_")) for n in tables), "table names")
    for name, df in tables.items():
        write_table(df.drop(ROW), data_columns(df), f"{folder}/{name}", fmt)


def separate(data: str, private: str) -> None:
    """The private map and the shared data may not contain each other."""
    a, b = data.rstrip("/") + "/", private.rstrip("/") + "/"
    refuse_if(a.startswith(b) or b.startswith(a), "map and data need different folders")
    refuse_if(a.rsplit("/", 2)[0] == b.rsplit("/", 2)[0], "map and data need different folders")


def publish(
    spark,
    protected: Protected,
    sources: dict[str, DataFrame],
    data_path: str,
    map_path: str,
    approved: bool,
    secret: str | None = None,
    fmt: str = "parquet",
) -> None:
    """Re-validate, re-check the source, write the map, then the data."""
    refuse_if(approved is not True, "publishing needs explicit approval")
    separate(data_path, map_path)
    refuse_if(exists(spark, data_path) or exists(spark, map_path), "a target already exists")
    keymap: KeyMap = protected.keymap
    check_unchanged(keymap, sources)
    if keymap.related:
        assess_related(protected.tables, keymap).refuse()
        check_related_map(keymap)
    else:
        for name, df in protected.tables.items():
            policy: Policy = keymap.policies[name]
            assess(df, policy, keymap.profile, name).refuse()
            check_identity(sources[name], protected.stages[name], policy.source_key)
        check_codebook(keymap)
    save_key_map(spark, keymap, map_path, secret)
    if not exists(spark, f"{map_path}/manifest/_SUCCESS"):
        raise Refused("the private map is incomplete; no data was written")
    write_tables(protected.tables, data_path, fmt)
