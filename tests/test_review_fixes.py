"""Cases in which an earlier version gave wrong answers."""

import hashlib
import re
from decimal import Decimal

from pyspark.sql import functions as F

from hushframe.functions import numbers as N
from hushframe.functions.numbers import bin_label
from hushframe.operators import redact as D
from hushframe.operators.binding import digest_sums
from hushframe.operators.risk import class_counts
from hushframe.sinks.publish import write_table
from hushframe.sources import load_table
from hushframe.sources.rows import ROW
from hushframe.sources.tables import as_text


def test_null_cells_are_classes_of_their_own(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", ""), ("", "a"), (None, None)], "x string, y string")
    row = class_counts(df, ["x", "y"], 2).first()
    assert row["members"] == 5 and row["minimum_size"] == 1


def test_exponent_numbers_in_bins(spark):
    bins = tuple((Decimal(a), Decimal(b)) for a, b in (("-1", "0"), ("0", "1"), ("1", "1e30")))
    want = {"1e25": "c", "-1e-20": "a", "1.25e1": "c", "12.5e-2": "b", "5E-1": "b", "1e31": None, "0e5": "b", "1e-99999999999": "b", "-.5e0": "a", "+3.e0": "c"}
    df = spark.createDataFrame([(x,) for x in want], "x string")
    got = {r[0]: r[1] for r in df.select("x", bin_label(F.col("x"), bins, ("a", "b", "c"))).collect()}
    assert got == want


def test_csv_round_trip(spark, ws, table, tmp_path):
    rows = [("1", 'says "hi", then\nleaves'), ("2", ""), ("3", " blank \\ slash\\"), ("4", '"'), ("5", "é\n\n\tx")]
    write_table(table(["k", "t"], rows).drop(ROW), ["k", "t"], str(tmp_path / "out"), "csv")
    back = load_table(spark, str(tmp_path / "out"), ws, fmt="csv")
    assert sorted((r["k"], r["t"]) for r in back.collect()) == rows
    assert sorted(r[ROW] for r in back.collect()) == sorted(set(r[ROW] for r in back.collect()))


def test_a_busy_document_is_redacted(spark, ws):
    text = " ".join(f"user{i}@mail{i}.org" for i in range(65))
    df = spark.createDataFrame([("1", text), ("2", "nobody")], "doc string, text string")
    done = D.redact(D.whole_texts(df, "doc", "text"), ws)
    assert done.replacements.count() == 65
    assert not [r for r in done.runs.collect() if "@" in str(r)]


def test_every_hint_is_offered(spark):
    paras = spark.createDataFrame([("1", "body", i, "Department of things " + "x" * 300) for i in range(40)], "doc_id string, part string, para int, text string")
    offered = D.suggestions(paras)
    assert offered.count() == 40 and offered.filter(F.length("excerpt") > 300).count() == 40
    assert D.suggestions(paras, limit=3, excerpt=5).count() == 3


def test_the_code_of_a_table_with_several_doubles_is_compiled(spark, capsys):
    """The JVM leaves a method of over 8,000 bytes of bytecode interpreted."""
    kinds = {f"d{i}": "double" for i in range(8)} | {"at": "timestamp", "k": "long"}
    raw = spark.range(4).select(*[F.col("id").cast(k).alias(n) for n, k in kinds.items()])
    as_text(raw).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert max(sizes, default=0) < 8000


def test_canonical_numbers_by_decimal_and_by_text(spark):
    values = ["", "0", "000.0", "01.50", "23.0", "100", "1.", ".5", "-1", "1e3", "9" * 20, "0" * 30 + "7.10", "10.0", "10.01", "10." + "0" * 30 + "1", "5.0\n"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    got = df.select("i", N.canonical_numeric(F.col("c"), (Decimal(0), Decimal(10))).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == ["", "0", "0", "1.5", None, None, None, None, None, None, None, "7.1", "10", None, None, None]


def test_digest_sums_are_those_of_the_rows_hashes(spark, table):
    rows = [("a", ""), ("é:1", "-"), ("", "9" * 50)]
    want = [0] * 4
    for i, cells in enumerate(rows):
        framed = "".join(f"{len(c)}:{c}" for c in ("salt", str(i), *cells))
        hexed = hashlib.sha256(framed.encode()).hexdigest()
        want = [w + int(hexed[15 * k : 15 * k + 15], 16) for k, w in enumerate(want)]
    df = table(["x", "y"], rows)
    assert [int(v) for v in digest_sums(df, "salt").first()] == [3, *want]
    assert [int(v) for v in digest_sums(df.limit(0), "salt").first()] == [0] * 5
