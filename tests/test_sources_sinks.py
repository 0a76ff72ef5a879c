import base64
import dataclasses
import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import books, ordered
from hushframe.errors import Refused
from hushframe.keymap import load_key_map, opened, save_key_map, sealed
from hushframe.operators import binding as B
from hushframe.operators.joins import keyed_join
from hushframe.operators.protect import protect
from hushframe.plans import registry
from hushframe.policy import PolicyBuilder
from hushframe.sinks.publish import publish, separate, write_table, write_tables
from hushframe.sources import regions as G
from hushframe.sources import tables as T
from hushframe.sources.rows import with_row_number
from hushframe.workspace import Workspace

CELLS = "book string, sheet string, row int, col int, kind string, text string"


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="hush-test-")


def test_text_typed_scan(spark):
    df = spark.createDataFrame(
        [(1, 2.5, "x", datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.date(2024, 1, 2)),
         (None, 1e7, None, datetime.datetime(2024, 1, 2, 3, 4, 5, 60), None)],
        "a int, b double, c string, d timestamp, e date",
    )
    assert [tuple(r) for r in T.as_text(df).collect()] == [
        ("1", "2.5", "x", "2024-01-02T03:04:05", "2024-01-02"), ("", "10000000.0", "", "2024-01-02T03:04:05.000060", "")]
    assert T.as_text(df.select("b"), places={"b": 2}).first().b == "2.50"
    assert T.conversion_counters(df).first().date_cells == 3
    for bad in (df.select("d"), df.select((F.col("a") > 0).alias("x"))):
        with pytest.raises(Refused):
            T.as_text(bad, dates=False)


def test_row_numbers_follow_files_and_blocks(spark, ws, folder):
    spark.range(1000).repartition(7).sortWithinPartitions("id").write.parquet(f"{folder}/p")
    df = T.load_table(spark, f"{folder}/p", ws)
    row = df.agg(F.min("_row").alias("lo"), F.max("_row").alias("hi"), F.count_distinct("_row").alias("n")).first()
    assert tuple(row) == (0, 999, 1000)
    spark.range(0, 500, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("").alias("b")).write.option("header", True).csv(f"{folder}/c")
    csv = T.load_table(spark, f"{folder}/c", ws, fmt="csv")
    assert ordered(csv) == [(str(i), "") for i in range(500)]
    sorted_df = with_row_number(spark.range(100).select((-F.col("id")).cast("string").alias("v")), ws, ["v"])
    assert [r[0] for r in ordered(sorted_df)] == sorted(str(-i) for i in range(100))


def test_append_and_headings(table):
    a, b = table(["x", "y"], [("1", "2")]), table(["y", "x"], [("4", "3")])
    assert ordered(T.append_tables([a, b], allow_reordered=True)) == [("1", "2"), ("3", "4")]
    with pytest.raises(Refused):
        T.append_tables([a, b])
    for bad in (["", "a"], ["a", "a"], ["a\x07"], ["x" * 4097], []):
        with pytest.raises(Refused):
            T.check_headings(bad)
    T.check_headings(["line\nbreak", "tab\t"])


def test_row_shape_and_unsafe_cells(table):
    T.check_row_shape(table(["a", "b"], [("", "x")]))
    for bad in ([("", "")], [("x" * 4097, "")], [("a\x00", "b")]):
        with pytest.raises(Refused):
            T.check_row_shape(table(["a", "b"], bad))
    total, first = T.unsafe_cells(table(["a", "b"], [("ok", "x\ty"), ("\x7f", "\n")] + [("\x01", "")] * 30), first=20)
    assert total.first().cells == 33
    got = [(r._row, r.column) for r in first.collect()]
    assert len(got) == 20 and got[:3] == [(0, "b"), (1, "a"), (1, "b")]


def test_cell_counters_and_listing(spark, folder):
    cells = spark.createDataFrame([("b", "s", 1, 1, "formula", "1"), ("b", "s", 1, 2, "formula", None), ("b", "s", 1, 3, "date", "x")], CELLS)
    assert tuple(T.cell_counters(cells).first()) == (1, 1, 1)
    for name in ("x", "y"):
        spark.range(1).write.parquet(f"{folder}/{name}")
    found = T.list_tables(spark, folder)
    assert found == ["x", "y"] and T.extra_tables(found, ["x"]) == ["y"]
    with pytest.raises(Refused):
        T.extra_tables(found, ["z"])


def research(spark):
    def block(col, row, header, rows):
        out = []
        for r, line in enumerate([header, *rows]):
            out += [("b", "Research", row + r, col + c, "text", v) for c, v in enumerate(line)]
        return out

    cells = [("b", "Research", 1, 1, "text", "Title"), ("b", "Research", 8, 1, "text", "note")]
    cells += block(1, 3, ["Person", "Group"], [["Synthetic A", "North"], ["Synthetic B", "South"]])
    cells += block(4, 3, ["Person", "Score"], [["Synthetic A", "5"], ["Synthetic B", "6"]])
    return spark.createDataFrame(cells, CELLS)


def test_regions(spark):
    cells = research(spark)
    got = [(r.range, r.header_row, r.kind) for r in G.discover_regions(cells).collect()]
    assert got == [("A3:E5", 3, "plain_range")]
    declared = spark.createDataFrame([("b", "Research", 1, 3, 2, 5)], "book string, sheet string, left int, top int, right int, bottom int")
    got = sorted((r.range, r.kind) for r in G.discover_regions(cells, declared).collect())
    assert got == [("A3:B5", "declared_table"), ("D3:E5", "plain_range")]
    tables = G.read_regions(cells, "b", {"Groups": ("Research", "A3:B5"), "Scores": ("Research", "D3:E5")})
    assert ordered(tables["Groups"]) == [("Synthetic A", "North"), ("Synthetic B", "South")]
    assert ordered(tables["Scores"]) == [("Synthetic A", "5"), ("Synthetic B", "6")]
    assert ordered(G.read_region(cells, "b", "Research", (1, 3, 2, 5), totals_row=True)) == [("Synthetic A", "North")]
    for bad in ({"A": ("Research", "A3:B5"), "B": ("Research", "B3:E5")}, {"A": ("Research", "A1:B5")}, {"A": ("Research", "B5:A3")},
                {"A": ("Research", "a3:b5")}, {"A" * 32: ("Research", "A3:B5")}, {"A": ("Research", "A3:A9")}, {}):
        with pytest.raises(Refused):
            G.read_regions(cells, "b", bad)
    with pytest.raises(Refused):
        G.check_selection({"A": ("Research", "A3:B4")}, [("Research", (1, 3, 2, 5))])


def test_islands_cross_blocks(spark):
    b = G.BLOCK
    rows = [*range(1, 4), *range(b - 3, b + 5), *range(b + 10, b + 12), *range(2 * b - 1, 3 * b + 2)]
    df = spark.createDataFrame([("b", "s", r, 1, 2) for r in rows], "book string, sheet string, row int, left int, right int")
    got = sorted((r.top, r.bottom) for r in G.row_islands(df).collect())
    assert got == [(1, 3), (b - 3, b + 4), (b + 10, b + 11), (2 * b - 1, 3 * b + 1)]


def test_wide_regions_are_found(spark):
    cells = spark.createDataFrame([("b", "s", r, c, "text", "x") for r in (1, 2) for c in range(1, 130)], "book string, sheet string, row int, col int, kind string, text string")
    assert [(r.left, r.right) for r in G.discover_regions(cells).collect()] == [(1, 129)]
    assert G.discover_regions(cells, max_width=128).isEmpty()


def test_overlaps_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for book, n, most in (("many", 900, 30), ("few", 5, 300)):
        for i in range(n):
            left, top = rnd.randrange(1, 500), rnd.randrange(1, 90_000)
            rows.append((book, f"n{i:03d}", f"s{i % 2}", left, top, left + rnd.randrange(most), top + rnd.randrange(most * 40)))
    rows.append(("many", "whole", "s0", 1, 1, 16_384, 1_048_576))  # one that covers its sheet
    df = spark.createDataFrame(rows, "book string, name string, sheet string, left int, top int, right int, bottom int")
    want = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0] and a[2] == b[2] and G.overlap(a[3:], b[3:]):
                want[a[0]] = want.get(a[0], 0) + 1
    assert {r.book: r.overlapping_pairs for r in G.overlapping(df).collect()} == want and want["many"] > 300


def test_selection_verdicts_and_letters(spark):
    rows = [("x", "a", "s", 1, 1, 2, 2), ("x", "b", "s", 2, 2, 3, 3), ("x", "c", "t", 2, 2, 3, 3), ("y", "a", "s", 1, 1, 1, 1)]
    rows += [("z", f"n{i:03d}", "s", 1, 1 + 3 * i, 2, 2 + 3 * i) for i in range(129)]
    df = spark.createDataFrame(rows, "book string, name string, sheet string, left int, top int, right int, bottom int")
    got = {r.book: (r.regions, r.overlapping_pairs, r.valid) for r in G.selection_verdicts(df).collect()}
    assert got["x"] == (3, 1, False) and got["y"] == (1, 0, True) and got["z"] == (129, 0, True)
    capped = {r.book: r.valid for r in G.selection_verdicts(df, max_regions=128, max_width=2).collect()}
    assert capped == {"x": False, "y": True, "z": False}
    cols = spark.createDataFrame([(1,), (26,), (27,), (52,), (702,), (703,), (18278,)], "c int").select(G.column_letters(F.col("c")))
    assert [r[0] for r in cols.collect()] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]


@pytest.mark.parametrize("secret", [None, "k" * 32])
def test_publish_map_first_and_restore_it(spark, ws, table, folder, secret):
    source = table(["id", "team"], [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")])
    p = protect(source, PolicyBuilder().key("id").code("team", ["x", "y"]).build(), ws)
    B.bind_source(p.keymap, {"table": source})
    with pytest.raises(Refused):
        publish(spark, p, {"table": source}, f"{folder}/d/data", f"{folder}/m/map", approved=False)
    publish(spark, p, {"table": source}, f"{folder}/d/data", f"{folder}/m/map", approved=True, secret=secret)
    back = load_key_map(spark, f"{folder}/m/map", secret)
    assert back.policies == p.keymap.policies and books(back) == books(p.keymap) and back.digests == p.keymap.digests
    assert {r.source_key for r in back.records["table"].collect()} == {"a", "b", "c", "d"}
    raw = spark.read.parquet(f"{folder}/m/map/records/0").first().source_key
    assert (raw in "abcd") == (secret is None)
    with pytest.raises(Refused):
        publish(spark, p, {"table": source}, f"{folder}/d/data", f"{folder}/m/map2", approved=True)
    if secret:
        with pytest.raises(Refused):
            load_key_map(spark, f"{folder}/m/map", "z" * 32)
    changed = table(["id", "team"], [("a", "x"), ("b", "x"), ("c", "y"), ("d", "x")])
    with pytest.raises(Refused):
        publish(spark, p, {"table": changed}, f"{folder}/d/data3", f"{folder}/m/map3", approved=True)


def test_the_sealing_key_is_in_no_plan(spark):
    secret, df = "0123456789-sealing-key-0123456789", spark.createDataFrame([("private",), (None,)], "v string")
    secret = secret[:32]
    back = opened(sealed(df, ["v"], secret, "export"), ["v"], secret, "export")
    run = back._jdf.queryExecution()
    assert {r.v for r in back.collect()} == {"private", None}
    jvm = spark.sparkContext._jvm
    codegen = jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(run.executedPlan())
    texts = [run.toString(), run.analyzed().prettyJson(), run.optimizedPlan().prettyJson(), run.executedPlan().toString(), codegen]
    raw = secret.encode()
    for shown in (secret, raw.hex(), raw.hex().upper(), base64.b64encode(raw).decode(), " ".join(f"{b:02X}" for b in raw)):
        assert not any(shown in text for text in texts)


def test_damaged_maps_are_refused(spark, ws, table, folder):
    source = table(["id", "team"], [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")])
    p = protect(source, PolicyBuilder().key("id").code("team", ["x", "y"]).build(), ws)
    B.bind_source(p.keymap, {"table": source})
    good, book = p.keymap.records["table"], p.keymap.book
    first = F.col("_row") == 0
    cases = {
        "good": (good, book),
        "lost key": (good.withColumn("source_key", F.when(~first, F.col("source_key"))), book),
        "bad id": (good.withColumn("record_id", F.when(first, "x").otherwise(F.col("record_id"))), book),
        "row gap": (good.filter(~first), book),
        "row twice": (good.withColumn("_row", F.when(first, 1).otherwise(F.col("_row"))), book),
        "lost label": (good, book.withColumn("label", F.when(F.col("label") != "x", F.col("label")))),
        "no entries": (good.limit(0), book),
    }
    for i, (name, (records, codes)) in enumerate(cases.items()):
        keymap = dataclasses.replace(p.keymap, records={"table": records}, book=codes)
        save_key_map(spark, keymap, f"{folder}/{i}", "k" * 32)
        if name == "good":
            assert B.open_key_map(spark, f"{folder}/{i}", "k" * 32).policies == p.keymap.policies
        else:
            with pytest.raises(Refused):
                B.open_key_map(spark, f"{folder}/{i}", "k" * 32)


def test_sinks(spark, table, folder):
    df = table(["a", "b"], [("1", ""), ("2", 'q"uote')])
    write_table(df, ["b", "a"], f"{folder}/csv", "csv")
    got = spark.read.options(header=True, escape='"', nullValue="\x00").csv(f"{folder}/csv")
    assert got.columns == ["b", "a"] and sorted(r.b or "" for r in got.collect()) == ["", 'q"uote']
    with pytest.raises(Refused):
        write_table(df, ["a"], f"{folder}/x")
    write_tables({"one": df, "two": df}, folder)
    assert spark.read.parquet(f"{folder}/two").count() == 2
    for a, b in (("/x/data", "/x/map"), ("/x/data", "/x/data/map")):
        with pytest.raises(Refused):
            separate(a, b)


def test_hot_keys_are_spread(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("_row"))
    right = left.select("k").distinct().withColumn("v", F.upper("k"))
    joined = keyed_join(left, right, "k", "_row", hot_rows=100)
    assert "_salt" in joined._jdf.queryExecution().toString()
    assert joined.count() == 3000 and joined.filter("v <> upper(k) or v is null").isEmpty()


def test_a_block_meets_before_its_rows_are_summed(spark):
    """No task holds all rows of a file: the first aggregate comes after the cells were sent to their blocks."""
    cells = spark.range(200).selectExpr("'b' book", "id % 3 sheet", "id div 6 row", "id % 2 col", "'text' kind", "'x' text")
    plan = G.discover_regions(cells)._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.splitlines() if "HashAggregate" in line or "hashpartitioning" in line]
    assert "hashpartitioning" in first[-1]


def test_larger_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("cast(id as string) a").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(registry, "DEALT", 50)
    c = registry.Context(spark, str(tmp_path), Workspace(spark))
    assert c.dealt("t").rdd.getNumPartitions() == 20
    kept = c.kept("t")
    assert len(kept.inputFiles()) == 20 and sorted(r["_row"] for r in kept.collect()) == list(range(1000))
    assert all(r["a"] == str(r["_row"]) for r in kept.collect())
