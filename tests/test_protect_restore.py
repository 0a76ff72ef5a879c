import time
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import books, ordered
from hushframe.errors import Refused
from hushframe.operators import binding as B
from hushframe.operators import joins
from hushframe.operators import profile as P
from hushframe.operators import restore as R
from hushframe.operators import risk as K
from hushframe.operators.protect import check_schema, protect
from hushframe.policy import SOURCE_LABELS, PolicyBuilder, parse_policy, policy_dict

COLUMNS = ["student_name", "student_number", "email", "campus", "subject", "gpa", "notes"]
ROWS = [
    ("Invented A", "SYNTH-001", "a@example.invalid", "Moon", "Imaginary101", "4.2", "n"),
    ("Invented B", "SYNTH-002", "b@example.invalid", "Moon", "Imaginary101", "04.20", "n"),
    ("Invented C", "SYNTH-003", "c@example.invalid", "Mars", "Imaginary101", "5.5", "n"),
    ("Invented D", "SYNTH-004", "d@example.invalid", "Mars", "Imaginary101", "5.5", "n"),
]


def policy(k=2):
    return (
        PolicyBuilder(k)
        .drop("student_name", "direct_identifier")
        .key("student_number")
        .drop("email", "direct_identifier")
        .code("campus", ["Moon", "Mars", "Venus"])
        .code("subject", ["Imaginary101"])
        .numeric("gpa", 0, 7)
        .drop("notes", "free_text")
        .build()
    )


@pytest.fixture(scope="module")
def source(table):
    return table(COLUMNS, ROWS)


@pytest.fixture(scope="module")
def protected(source, ws):
    p = protect(source, policy(), ws)
    B.bind_source(p.keymap, {"table": source})
    return p


@pytest.fixture(scope="module")
def returned(protected):
    """Protected rows in reverse order, with a new result column."""
    stage = protected.stages["table"]
    return stage.select(*protected.keymap.policies["table"].output_columns, F.lit("Pass").alias("outcome"), (3 - F.col("_row")).alias("_row"))


def test_protected_values(protected):
    rows = protected.stages["table"].orderBy("_row").collect()
    assert [r.gpa for r in rows] == ["4.2", "4.2", "5.5", "5.5"]
    assert [r.source_key for r in rows] == ["SYNTH-001", "SYNTH-002", "SYNTH-003", "SYNTH-004"]
    assert rows[0].campus == rows[1].campus != rows[2].campus == rows[3].campus
    book = books(protected.keymap)["table"]
    assert set(book["campus"]) == {"Moon", "Mars"}  # observed labels only
    assert protected.keymap.policies["table"].columns["campus"].domain.values == ("Mars", "Moon")
    assert protected.table.columns == ["record_id", "campus", "subject", "gpa"]


def test_runs_share_no_token(source, ws, protected):
    again = protect(source, policy(), ws)

    def tokens(p):
        ids = {r.record_id for r in p.table.collect()}
        return ids | {c for b in books(p.keymap)["table"].values() for c in b.values()}

    assert not tokens(again) & tokens(protected)


def test_report(protected):
    a = K.assess(protected.table, protected.keymap.policies["table"])
    r = a.of()
    assert not a.refused() and (r.n_rows, r.minimum_size, r.unique_members, r.small_cells, r.small_members) == (4, 2, 0, 0, 0)
    assert K.retained_classes(protected.keymap.policies["table"])["record_id"] == "pseudonymous_identifier"
    v = a.verdicts().first()
    assert (v.passed, v.n_rows, v.minimum_class_size, v.errors) == (True, 4, 2, 0) and v.warnings == a.findings.count()


def swap(df):
    first = F.when(F.col("gpa") == "4.2", "5.5").otherwise("4.2")
    return df.withColumn("gpa", F.when(F.col("_row").isin(0, 2), first).otherwise(F.col("gpa")))


def test_swapped_numbers_make_every_row_unique(protected):
    p = protected.keymap.policies["table"]
    df = swap(protected.stages["table"]).select(*p.output_columns)
    a = K.assess(df, p)
    r = a.of()
    assert (r.small_cells, r.unique_fraction, r.small_members, a.refused()) == (0, 1.0, 4, True)
    assert a.codes("error") == {"table: rare_rows": 4}
    with pytest.raises(Refused):
        a.refuse()
    loose = K.assess(df, p, "controlled_pseudonymisation")
    assert not loose.refused() and loose.codes("accepted") == {"table: rare_rows": 4}


def first(column, value):
    return lambda df: df.withColumn(column, F.when(F.col("_row") == 0, F.lit(value)).otherwise(F.col(column)))


@pytest.mark.parametrize(
    "mutate",
    [
        first("campus", "prose with far too many words here"), first("campus", "a@b.co"), first("campus", ""),
        first("record_id", "not-an-id"), first("gpa", "7.1"), first("gpa", "4.20"), first("gpa", "-1"),
        lambda df: df.filter("_row < 0"), lambda df: df.unionByName(df),
        lambda df: df.filter("_row < 3"), lambda df: df.withColumn("email", F.lit("x")), lambda df: df.drop("gpa"),
    ],
)
def test_validation_refuses(protected, mutate):
    p = protected.keymap.policies["table"]
    df = mutate(protected.stages["table"].select("_row", *p.output_columns)).drop("_row")
    assert K.assess(df, p).refused()


def test_rejected_columns_are_counted_by_class(protected):
    p = protected.keymap.policies["table"]
    a = K.assess(protected.table.withColumn("email", F.lit("x")).withColumn("notes", F.lit("x")).withColumn("zzz", F.lit("x")), p)
    assert a.codes("error") == {"table: columns": 3, "table: direct_identifier": 1, "table: free_text": 1, "table: unknown": 1}


def replaced(i, column, value):
    rows = [list(r) for r in ROWS]
    rows[i][COLUMNS.index(column)] = value
    return [tuple(r) for r in rows]


@pytest.mark.parametrize(
    "rows",
    [
        [], replaced(0, "student_number", "SYNTH-002"), replaced(0, "student_number", ""), replaced(0, "student_number", " "),
        *[replaced(0, "student_number", k) for k in ("=1+2", "+1234", "@command", "bad\tkey")],
        replaced(0, "campus", "Pluto"), *[replaced(0, "gpa", g) for g in (" ", "NaN", "Infinity", "-1", "7.1", "text", "4e0", "+4.2")],
    ],
)
def test_protect_refuses(table, ws, rows):
    with pytest.raises(Refused):
        protect(table(COLUMNS, rows), policy(), ws)


def test_protect_refuses_other_schema(table, ws):
    with pytest.raises(Refused):
        protect(table(COLUMNS[:-1], [r[:-1] for r in ROWS]), policy(), ws)
    with pytest.raises(Refused):
        protect(table([*COLUMNS, "more"], [(*r, "x") for r in ROWS]), policy(), ws)


def test_no_retained_column_is_one_class(table, ws):
    p = protect(table(["k", "x"], [("a", "1"), ("b", "2")]), PolicyBuilder().key("k").drop("x").build(), ws)
    r = K.assess(p.table, p.keymap.policies["table"]).of()
    assert (r.minimum_size, r.unique_members) == (2, 0)


def test_full_restore(source, protected, returned, ws):
    rev = R.review(source, returned, protected.keymap, ws)
    assert rev.new_columns == ["outcome"]
    out = R.reconstruct(rev, ["outcome"])
    assert out.columns == [*COLUMNS, "outcome", "_row"]
    assert ordered(out) == [(*r, "Pass") for r in reversed(ROWS)]
    for bad in ([], ["outcome", "outcome"], ["other"]):
        with pytest.raises(Refused):
            R.reconstruct(rev, bad)


@pytest.mark.parametrize(
    "mutate",
    [
        first("gpa", "4.2"), first("campus", "00000000-0000-4000-8000-000000000000"), first("record_id", "x"),
        first("record_id", "00000000-0000-4000-8000-000000000000"), first("outcome", ""), first("outcome", "=1"),
        first("outcome", "a@b.co"), first("outcome", "a\x7f"), lambda df: df.filter("_row > 0"),
        lambda df: df.unionByName(df.filter("_row = 0")), lambda df: df.drop("gpa"),
        lambda df: df.withColumn("email", F.lit("x")),
    ],
)
def test_tampered_returns_are_refused(source, protected, returned, ws, mutate):
    with pytest.raises(Refused):
        R.review(source, mutate(returned), protected.keymap, ws)


def test_a_return_joined_in_slices_is_judged_as_in_one_join(source, protected, returned, ws, monkeypatch):
    """Missing, unknown, repeated and null ids, a changed cell and an unsafe result: the same counts and rows."""
    one = returned.filter("_row = 0")
    odd = returned.filter("_row < 3").withColumn("gpa", F.when(F.col("_row") == 1, "6.9").otherwise(F.col("gpa")))
    for more in (one, one.withColumn("record_id", F.lit(None).cast("string")), one.withColumn("record_id", F.lit("no id")).withColumn("outcome", F.lit("=1"))):
        odd = odd.unionByName(more)

    def judged():
        rev = R.marked_return("table", source, odd, protected.keymap, ws)
        return R.return_counts(rev, protected.keymap).first().asDict(), sorted(map(str, R.reconstruct(rev, ["outcome"]).collect()))

    counts, rows = judged()
    assert (counts["unknown_ids"], counts["missing_ids"], counts["repeated_ids"], counts["altered_rows"], len(rows)) == (2, 1, 1, 1, 7)
    monkeypatch.setattr(R, "SLICE_ROWS", 1)
    kept, keep = [], type(ws).keep
    monkeypatch.setattr(type(ws), "keep", lambda self, df, label: kept.append(label) or keep(self, df, label))
    assert judged() == (counts, rows)
    assert kept.count("met") == kept.count("restore") == R.SLICES


def test_a_review_holds_nothing_that_was_judged_already(source, protected, returned, ws):
    rev = R.marked_return("table", source, returned, protected.keymap, ws)
    assert not {"record_id", "_who"} & {*rev.stage.columns}
    assert rev.stage.schema[R.RET].dataType.names == ["outcome"]


def test_a_written_table_leaves_no_shuffle_files(spark, ws):
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*")}
    before = files()
    kept = ws.keep(spark.range(1000).repartition(3, "id"), "dealt")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 1000


def test_other_source_is_refused(table, protected, returned, ws):
    for rows in (replaced(0, "notes", "changed"), ROWS[:3], [ROWS[1], ROWS[0], *ROWS[2:]]):
        with pytest.raises(Refused):
            R.review(table(COLUMNS, rows), returned, protected.keymap, ws)


def test_results_by_map_alone(source, protected, returned, ws):
    records = protected.keymap.records["table"]
    got = R.restore_results(returned.select("record_id", "outcome", "_row"), records, "student_number", ["outcome"], ws)
    assert ordered(got) == [(f"SYNTH-00{4 - i}", "Pass") for i in range(4)]
    with_codes = returned.select("record_id", "campus", "outcome", "_row")
    got = R.restore_results(
        with_codes, records, "student_number", ["campus", "outcome"], ws, source=source, policy=policy()
    )
    assert [r[1] for r in ordered(got)] == ["Mars", "Mars", "Moon", "Moon"]


@pytest.mark.parametrize(
    "mutate, results",
    [
        (lambda df: df.filter("_row > 0"), ["outcome"]), (lambda df: df.unionByName(df.limit(1)), ["outcome"]),
        (first("record_id", "00000000-0000-4000-8000-000000000000"), ["outcome"]), (first("outcome", "=1"), ["outcome"]),
        (lambda df: df, ["outcome", "outcome"]), (lambda df: df, ["student_number"]), (lambda df: df, ["record_id"]), (lambda df: df, []),
    ],
)
def test_results_refused(protected, returned, ws, mutate, results):
    df = mutate(returned.select("record_id", "outcome", "_row"))
    with pytest.raises(Refused):
        R.restore_results(df, protected.keymap.records["table"], "student_number", results, ws)


def test_code_bijection_is_required(source, protected, returned, ws):
    df = returned.select("record_id", "campus", "_row")
    one_code = df.withColumn("campus", F.lit("00000000-0000-4000-8000-000000000000"))
    split = first("campus", "00000000-0000-4000-8000-000000000001")(df)
    for bad in (one_code, split, first("campus", "Moon")(df)):
        with pytest.raises(Refused):
            R.restore_results(bad, protected.keymap.records["table"], "student_number", ["campus"], ws, source=source, policy=policy())


def test_maps_and_codebooks_are_checked(spark, protected, source):
    records = protected.keymap.records["table"]
    B.check_map(records, "student_number")
    B.check_codebook(protected.keymap)
    B.check_identity(source, protected.stages["table"], "student_number")
    for bad in (
        records.withColumn("source_key", F.lit("same")), records.withColumn("record_id", F.lit("x")),
        records.withColumn("source_key", F.lit(" ")), records.filter("false"), records.unionByName(records),
    ):
        with pytest.raises(Refused):
            B.check_map(bad, "student_number")
    pairs = B.observed_codes(source, protected.stages["table"], ["campus", "subject"])
    book = pairs.select(F.lit("t").alias("sheet"), "field", "label", "code")
    assert B.codebook_counts(book).first().asDict() == {"entries": 3, "bad_codes": 0, "split_labels": 0, "merged_codes": 0}
    label = F.col("label") == "Moon"
    taken = F.when(label, F.lit(records.first().record_id)).otherwise(F.col("code"))
    damaged = {
        "shared_with_ids": protected.keymap.book.withColumn("code", taken),
        "merged_codes": protected.keymap.book.withColumn("code", F.first("code").over(Window.partitionBy("field").orderBy("label"))),
        "bad_codes": protected.keymap.book.withColumn("code", F.concat("code", F.lit("x"))),
        "unlisted": protected.keymap.book.withColumn("label", F.concat("label", F.lit("x"))),
        "several_owners": protected.keymap.book.withColumn("code", F.first("code").over(Window.partitionBy("sheet").orderBy("label"))),
        "split_labels": protected.keymap.book.withColumn("label", F.first("label").over(Window.partitionBy("field").orderBy("label"))),
    }
    B.check_codebook(protected.keymap)
    for fault, book in damaged.items():
        bad = replace(protected.keymap, book=book)
        assert B.book_faults(bad).first()[fault] > 0, fault
        with pytest.raises(Refused):
            B.check_codebook(bad)
    with pytest.raises(Refused):
        B.check_codebook(replace(protected.keymap, book=protected.keymap.book.filter("field = 'campus'")))


def test_a_domain_of_any_size_is_coded_from_the_source(table, ws, monkeypatch):
    """Labels beyond a policy's list: codes are drawn in the tasks, and joined by shuffle where the dictionary is large."""
    rows = [(f"K-{i}", f"town {i % 1500}") for i in range(3000)]
    source = table(["k", "town"], rows)
    pol = PolicyBuilder().key("k").code("town", SOURCE_LABELS).build()
    assert parse_policy(policy_dict(pol)) == pol
    for limit in (joins.DICTIONARY_BYTES, 100):
        monkeypatch.setattr(joins, "DICTIONARY_BYTES", limit)
        monkeypatch.setattr(B, "DICTIONARY_BYTES", limit)
        p = protect(source, pol, ws)
        book = books(p.keymap)["table"]["town"]
        assert len(book) == len(set(book.values())) == 1500
        seen = {r.source_key: r.town for r in p.stages["table"].collect()}
        assert seen == {k: book[t] for k, t in rows}
        B.check_codebook(p.keymap)
        B.bind_source(p.keymap, {"table": source})
        back = p.stages["table"].select("record_id", "town", F.lit("Fine").alias("grade"), "_row")
        out = R.reconstruct(R.review(source, back, p.keymap, ws), ["grade"])
        assert ordered(out) == [(*r, "Fine") for r in rows]
    with pytest.raises(Refused):
        protect(table(["k", "town"], [("a", "x"), ("b", "=1+1")]), pol, ws)


def test_digest_sees_order_headings_and_rows(table):
    base = table(["a", "b"], [("1", "2"), ("3", "4")])
    same = table(["a", "b"], [("1", "2"), ("3", "4")]).repartition(5)
    assert B.table_digest(base) == B.table_digest(same)
    others = [
        table(["a", "b"], [("3", "4"), ("1", "2")]), table(["b", "a"], [("1", "2"), ("3", "4")]),
        table(["a", "b"], [("1", "2")]), table(["a", "b"], [("12", ""), ("3", "4")]),
    ]
    assert len({B.table_digest(o) for o in [base, *others]}) == 5
    assert B.table_digest(base, "salt") != B.table_digest(base)


def test_profile(table):
    df = table(
        ["studentName", "score", "when", "mixed", "none"],
        [("Ada", "1.0", "2024-01-02", "1", ""), ("Bea", "2", "2024-01-02", "x", ""), ("Ada", "2.1234", "x", " ", "")],
    )
    got = {r.column: r for r in P.profile(df).collect()}
    assert got["studentName"].inferred_classification == "direct_identifier"
    assert (got["score"].type, got["score"].cardinality, got["score"].flags) == ("decimal", 3, ["high_cardinality", "precise_number"])
    assert got["when"].flags == ["identifier_or_date_shape", "high_cardinality"]
    assert (got["mixed"].type, got["mixed"].blank_count, got["mixed"].categories_below_2) == ("text", 1, 3)
    assert (got["none"].type, got["none"].cardinality, got["none"].blank_count) == ("empty", 1, 3)
    assert {r.column: r.type for r in P.type_counts(df).collect()} == {c: r.type for c, r in got.items()}


def test_category_and_returned_review(table, protected, returned):
    df = table(["c"], [("b",), ("a",), ("",), ("b",)])
    assert P.category_review(df, "c") == (["a", "b"], 1)
    with pytest.raises(Refused):
        P.categories(df, "c")
    with pytest.raises(Refused):
        P.category_review(table(["c"], [("=1",)]), "c")
    with pytest.raises(Refused):
        P.category_review(table(["c"], [(f"c{i}",) for i in range(1001)]), "c")
    assert P.inspect_returned(returned) == (4, ["campus", "subject", "gpa", "outcome"])
    for bad in (returned.drop("record_id"), returned.filter("false"), returned.unionByName(returned)):
        with pytest.raises(Refused):
            P.inspect_returned(bad)


def test_coded_identifiers(table, ws):
    columns = ["Synthetic key", "Student Name"]
    rows = [(f"SYNTH-00{i}", n) for i, n in enumerate(["Synthetic Ada", "Synthetic Ada", "Synthetic Bea", "Synthetic Bea"])]
    p = protect(table(columns, rows), PolicyBuilder().key("Synthetic key").code("Student Name", ["Synthetic Ada", "Synthetic Bea"]).build(), ws)
    pol = p.keymap.policies["table"]
    a = K.assess(p.table, pol)
    assert pol.version == 5 and not a.refused() and a.of().minimum_size == 2
    assert K.retained_classes(pol)["Student Name"] == "pseudonymous_identifier"
    assert "table: namesakes_share_codes" in a.codes("warning")


def test_schema_gate_refuses(table):
    policy = PolicyBuilder().key("id").code("team", ["x"]).build()
    check_schema(table(["team", "id"], [("x", "a")]), policy)
    for columns in (["id"], ["id", "team", "more"], ["id", "Team"]):
        with pytest.raises(Refused):
            check_schema(table(columns, [tuple("x" for _ in columns)]), policy)
    with pytest.raises(Refused):
        check_schema(table(["id", "team"], [("a", "x")]).drop("_row"), policy)
