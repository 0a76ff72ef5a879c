"""Published corpora: order of writing, refusals, restoring from disk."""

import pytest
from pyspark.sql import functions as F

from hushframe.errors import Refused
from hushframe.operators import redact as D
from hushframe.operators.binding import table_digest
from hushframe.sinks import texts as T

SECRET = "k" * 32
ROWS = [
    ("a", "Write to ann@example.org or bo@example.org, ann@example.org first."),
    ("b", "No identifier here"),
    ("c", ""),
    ("d", "0000-0002-1825-0097 is an identifier"),
]


@pytest.fixture
def corpus(spark, ws, table):
    docs = table(["doc_id", "text"], ROWS)
    return docs, D.redact(D.whole_texts(docs, "doc_id", "text"), ws)


def publish(spark, corpus, folder, secret=SECRET, **more):
    docs, out = corpus
    given = {"reviewed": table_digest(docs), "approved": True} | more
    return T.publish_texts(spark, out, docs, given["reviewed"], f"{folder}/data/texts", f"{folder}/private/record", given["approved"], secret)


def test_published_texts_are_restored_from_disk(spark, corpus, tmp_path):
    publish(spark, corpus, tmp_path)
    _, runs = T.open_texts(spark, f"{tmp_path}/data/texts")
    assert not runs.filter(F.contains("text", F.lit("@"))).count()
    clear = [str(r) for r in spark.read.parquet(f"{tmp_path}/private/record/replacements").collect()]
    assert len(clear) == 3 and not any("example.org" in r for r in clear)
    back = T.restore_published(spark, f"{tmp_path}/data/texts", f"{tmp_path}/private/record", SECRET)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == ROWS
    with pytest.raises(Refused):
        T.open_record(spark, f"{tmp_path}/private/record", "x" * 32)
    with pytest.raises(Refused):  # nothing is overwritten
        publish(spark, corpus, tmp_path)


def test_a_cut_run_shows_nothing(spark, corpus, tmp_path, monkeypatch):
    written = T._manifest

    def cut(spark, export_id, numbers, path):
        if path.endswith("texts/manifest"):
            raise RuntimeError("lost")
        written(spark, export_id, numbers, path)

    monkeypatch.setattr(T, "_manifest", cut)
    with pytest.raises(RuntimeError):
        publish(spark, corpus, tmp_path)
    with pytest.raises(Refused, match="without a manifest"):
        T.open_texts(spark, f"{tmp_path}/data/texts")
    assert T.open_record(spark, f"{tmp_path}/private/record", SECRET)[1].count() == 3


def test_refusals(spark, corpus, tmp_path):
    for more in ({"approved": False}, {"reviewed": "another"}):
        with pytest.raises(Refused):
            publish(spark, corpus, tmp_path, **more)
    publish(spark, corpus, tmp_path / "one", None)
    publish(spark, corpus, tmp_path / "two", None)
    with pytest.raises(Refused, match="belong together"):
        T.restore_published(spark, f"{tmp_path}/one/data/texts", f"{tmp_path}/two/private/record")
    _, runs = T.open_texts(spark, f"{tmp_path}/one/data/texts")
    lost = runs.withColumn("text", F.regexp_replace("text", D.TOKEN, ""))
    with pytest.raises(Refused, match="not preserved"):
        T.restore_published(spark, f"{tmp_path}/one/data/texts", f"{tmp_path}/one/private/record", returned=lost)
    runs.limit(1).write.mode("append").parquet(f"{tmp_path}/one/data/texts/runs")
    with pytest.raises(Refused, match="differ"):
        T.open_texts(spark, f"{tmp_path}/one/data/texts")


def test_no_texts(spark, ws, table, tmp_path):
    docs = table(["doc_id", "text"], [("a", "x")]).filter("false")
    publish(spark, (docs, D.redact(D.whole_texts(docs, "doc_id", "text"), ws)), tmp_path)
    assert T.restore_published(spark, f"{tmp_path}/data/texts", f"{tmp_path}/private/record", SECRET).count() == 0
