"""The corpus queries beside their SQL, and the pipeline's stages against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from __spark_entry__ import queries
from hushframe.llm import queries as corpus
from hushframe.llm import components as components_module
from hushframe.llm import near_copies, simhash
from hushframe.llm.common import scratch
from hushframe.workspace import Workspace

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    verdict, _ = compare.compare(spark, con, FOLDER, name, queries()[name], corpus.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", x)[0] for x in corpus.queries()}
    assert "pipeline" in queries()


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0, name
    got = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    want = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted((r["doc_id"], r["decoded"]) for r in got.collect()) == want
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r["doc_id"], r["decoded"]) for r in again.select("doc_id", "decoded").collect()) == want


def odd_docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:] + [(None, "no id but words", "en", None, None)], DOCS)


def test_stages_on_odd_rows(spark):
    docs = odd_docs(spark, [None, "", " \n ", "just a few words here", "кириллица", "### 12", "long words " * 50_000])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        stage(spark, docs, FOLDER).count()
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.filter("doc_id is null or doc_id <> 4"), FOLDER).collect()}
    assert kept == {3, 6, None}
    assert 4 not in {r["doc_id"] for r in corpus_pipeline.language(spark, docs.withColumn("lang", F.when(F.col("doc_id") != 4, "en")), FOLDER).collect()}
    same = odd_docs(spark, ["only these ten words are in here and no others"] * 3)
    assert [r["doc_id"] for r in corpus_pipeline.lines(spark, same.filter("doc_id is not null"), FOLDER).collect()] == [0]


def folder_of(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def linked_pairs(texts):
    sets = [shingles(t) for t in texts]
    out = []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                out.append((j, i))
    return out


def test_near_copies_by_exact_similarity(spark, tmp_path):
    """Every group is one of true links; of the true links, down to the threshold, over nine tenths are found."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(3, 7)))
    passage = [word() for _ in range(12)]  # stands in many texts that are not alike
    texts = []
    for k in range(120):
        size = rnd.choice([60, 120, 300, 800])
        w = [word() for _ in range(size)] + passage * (k % 4 == 0)
        changed = list(w)
        for _ in range(rnd.randint(1, max(1, size // 50))):
            changed[rnd.randrange(size)] = word()
        inserted = w[: size // 2] + [word() for _ in range(size // 25)] + w[size // 2 :]
        texts += [" ".join(x) for x in (w, changed, w[: -size // 30], inserted)] + [" ".join(w).upper()]
    texts += ["one two three", "ONE two  three", "one two four", "one two"]
    rnd.shuffle(texts)
    true = linked_pairs(texts)
    root = list(range(len(texts)))
    for j, i in true:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root] if a != b else root
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    got = [found.get(i, i) for i in range(len(texts))]
    assert all(root[i] == root[c] for i, c in enumerate(got))
    met = sum(got[i] == got[j] for j, i in true)
    assert len(true) > 700 and met >= 0.95 * len(true), (met, len(true))
    assert got[texts.index("one two three")] == got[texts.index("ONE two  three")] != got[texts.index("one two four")]
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_without_anchors_nothing_is_found(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, base), (2, base.replace("w7 ", "x ")), (3, base), (3, "another version of it")], "doc_id long, text string")
    assert {tuple(r) for r in near_copies.near_copies(docs).collect()} == {(1, 1), (2, 1), (3, 1)}
    empty = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_copies, "near_links", lambda *a: empty)
    assert {tuple(r) for r in near_copies.near_copies(docs).collect()} == {(1, 1), (3, 1)}  # equal texts alone


def test_large_groups_of_near_copies(spark, monkeypatch):
    """A group of hundreds, cut into squares, is one component; a template's texts that are unlike stay apart."""
    monkeypatch.setattr(simhash, "SIDE", 64)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):
        w = list(base)
        w[rnd.randrange(150)] = f"x{i}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [f"y{i}z{k}" for k in range(60)]) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert found == {i: 0 for i in range(300)}


def test_block_neighbours_meet_at_an_anchor():
    rnd = np.random.default_rng(0)
    word = rnd.integers(0, 1 << 24, 500, dtype=np.uint64)
    to, home = near_copies.block_anchors(word)
    assert np.bitwise_count(home ^ word).max() <= 1 and np.bitwise_count(to ^ word[:, None]).max() <= 2
    for bit in range(24):
        other_to, other_home = near_copies.block_anchors(word ^ np.uint64(1 << bit))
        odd = (np.bitwise_count(word) & 1).astype(bool)
        meets = np.where(odd, (to == other_home[:, None]).any(axis=1), (other_to == home[:, None]).any(axis=1))
        assert meets.all()


def test_near_copies_are_caught_through_all_stages(spark, tmp_path):
    """Copies of the given documents with a word or two changed: line dedup takes their common lines, and near-dedup still
    knows them. Of 400 planted copies at a similarity of 0.8 or more, over nine tenths are gone; no clean document goes."""
    rnd = random.Random(3)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) between 400 and 6000")
    given = [r for r in given.orderBy("doc_id").collect() if r["lang"]][:400]
    copies = []
    for n, r in enumerate(given):
        words = re.split(r"( |\n)", r["text"])
        for _ in range(rnd.randint(1, 2)):
            words[2 * rnd.randrange(len(words) // 2)] = "changed"
        copies.append((1_000_000 + n, "".join(words), r["lang"], r["source"], 1))
    near = {c[0] for r, c in zip(given, copies) if linked_pairs([r["text"], c[1]])}
    docs = spark.createDataFrame([tuple(r) for r in given] + copies, DOCS).repartition(4)
    sf = folder_of(docs, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    after = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).select("doc_id").collect()}
    assert len(near) > 300 and len(near & before) > 100
    assert len(near & after) <= 0.1 * len(near)
    alone = {r["doc_id"] for r in given} - {r["doc_id"] for r in near_copies.near_copies(spark.createDataFrame([tuple(r) for r in given], DOCS)).collect()}
    assert alone & before == alone & after


def test_originals_count_only_where_a_text_comes_from_them(spark, tmp_path):
    """Other documents that happen to have the same ids link nothing; the original of a shortened text does."""
    base = " ".join(f"w{i}" for i in range(100))
    sf = folder_of(spark.createDataFrame([(1, base), (2, base), (3, f"{base}\nrest of it"), (4, base)], "doc_id long, text string"), tmp_path)
    docs = spark.createDataFrame([(1, "quite another text", None), (2, "and one more", None), (3, "rest of it", None), (4, base, None)], "doc_id long, text string, id string")
    got = corpus_pipeline.near_copies(spark, docs, sf)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == {1, 2, 3}


def test_a_stage_leaves_no_large_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        ws = Workspace(spark)
        with scratch(spark) as own:
            corpus_pipeline.written(stage(spark, docs, FOLDER), "stage", ws)
            assert len(own._written) <= 2
        ws.release()


def joined_by(texts):
    root = list(range(len(texts)))
    for j, i in linked_pairs(texts):
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    return root


def test_no_link_at_the_threshold_is_left_out(spark):
    """Copies changed until they only just hold, or only just fail, the similarity; groups are those of brute force."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 6)))
    texts = ["a b c d e f g h i", "a b c d e f g h i j", "b c d e f g h i j", "x", "X  x", "a b c d e f g h i"]
    for k in range(160):
        w = [word() for _ in range(rnd.choice([12, 25, 50, 110, 400]))]
        own, last = shingles(" ".join(w)), None
        while True:  # scattered changes, cuts and insertions
            changed = list(last or w)
            at = rnd.randrange(len(changed))
            changed[at : at + rnd.choice([0, 1, 1])] = [word()] if k % 3 else []
            both = len(own & (other := shingles(" ".join(changed))))
            if 5 * both < 4 * (len(own) + len(other) - both):
                break
            last = changed
        texts += [" ".join(w), " ".join(last or w).upper(), " ".join(changed)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == joined_by(texts)


def test_texts_joined_only_by_what_is_gone_are_told_apart(spark, tmp_path):
    """Groups of texts as they were do not rest on texts as they are: 1 and 2 were alike, 3 is like neither."""
    w = [f"w{i}" for i in range(100)]
    a, b = " ".join(w), " ".join(w[:50] + ["x"] + w[51:])
    rest = " ".join(f"r{i}" for i in range(30))
    sf = folder_of(spark.createDataFrame([(1, f"{a}\n{rest}"), (2, f"{b}\n{rest}"), (3, rest)], "doc_id long, text string"), tmp_path)
    docs = spark.createDataFrame([(1, a, None), (2, b, None), (3, rest, None)], "doc_id long, text string, id string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()} == {1, 3}


def test_wide_rows_reach_python_in_batches_of_bounded_size(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    wide = spark.range(1000, numPartitions=1).select(F.repeat(F.lit("x"), 40_000).alias("text"))
    with scratch(spark):
        got = corpus_pipeline.written(wide.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in got) == 1000 and max(r.size for r in got) < 5 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def pairs_checked(monkeypatch):
    seen, alike = [], near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, *more: seen.append(pairs.count()) or alike(pairs, *more))
    return seen


def test_pairs_of_a_shared_passage_grow_with_the_texts_only(spark, monkeypatch):
    """Texts that share a passage, but are not alike, meet at each of its shingles: their pairs leave no rows."""
    monkeypatch.setattr(near_copies, "SHARED", 1_000_000)  # no shingle comes last
    rnd = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"{rnd.random()}" for _ in range(50)) for _ in range(200)]
    seen = pairs_checked(monkeypatch)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert near_copies.near_copies(docs).count() == 0
    assert max(seen) <= 2 * len(texts), seen


def test_a_crowd_about_the_threshold_is_grouped_as_by_brute_force(spark, monkeypatch):
    """One text changed in one to five places: some pairs just hold the similarity, some just fail it, all share shingles."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for i in range(240):
        w = list(base)
        for k in rnd.sample(range(70), rnd.randint(1, 5)):
            w[k] = f"x{i}k{k}" if i % 3 else f"y{i % 20}k{k}"
        texts.append(" ".join(w if i % 40 else w + w[:9]))
    want = joined_by(texts)
    assert 20 < len(set(want)) < 220
    seen = pairs_checked(monkeypatch)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == want
    assert len(seen) == 3


def test_texts_are_read_once_for_all_slices_of_pairs(spark, monkeypatch):
    """Candidate pairs are checked in slices; the sets of their texts are made once for all of them."""
    monkeypatch.setattr(near_copies, "FEW", 1)
    made, sets = [], near_copies._sets
    monkeypatch.setattr(near_copies, "_sets", lambda *a: made.append(1) or sets(*a))
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, base.replace(f"w{7 * i} ", "x ")) for i in range(12)], "doc_id long, text string")
    assert {tuple(r) for r in near_copies.near_copies(docs).collect()} == {(i, 0) for i in range(12)}
    assert len(made) <= 3, made


def test_sampled_texts_grow_with_the_table_and_the_most_frequent_shingles_come_last(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 4)
    texts = [f"a b c d e t{i % 10} {i} {i} {i} {i} {i}" for i in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("node", F.xxhash64(F.sha2("text", 256)))
    known, place = near_copies._common(rows, 800, 5)
    each = near_copies.word_hashes("a b c d e t0")
    often, less = near_copies.shingle_set(each[:5]), near_copies.shingle_set(each[1:])
    assert (known[:-1] < known[1:]).all() and {*often, *less} <= {*known}  # of a sample of 4, few of ten endings are met twice
    assert place[known == often] == place.max() > place[known == less]
    own = np.sort(np.concatenate([often, less, np.array([1], np.uint64)]))
    first = near_copies.rarest(own, (known, place), Fraction(1, 100))
    assert first.tolist() == [1, less[0], often[0]]


def test_bits_are_counted_as_by_one_word_after_the_other():
    words = np.random.default_rng(4).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    for n in (0, 1, 254, 255, 256, 20_000):
        want = [sum(w >> b & 1 for w in words[:n].tolist()) for b in range(64)]
        assert near_copies._ones(words[:n]).tolist() == want


def test_stars_need_no_round(spark, monkeypatch):
    seen, starred = [], components_module._starred
    monkeypatch.setattr(components_module, "_starred", lambda *a: seen.append(1) or starred(*a))
    found = lambda pairs: {tuple(r) for r in components_module.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found([(1, 2), (3, 1), (5, 4), (4, 4), (None, 7)]) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} and not seen
    assert found([(i, i + 1) for i in range(9)]) == {(i, 0) for i in range(10)} and seen
    assert found([(3, 1), (3, 2)]) == {(1, 1), (2, 1), (3, 1)}
