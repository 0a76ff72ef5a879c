"""Quality rules, collocations and vector codes against plain versions: nulls, ties, repeated rows, long texts, no rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.llm import automaton, collocations, quality, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MINE = ("id", "text_", "counts", "words", "phrase", "n", "a", "label", "of", "code", "kept", "rejected_by", "range", "data")


def clashing(df):
    for name in MINE:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("mine"))
    return df


# -- quality rules


def counts_plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_of_texts(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a a", "a a a", "a a a a", "x y z x y z", "x y z x y z", "one\n\none\n one\none", "\U0001f9ea | # b" * 3]
    texts += [" ".join(rnd.choices("abcd", k=rnd.randint(1, 60))) for _ in range(200)]
    texts += ["\n".join(" ".join(rnd.choices(["é", "b|", "$c", ""], k=3)) for _ in range(20)) for _ in range(30)]
    texts += ["long words here " * 60_000, " ".join(map(str, range(100_000)))]
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, None, None, None, None), (None, "a b", None, None, 1)], DOCS))
    got = quality.judge_quality(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "a b" if r.doc_id is None else texts[r.doc_id]
        n, chars, symbols, lines, repeat = counts_plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat), text
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and (r.kept is False or not r.base_failed)
    assert quality.judge_quality(docs.limit(0)).count() == 0


def prose(rnd, n=80):
    return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(n))


def test_each_rule_rejects_its_texts_and_none_prose(spark):
    rnd = random.Random(4)
    bad = {
        "word length": "".join(rnd.choices("abcdefghij", k=9000)) + " " + " ".join(str(i) + "a" for i in range(60)),
        "symbols": "% ".join(prose(rnd).split()), "few words with letters": " ".join(map(str, range(1000, 1200))),
        "repeated lines": "\n".join(x for i in range(30) for x in (f"a{i} b{i}", f"c{i} d{i}", "same", "same", "same")),
        "capitals": prose(rnd).upper(), "trailing dots": "\n".join(f"{prose(rnd, 6)}..." for _ in range(20)), "filler": prose(rnd) + " Lorem ipsum dolor sit",
    }
    texts = list(bad.values()) + [prose(rnd) + ".\n" + prose(rnd) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    for i, name in enumerate(bad):
        assert (got[i].rejected_by, got[i].kept) == (name, False)
    assert all(got[i].kept and got[i].rejected_by is None for i in range(len(bad), len(texts)))


def test_the_order_is_rejections_per_cost_and_later_rules_are_not_evaluated(spark):
    sample = spark.createDataFrame([(i, "x") for i in range(100)], "id long, text string")
    each = [quality.Rule("slow", F.col("id") < 90), quality.Rule("quick", F.col("id") < 50), quality.Rule("idle", F.col("id") < 0)]
    ticks = iter([0, 9, 9, 19, 20, 21, 21, 23, 30, 31, 31, 32])  # the best of two runs: 9, 1 and 1 seconds
    assert [r.name for r in quality.in_order(sample, each, lambda: next(ticks))] == ["quick", "slow", "idle"]
    fails = F.when(F.col("id") >= 50, F.raise_error(F.lit("evaluated"))).otherwise(F.lit(False))
    rows = sample.select(quality.rejection([quality.Rule("high", F.col("id") >= 50), quality.Rule("trap", fails)]).alias("r"))
    assert Counter(r.r for r in rows.collect()) == {"high": 50, None: 50}


def test_the_sample_changes_no_verdict(spark):
    rnd = random.Random(8)
    texts = [rnd.choice([prose(rnd), prose(rnd).upper(), " | ".join(prose(rnd).split()), "a b c " * 40]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()}
    assert want == {r.doc_id: r.kept for r in quality.judge_quality(docs, sample_rows=3).collect()}
    assert want == {r.doc_id: r.kept for r in quality.judge_quality(docs, each=quality.rules()[::-1], sample_rows=1).collect()}


# -- automata and collocations


def test_automata_keep_add_and_find_sequences():
    rnd = random.Random(2)
    draw = lambda: {tuple(rnd.choice([b"a", b"bb", b"", "é".encode(), b"z"]) for _ in range(rnd.randint(1, 4))): rnd.randint(1, 1 << rnd.choice([3, 40])) for _ in range(rnd.randint(0, 60))}

    def made(seqs):
        words, symbol = automaton.sorted_words(pa.chunked_array([pa.array([w for s in seqs for w in s], pa.binary())], pa.binary()))
        keys, at = np.zeros((len(seqs), 4), np.int64), 0
        for i, s in enumerate(seqs):
            keys[i, : len(s)] = symbol[at : at + len(s)]
            at += len(s)
        return automaton.Automaton.of(words, *automaton.counted(keys, np.array(list(seqs.values()), np.int64)))

    def read(words, keys, counts):
        named = words.to_pylist()
        return {tuple(named[s - 1] for s in row if s): n for row, n in zip(keys.tolist(), counts.tolist())}

    for _ in range(60):
        one, two = draw(), draw()
        a, b = made(one), automaton.Automaton.unpack(made(two).pack())
        assert read(a.words, *a.sequences(4)) == one and read(b.words, *b.sequences(4)) == two
        both = automaton.union([a, b], 4)
        assert read(both.words, *both.sequences(4)) == dict(Counter(one) + Counter(two))
        assert read(a.words, *automaton.compose(a, b, 4)) == {s: two[s] for s in one if s in two}
    tails = made({(bytes([i]), b"of", b"the"): 1 for i in range(97, 117)})
    assert len(tails.symbol) == 22  # twenty first words, one shared tail of two arcs


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_blocks_hold_every_phrase_once(size):
    rnd = random.Random(size)
    text = collocations.prepared(" ".join(rnd.choices(["Ab", "c.", "d,e", "longer\tword", "x!y"], weights=[9, 1, 1, 3, 1], k=300)).encode())
    whole = [p.split() for p in text.split(b"\xff")]
    want = Counter(tuple(p[i : i + 4]) for p in whole for i in range(len(p)))
    got = Counter()
    for block, ahead in collocations.blocks(text, 3, size):
        pieces = [p.split() for p in block.split(b"\xff")]
        more = ahead.split()
        for k, p in enumerate(pieces):
            own = p + (more if k == len(pieces) - 1 else [])
            got.update(tuple(own[i : i + 4]) for i in range(len(p)))
    assert got == want


def mined_plain(rows, longest=4, least=30, top=2000, scale=2_000_000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(" ".join(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        many = {tuple(p.split(" ")): c for p, c in counts.items() if c >= least and " " in p}
        ranked = []
        for p, a in many.items():
            if any(100 * many[q] >= covered * a for q in many if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            best = min((scale * a // (counts[" ".join(p[:k])] + counts[" ".join(p[k:])]), k) for k in range(1, len(p)))
            ranked.append((-best[0], -a, " ".join(p).encode(), counts[" ".join(p[: best[1]])], counts[" ".join(p[best[1] :])]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"shard": 64, "block": 30, "range": 200, "held": 8, "looked": 3}])
def test_collocations_against_brute_force(spark, monkeypatch, settings):
    for name, at in (("shard", "SHARD"), ("block", "BLOCK"), ("range", "RANGE_BYTES"), ("held", "HELD"), ("looked", "LOOKED_UP")):
        if name in settings:
            monkeypatch.setattr(collocations, at, settings[name])
    rnd = random.Random(6)
    words = ["The", "of", "new", "york", "city", "é", "Éa", "x|y", "b"] + [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(150 if settings else 400):
        w = rnd.choices(words, k=rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randint(0, len(w)) : 0] = rnd.choice([["new", "york", "city"], ["a", "b", "c", "d"], ["Of", "the"], ["in", "a", "b"]])
        texts.append("".join(x + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " "]) for x in w))
    rows = [(t, rnd.choice(["en", "en", "fr", None, "a b"])) for t in texts] + [(None, "en"), ("", None), ("ab cd " * 2000, "xx"), ("ab cd " * 2000, "xx")]
    docs = clashing(spark.createDataFrame([(i, t, g, "s", 1) for i, (t, g) in enumerate(rows)], DOCS).repartition(3))
    least = 5 if settings else 30
    got = sorted(tuple(r) for r in collocations.mine_collocations(docs, least=least).collect())
    assert got == mined_plain(rows, least=least) and len({r[0] for r in got}) >= 3
    few = sorted(tuple(r) for r in collocations.mine_collocations(docs, longest=3, least=least, top=4, covered=50).collect())
    assert few == mined_plain(rows, 3, least, 4, covered=50)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "a b c", "en", None, None)], DOCS)
    assert collocations.mine_collocations(docs).count() == 0
    assert collocations.mine_collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([(10**13, 10**13, 10**13)], "a long, l long, r long")
    score = F.expr("cast(cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(20,0)) + r) as long)")
    assert counts.select(score).first()[0] == 1_000_000


# -- vector codes


@pytest.mark.parametrize("wide", [1, 2, 5, 8])
def test_equal_average_search_is_exact(wide):
    rng = np.random.default_rng(wide)
    for high in (2, 6, vector_codes.largest(wide, 8)):
        for _ in range(60):
            entries = rng.integers(-high, high + 1, (rng.integers(1, 20), wide))
            rows = np.concatenate([rng.integers(-high, high + 1, (40, wide)), entries])
            apart = ((rows[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
            entry, distance = vector_codes.nearest(rows, entries)
            assert entry.tolist() == apart.argmin(axis=1).tolist() and distance.tolist() == apart.min(axis=1).tolist()


def codes_plain(rows, parts, entries, rounds, scale):
    good = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    kept = [(i, [int(np.floor(x * scale)) for x in v], g) for i, v, g in rows if good(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    wide = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    split = [[(v + [0] * (wide * parts - len(v)))[p * wide : (p + 1) * wide] for p in range(parts)] for _, v, _ in kept]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]
    gap = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda p, x: min((gap(x, y), e) for e, y in enumerate(books[p]))
    for _ in range(rounds):
        own = [[nearest(p, s[p])[1] for p in range(parts)] for s in split]
        for p in range(parts):
            new = []
            for e, y in enumerate(books[p]):
                members = [s[p] for s, o in zip(split, own) if o[p] == e]
                new.append([sum(c) // len(members) for c in zip(*members)] if members else y)
            books[p] = new
    digest = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    found = [[nearest(p, s[p]) for p in range(parts)] for s in split]
    error, by_label = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, g), x in zip(kept, error):
        by_label[g] += x
    return sorted(
        (str(i), "".join(f"{e:02x}" for _, e in f), x, by_label[g], digest) for (i, _, g), f, x in zip(kept, found, error)
    )


@pytest.mark.parametrize("dims", [16, 13])
def test_codes_against_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(int(i), rng.normal(size=dims).round(1).tolist(), int(rng.integers(0, 3)) if i % 5 else None) for i in rng.permutation(300)]
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * dims, 1), (303, [float("inf")] * dims, 2), (304, [], 7), (305, [0.5, -0.5], 7)]
    rows += [rows[0], rows[1], (None, rows[2][1], None)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, parts=8).collect())
    assert got == codes_plain(rows, 8, 16, 6, 4096)
    few = df.filter("vec_id < 5")
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(few, parts=4, rounds=2, scale=10).collect())
    assert got == codes_plain([r for r in rows if r[0] is not None and r[0] < 5], 4, 16, 2, 10) and all(r[2] == 0 for r in got)


def test_codes_of_nothing_and_beyond_bounds(spark):
    df = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    empty = vector_codes.compress(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(df.withColumn("embedding", F.lit(None).cast("array<double>"))).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(df)
    rows = vector_codes.integer_vectors(df.withColumn("embedding", F.array(F.lit(0.25), F.lit(-0.75))), 4096, "vec_id", "embedding", "label")
    books = vector_codes.learn_codebooks(rows, parts=2)
    assert books.decode("0000") == [0.25, -0.75]
