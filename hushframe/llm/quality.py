"""Quality rules as a short-circuit cascade: rules run in the order of rejections per cost, measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of the sample that costs and rejections are measured on, at most. It decides the order of the rules, no verdict.
SAMPLE_ROWS = 2000
SPACES = r"[\x20\x09-\x0D]+"
# Fixed values of the contract's counts.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a text that the rule rejects: a Column over ``text`` and the counts of ``measures``."""

    name: str
    fails: Column


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def rules() -> list[Rule]:
    """The rules beside the base ones. Each leaves ordinary prose alone."""
    c = F.col
    letters, capitals = (F.length(F.regexp_replace("text", other, "")) for other in (r"\P{L}+", r"\P{Lu}+"))
    # words without a letter: no other than ASCII white space on either side
    bare = F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])"))
    return [
        Rule("word length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        Rule("symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("repeated lines", 2 * c("n_dup_lines") > F.size(lines_of(c("text")))),
        Rule("few words with letters", 10 * bare > 3 * c("n_words")),
        Rule("capitals", 2 * capitals > letters),
        Rule("trailing dots", 10 * F.regexp_count("text", F.lit(r"(?:\.\.\.|…)[ \t]*(?:\n|$)")) > 3 * F.size(F.split(c("text"), "\n"))),
        Rule("filler", c("text").rlike(r"(?i)lorem ipsum dolor")),
    ]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more among ``words``, all its copies counted. Windows are
    equal where their 64-bit hashes are. Texts without a repeated window, most of them, need no sorting."""
    windows = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            before = lambda j: F.when(j > 0, s[j - 1]["x"])
            after = lambda j: F.when(j < F.size(s) - 1, s[j + 1]["x"])
            twice = lambda e, j: F.when(e["x"].eqNullSafe(before(j)) | e["x"].eqNullSafe(after(j)), e["i"])
            return F.sort_array(F.array_compact(F.transform(s, twice)))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        found = F.aggregate(_let(placed, repeats), start, step)["n"]
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(0)

    return F.when(F.size(words) >= 3, _let(windows, covered)).otherwise(0)


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text that isn't null."""
    plain = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    again = _let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of(words: Column) -> Column:
        counts = {
            "n_words": F.size(words), "word_chars": F.length(F.array_join(words, "")), "n_symbols": plain, "n_dup_lines": again,
            "n_repeat_words": repeated_words(words),
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in counts.items()))

    return _let(words_of(text), of)


def measured(docs: DataFrame) -> DataFrame:
    """(id, text) with the counts and ``base_failed``."""
    rows = docs.withColumn("counts", measures(F.col("text"))).select("id", "text", "counts.*")
    return rows.withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )


def in_order(sample: DataFrame, each: Sequence[Rule], clock: Callable[[], float] = time.perf_counter) -> list[Rule]:
    """The rules by rejections per second on ``sample`` (id, text and counts), highest first.

    A rule's cost is the shorter of two timed runs over the sample. Times differ from run to run and so may the order; which
    texts a cascade keeps doesn't depend on it, for a text is kept only if every rule passes it."""
    worth = []
    for rule in each:
        best = None
        for _ in range(2):
            start = clock()
            n = sample.agg(F.count(F.when(rule.fails, F.lit(1)))).first()[0]
            took = clock() - start
            best = took if best is None else min(best, took)
        worth.append((-n / max(best, 1e-9), len(worth)))
    return [each[i] for _, i in sorted(worth)]


def rejection(each: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, or null. Rules after it aren't evaluated."""
    found = F.lit(None).cast("string")
    for rule in reversed(each):
        found = F.when(rule.fails, F.lit(rule.name)).otherwise(found)
    return found


def judge_quality(
    docs: DataFrame, each: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by, kept) for each row.

    Words are runs of other than ASCII white space. The base rules reject texts of under 50 words, and texts of which over
    half the words lie in repeated 3-word windows; texts they fail go no further. The others meet the cascade of ``each``
    (default ``rules()``), ordered by rejections per cost on a sample of at most ``sample_rows`` rows: the first rule that
    rejects ends it and is ``rejected_by``; where several would, this may differ between runs, ``kept`` may not.

    A null text counts as empty: no words, base_failed. Ids are passed through, null or repeated; rows are judged each on its
    own, whole, in its task, whatever its length. A rule whose condition is null rejects nothing. No rows give no rows.
    """
    each = rules() if each is None else list(each)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = min(1.0, 2.0 * sample_rows / max(1, docs.count()))
    sample = written(rows.sample(False, share, 11).limit(sample_rows), "sample")
    if len(each) > 1:
        tried = written(measured(sample).filter(~F.col("base_failed")), "tried")
        each = in_order(tried, each)
    judged = measured(rows).withColumn("rejected_by", F.when(~F.col("base_failed"), rejection(each)))
    kept = ~F.col("base_failed") & F.col("rejected_by").isNull()
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by",
        kept.alias("kept"),
    )
