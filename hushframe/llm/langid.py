"""Language ID by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most frequent n-grams kept of a language and compared of a document.
TOP_LANGUAGE, TOP_DOCUMENT = 1000, 400
#: Languages that a task compares with; a table with more labels than this is refused, never cut.
MOST_LANGUAGES = 1000
#: Letters of text that are counted at once.
CHUNK = 1 << 19
UND = "und"
_EDGE = 0x20


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or the word edge for everything that is no letter."""
    table = np.full(0x110000, _EDGE, np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """The text's letters in lower case, everything else as one word edge each, with an edge at both ends."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[_EDGE], _TABLE[0][points], [_EDGE]])


def grams_of(a: np.ndarray, lead: int = 0) -> np.ndarray:
    """Codes of all n-grams of one to three letters: 21 bits for a letter, so no two n-grams share a code. An n-gram may
    begin or end with a word edge, never hold one inside, and never be an edge alone. The first ``lead`` (0 or 2) letters
    belong to the piece before: n-grams that lie in them alone are left out."""
    edge = a == _EDGE
    two = (a[:-1] << 21) | a[1:]
    two = two[~(edge[:-1] & edge[1:])[: len(two)]] if not lead else two[1:][~(edge[1:-1] & edge[2:])]
    three = ((a[:-2] << 42) | (a[1:-1] << 21) | a[2:])[~edge[1:-1]]
    return np.concatenate([a[lead:][~edge[lead:]], two, three])


def pieces_of(text: str) -> Iterator[np.ndarray]:
    """The text's n-grams, a bounded number at a time."""
    a = letters(text)
    for at in range(0, len(a), CHUNK):
        lead = 2 if at else 0
        if lead or len(a) > 2:
            yield grams_of(a[at - lead : at + CHUNK], lead)


def added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One (codes, counts) of several."""
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, counts) of a whole text."""
    parts = [np.unique(g, return_counts=True) for g in pieces_of(text)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return parts[0] if len(parts) == 1 else added_up(parts)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, ties by code."""
    return codes[np.lexsort((codes, -counts))[:top]]


def learn_profiles(
    docs: DataFrame, top: int = TOP_LANGUAGE, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, gram, rank): the most frequent n-grams of each language over all rows with a text and a language.

    Tasks count their own rows, one sum by language and n-gram follows. A language's n-grams are ranked in two steps: in
    slices, then the slices' best, so that no task sorts a language alone.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

            def fold(lang: str) -> None:
                new = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
                held[lang] = added_up([held[lang], new]) if lang in held else new

            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for grams in pieces_of(text.as_py()):
                    own = waiting.setdefault(lang, [])
                    own.append(grams)
                    if sum(map(len, own)) > 2 * CHUNK:
                        fold(lang)
            for lang in list(waiting):
                fold(lang)
            for lang, (codes, counts) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"]
                )

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(64)))
    order = [F.col("n").desc(), F.col("gram")]
    best = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order)))
    best = best.filter(F.col("rank") <= top).drop("rank", "slice")
    final = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return final.filter(F.col("rank") <= top).select("lang", "gram", "rank")


class Profiles:
    """Ranks of the languages' n-grams as one sorted table of codes."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int) -> None:
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.top = top
        number = {x: i for i, x in enumerate(self.langs)}
        # a missing n-gram is as far out of place as can be
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for lang, gram, rank in rows:
            self.rank[number[lang], np.searchsorted(self.codes, gram)] = rank - 1

    def predict(self, text: str | None, top: int = TOP_DOCUMENT) -> tuple[str, float]:
        codes, counts = counted(text) if text else (np.zeros(0, np.int64),) * 2
        if not len(codes) or not self.langs:
            return UND, 0.0
        own = ranked(codes, counts, top)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == own, at, len(self.codes))
        there = self.rank[:, at]
        # ranks of both lists are stretched to the same length, so that a short text's ranks compare with a profile's
        mine = np.arange(len(own)) * (self.top / top)
        far = np.where(there < 0, self.top, np.minimum(np.abs(there - mine), self.top))
        far = far.sum(axis=1)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.top * len(own)))


def language_of(profiles: DataFrame) -> Callable[[Column], Column]:
    """A column function from texts to (lang_pred, score).

    A document's most frequent n-grams are compared with each language's profile: the distance is the sum of how far each
    stands out of its place there, the nearest language is predicted (ties: the first by name). ``score`` is 1 for no
    distance and 0 for the greatest. A null text, or one without a letter, is ``und`` with score 0, and so is every text
    if nothing was learned. Profiles are at most languages x their length, refused above ``MOST_LANGUAGES``, so they fit
    in every task.
    """
    languages = profiles.select("lang").distinct().count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MOST_LANGUAGES}")
    known = [tuple(r) for r in profiles.collect()]
    sent = profiles.sparkSession.sparkContext.broadcast(known)
    length = max((r[2] for r in known), default=1)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Profiles(sent.value, length)
        for texts in batches:
            out = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["lang_pred", "score"]
            )

    return predicted


def predict_languages(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row of ``docs``, from its whole text alone (see ``language_of``). Ids pass through,
    null or repeated; no rows give no rows."""
    rows = docs.select(F.col(id_col).alias("id"), language_of(profiles)(F.col(text_col)).alias("p"))
    return rows.select(F.col("id").alias(id_col), "p.lang_pred", "p.score")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id's text, modulo 4, is 2. A null id has the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2
