"""Phrase collocation mining over weighted automata: shards count their n-grams, ranges of prefixes add them up."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .automaton import Automaton, compose, counted, merged, sorted_words, starts, union
from .common import width, written

#: Tokens of one shard, and bytes that are cut off a very long text at once.
SHARD, BLOCK = 1 << 21, 1 << 22
#: Bytes of text for each range of prefixes, on average, and sampled phrases for each range.
RANGE_BYTES, SAMPLED = 24 << 20, 50
#: Sequences that a range holds before they are added up.
HELD = 1 << 22
#: Phrases looked up at once.
LOOKED_UP = 1 << 16
#: Bits of the filter of frequent pairs: 16 a pair, within these bounds. A full filter lets more pass, at no harm.
FILTER_BITS = (1 << 16, 1 << 27)
_CHUNK = 1 << 16
_BREAK = b"\xff"  # a byte that UTF-8 never has


def _letters() -> bytes:
    table = bytearray(range(256))
    table[0x41:0x5B] = bytes(range(0x61, 0x7B))
    table[0x09] = 0x20
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = 0xFF
    return bytes(table)


_TABLE = _letters()


def prepared(text: bytes) -> bytes:
    """A-Z lower-cased, tabs as spaces, and a break for each character that ends a piece."""
    return text.translate(_TABLE)


def tokens(text: bytes) -> list[bytes]:
    """Words and breaks of a prepared text."""
    return text.replace(_BREAK, b" \xff ").split()


def blocks(text: bytes, ahead: int, size: int | None = None) -> Iterator[tuple[bytes, bytes]]:
    """(block, up to ``ahead`` next words of the piece that its end cuts) of a prepared text; blocks end between words."""
    size, at = size or BLOCK, 0
    while len(text) - at > size:
        cut = text.rfind(_BREAK, at, at + size) + 1
        if cut:
            yield text[at:cut], b""
            at = cut
            continue
        cut = text.rfind(b" ", at + 1, at + size)
        if cut < 0:  # a word longer than a block
            cut = min((e for e in (text.find(c, at + size) for c in (b" ", _BREAK)) if e >= 0), default=-1)
            if cut < 0:
                break
        seen, found = size, b""
        while True:
            rest = text[cut : cut + seen]
            found = rest.split(_BREAK, 1)[0]
            if len(found) < len(rest) or cut + seen >= len(text) or len(found.split()) > ahead:
                break
            seen *= 2
        yield text[at:cut], b" ".join(found.split()[:ahead])
        at = cut
    yield text[at:], b""


class Shard:
    """Tokens of texts until they are counted."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.chunks: list[pa.Array] = []
        self.langs: list[tuple[bytes, int]] = []
        self.hidden: list[tuple[int, int]] = []
        self.n = 0

    def add(self, lang: bytes, text: bytes) -> Iterator[None]:
        """Takes a text; yields whenever the shard is full."""
        for block, ahead in blocks(prepared(text), self.longest - 1):
            own, more = tokens(block), ahead.split()
            own += [*more, _BREAK]
            self.chunks.append(pa.array(own, pa.binary()))
            self.langs.append((lang, len(own)))
            self.n += len(own)
            if more:  # they belong to the next block, and are counted there
                self.hidden.append((self.n - 1 - len(more), self.n - 1))
            if self.n >= SHARD:
                yield

    def positions(self) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
        """(words, whether a phrase starts there, [lang's symbol, word's, next word's, …]) of all tokens; 0 ends a piece."""
        names = sorted({g for g, _ in self.langs})
        place = {g: i for i, g in enumerate(names)}
        words, symbol = sorted_words(pa.chunked_array([*self.chunks, pa.array(names, pa.binary())], pa.binary()))
        of = np.array([symbol[self.n + place[g]] for g, _ in self.langs], np.int64)
        ids = symbol[: self.n].copy()
        ids[ids == len(words)] = 0  # the break sorts behind all words
        begins = ids > 0
        for a, b in self.hidden:
            begins[a:b] = False
        out = [np.repeat(of, [n for _, n in self.langs]), ids]
        for i in range(1, self.longest):
            ahead = np.append(ids[i:], np.zeros(min(i, len(ids)), np.int64))
            out.append(np.where(out[-1] > 0, ahead, 0))
        return words, begins, out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ b ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _pair_places(lang: np.ndarray, first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four places of each pair in a filter, from hashes of its lang and words."""
    h = _mixed(_mixed(lang, first), second)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(bits - 1)).astype(np.int64) for i in range(4)]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w, 12) for w in words), np.uint64, len(words))


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """A Bloom filter of (lang, phrase) of two words, of bounded size: made in chunks, of which the driver reads each once."""
    low, high = FILTER_BITS
    bits = min(high, max(low, 1 << int(16 * max(1, pairs.count()) - 1).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column(0).to_pylist(), [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            sides = [_hashes(x) for x in ([g.encode() for g in langs], [p[0] for p in phrases], [p[1] for p in phrases])]
            at = np.unique(np.concatenate(_pair_places(*sides, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // _CHUNK), pa.array(at % _CHUNK)], ["chunk", "bit"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, bit = (batch.column(i).to_numpy() for i in (0, 1))
            for c in np.unique(chunk).tolist():
                held.setdefault(c, np.zeros(_CHUNK, bool))[bit[chunk == c]] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["chunk", "data"]
        )

    spread = pairs.select("lang", "phrase").mapInArrow(place, "chunk long, bit long").distinct().repartition(width(pairs.sparkSession), "chunk")
    out = np.zeros(bits // 8, np.uint8)
    for r in spread.mapInArrow(gather, "chunk long, data binary").toLocalIterator():
        out[r["chunk"] * _CHUNK // 8 :][: _CHUNK // 8] = np.frombuffer(r["data"], np.uint8)
    return out


def _in_filter(maps: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([(maps[p >> 3] >> (p & 7).astype(np.uint8)) & 1 for p in places]).astype(bool)


Phrase = tuple[bytes, ...]


def _symbols(phrase: Phrase, words: list[bytes], depth: int) -> list[int]:
    """The least row of symbols that isn't below ``phrase`` (lang and words)."""
    out = []
    for word in phrase[:depth]:
        at = bisect_left(words, word)
        out.append(at + 1)
        if at == len(words) or words[at] != word:
            break
    return out + [0] * (depth - len(out))


def _cuts(keys: np.ndarray, bounds: Sequence[Phrase], words: list[bytes]) -> np.ndarray:
    """Rows of the sorted ``keys`` at which each range begins, and their number."""
    wide = 4 * keys.shape[1]
    rows = np.ascontiguousarray(keys.astype(">u4")).view(f"S{wide}").ravel()
    marks = np.array([_symbols(b, words, keys.shape[1]) for b in bounds], np.int64).reshape(-1, keys.shape[1])
    marks = np.ascontiguousarray(marks.astype(">u4")).view(f"S{wide}").ravel()
    return np.concatenate([[0], np.searchsorted(rows, marks), [len(keys)]])


def _count_shards(docs: DataFrame, longest: int, bounds: Sequence[Phrase], pairs: np.ndarray | None = None) -> DataFrame:
    """(range, data): automata of each shard's phrases, one for each range of prefixes, with their counts.

    Without ``pairs`` the sequences are a lang, a word and the next word of its piece; a word's count is the sum of those that
    begin with it. With the filter of frequent ``pairs`` they are a lang and the next three to ``longest`` words, as far as all
    their pairs pass: phrases with a rare pair are rare themselves."""
    sent = None if pairs is None else docs.sparkSession.sparkContext.broadcast(pairs)
    ahead = 2 if pairs is None else longest

    def count(shard: Shard) -> Iterator[pa.RecordBatch]:
        words, begins, columns = shard.positions()
        shard.clear()
        if sent is not None:
            maps = sent.value
            own = np.append(np.uint64(0), _hashes(words.to_pylist()))
            for i in range(2, len(columns)):  # a pair that doesn't pass ends the phrase
                some = np.nonzero(columns[i])[0]
                a, b = columns[i - 1][some], columns[i][some]
                bad = some[~_in_filter(maps, _pair_places(own[columns[0][some]], own[a], own[b], 8 * len(maps)))]
                columns[i][bad] = 0
                for j in range(i + 1, len(columns)):
                    columns[j][bad] = 0
            begins &= columns[3] > 0
        keys = np.stack([c[begins] for c in columns], axis=1)
        if keys.shape[1] == 3 and len(words) < 1 << 21:  # three symbols in one number sort faster
            packed, counts = np.unique((keys[:, 0] << 42) + (keys[:, 1] << 21) + keys[:, 2], return_counts=True)
            keys = np.stack([packed >> 42, (packed >> 21) & ((1 << 21) - 1), packed & ((1 << 21) - 1)], axis=1)
        else:
            keys, counts = counted(keys, np.ones(len(keys), np.int64))
        cuts = _cuts(keys, bounds, words.to_pylist())
        for r in np.nonzero(cuts[1:] > cuts[:-1])[0]:
            part = slice(cuts[r], cuts[r + 1])
            data = Automaton.of(words, keys[part], counts[part]).pack()
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([data], pa.binary())], ["range", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(ahead)
        for batch in batches:
            for lang, text in zip(batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())):
                for _ in shard.add(lang.as_py(), text.as_py()):
                    yield from count(shard)
        if shard.n:
            yield from count(shard)

    return docs.mapInArrow(run, "range int, data binary")


def _add_up(shards: DataFrame, bounds: Sequence[Phrase], depth: int, shortest: int, least: int) -> DataFrame:
    """(lang, words, phrase, n): phrases of ``shortest`` words or more with ``least`` or more occurrences; if ``shortest`` is 1,
    also the number of words of each lang as words = 0.

    A range's automata are united, weights of equal sequences added, and a prefix's count is the sum over its sequences. Those
    of a prefix that a bound cuts lie in several ranges: each range yields its part, whatever it is, and the parts are summed."""

    def rows_of(r: int, words: pa.Array, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        new, listed = starts(keys), None
        for d in range(depth):
            at = np.nonzero(new[:, d])[0]
            n = np.add.reduceat(counts, at)
            some = keys[at, d] > 0
            at, n = at[some], n[some]
            if d < shortest and (d or shortest > 1):
                continue
            show = (n >= least) if d else np.ones(len(n), bool)
            for bound in (bounds[r - 1 : r] if r else []) + list(bounds[r : r + 1]):
                listed = words.to_pylist() if listed is None else listed
                mark = _symbols(bound, listed, d + 1)
                if 0 not in mark and all(m <= len(listed) and listed[m - 1] == w for m, w in zip(mark, bound)):
                    show |= (keys[at, : d + 1] == mark).all(axis=1)
            keep = keys[at[show], : d + 1]
            if len(keep):
                named = [words.take(pa.array(keep[:, i] - 1)).to_pylist() for i in range(d + 1)]
                phrases = [b" ".join(x).decode() for x in zip(*named[1:])] if d else [""] * len(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g.decode() for g in named[0]], pa.string()), pa.array(np.full(len(keep), d), pa.int32()), pa.array(phrases, pa.string()), pa.array(n[show])],
                    ["lang", "words", "phrase", "n"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Automaton] = []
        now, size = None, 0
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != now:
                    if held:
                        yield from rows_of(now, *merged(held, depth))
                    held, now, size = [], r, 0
                held.append(Automaton.unpack(data.as_py()))
                size += len(held[-1].symbol)
                if size > HELD and len(held) > 1:
                    held = [union(held, depth)]
                    size = 0
        if held:
            yield from rows_of(now, *merged(held, depth))

    dealt = shards.repartition(width(shards.sparkSession), "range").sortWithinPartitions("range")
    parts = dealt.mapInArrow(run, "lang string, words int, phrase string, n long")
    return parts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("words") == 0) | (F.col("n") >= least))


def prefix_bounds(docs: DataFrame, longest: int, ranges: int, size: int) -> list[Phrase]:
    """Phrases (lang and words) that cut all phrases into about equal ranges, from a sample of ``SAMPLED`` for each range. They
    decide how even the work is, no result."""
    if ranges < 2:
        return []
    share = min(1.0, max(0.02, 400_000_000 / max(1, size)) * 0.1)
    chance = min(1.0, SAMPLED * ranges / max(1.0, share * size / 6))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())):
                own = tokens(prepared(text.as_py())) + [_BREAK]
                rng = np.random.default_rng(xxh64_intdigest(text.as_py()))
                for i in np.nonzero(rng.random(len(own)) < chance)[0].tolist():
                    phrase = own[i : i + longest]
                    stop = phrase.index(_BREAK) if _BREAK in phrase else longest
                    if stop:
                        out.append([lang.as_py(), *phrase[:stop]])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], ["phrase"])

    found = sorted(tuple(map(bytes, r["phrase"])) for r in docs.sample(False, share, 5).mapInArrow(draw, "phrase array<binary>").collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def look_up(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, phrase, n) of the phrases of ``asked`` (lang, phrase), each once, that ``known`` (lang, phrase, n) has.

    Both are dealt to ranges of prefixes. Within a range, phrases of both become automata and are composed."""

    def keyed(rows: list[tuple[str, str]]) -> tuple[pa.Array, np.ndarray]:
        each = [[g.encode(), *p.encode().split(b" ")] for g, p in rows]
        words, symbol = sorted_words(pa.chunked_array([pa.array([w for x in each for w in x], pa.binary())], pa.binary()))
        size = np.array([len(x) for x in each])
        keys = np.zeros((len(each), int(size.max(initial=1))), np.int64)
        keys[np.arange(keys.shape[1]) < size[:, None]] = symbol
        return words, keys

    def both(rows: list[tuple[str, str, int | None]]) -> Iterator[pa.RecordBatch]:
        want, have = [r for r in rows if r[2] is None], [r for r in rows if r[2] is not None]
        if not want or not have:
            return
        words, keys = keyed([r[:2] for r in want])
        acceptor = Automaton.of(words, *counted(keys, np.ones(len(want), np.int64)))
        known_words, known_keys = keyed([r[:2] for r in have])
        counts = Automaton.of(known_words, *counted(known_keys, np.array([r[2] for r in have], np.int64)))
        found, n = compose(acceptor, counts, keys.shape[1])
        named = words.to_pylist()
        each = [[named[s - 1].decode() for s in row if s] for row in found.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in each], pa.string()), pa.array([" ".join(x[1:]) for x in each], pa.string()), pa.array(n)], ["lang", "phrase", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int | None]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= LOOKED_UP and held[-1][:2] != row[:2]:
                    yield from both(held)
                    held = []
                held.append(row)
        yield from both(held)

    rows = asked.select("lang", "phrase", F.lit(None).cast("long").alias("n")).distinct().unionByName(known.select("lang", "phrase", "n"))
    rows = rows.repartitionByRange(width(asked.sparkSession), "lang", "phrase").sortWithinPartitions("lang", "phrase")
    return rows.mapInArrow(run, "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, longest: int = 4, least: int = 30) -> DataFrame:
    """(lang, words, phrase, n): all phrases of up to ``longest`` words with ``least`` or more occurrences in (lang, text), and
    for each lang its number of words as words = 0, phrase = ''."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2 * width(spark), -(-size // RANGE_BYTES))
    bounds = prefix_bounds(docs, longest, ranges, size)
    two = sorted({b[:3] for b in bounds})
    short = written(_add_up(_count_shards(docs, longest, two), two, 3, 1, least), "short")
    if longest < 3:
        return short.filter(F.col("words") <= longest)
    pairs = pair_filter(short.filter("words = 2"))
    return short.unionByName(written(_add_up(_count_shards(docs, longest, bounds, pairs), bounds, longest + 1, 3, least), "long"))


def mine_collocations(
    docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, scale: int = 2_000_000, covered: int = 80,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` phrases by score, then a, highest first, then by phrase.

    Texts (A-Z lower-cased) are cut into pieces at .,;:!? and line ends, pieces into words at spaces and tabs. ``a`` is how
    often a phrase of 2 to ``longest`` words occurs within pieces of a lang, ``least`` times at least. Cut after k words it has
    l occurrences of the first part and r of the rest, and a score of floor(scale * a / (l + r)), computed in decimals; the
    cut with the lowest score counts, of equal ones the first. Phrases inside a longer phrase that has at least ``covered``
    percent of their occurrences are dropped. ``n`` is the lang's number of words.

    A null text counts as empty, a null lang as ``und``; repeated rows count each. Texts of any length are counted in blocks.
    Langs without a phrase, and an empty table, give no rows. A lang or a phrase with most of the rows is no task of its own:
    shards send one automaton for each range of prefixes, and ranges are cut inside langs and first words.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = written(phrase_counts(rows, max(2, longest), least), "phrases")
    phrases = counts.filter("words >= 2").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    size = F.size("w")
    cut = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, size - F.col("k")), " ").alias("right"),
    )
    cut = written(cut, "cuts")
    asked = cut.select("lang", F.explode(F.array("left", "right")).alias("phrase"))
    found = written(look_up(asked, counts.filter("words >= 1")), "parts")
    for side, n in (("left", "l"), ("right", "r")):
        cut = cut.join(found.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)), ["lang", side])
    score = F.expr(f"cast(cast({scale} as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(20,0)) + r) as long)")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = phrases.filter(size > 2).withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered)
    )
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    langs = counts.filter("words = 0").select("lang", "n")
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
