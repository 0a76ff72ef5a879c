"""SimHash near-dedup: 64-bit fingerprints, compared at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import width, written
from .components import components

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Rows of one anchor that one comparison takes; an anchor with more is cut into squares of half as many.
SIDE = 8192
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; no words: 0; fewer than ``words``: one shingle."""
    found = text.encode().lower().split() if text else []  # of bytes: A-Z only, and the ASCII spaces only
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = found[at : min(at + CHUNK, n) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
        h = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BITS)[ones * 2 > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long. Null, empty and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _syndromes() -> np.ndarray:
    """For each of 32 bits its column in the parity check of the Hamming code of length 31; the last bit stays free."""
    return np.append(np.arange(1, 32), 0)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, home) of 32-bit words, 16 or 17 for each.

    Anchors are the words of a covering code: of the 32 bits, 31 carry the perfect Hamming code, so every word has one
    anchor at a distance of at most 1 (its home), and the last bit is free. A word is sent to all anchors within covering
    radius 1 plus threshold 1: two words that differ in one bit then meet at the home of either.
    """
    column = _syndromes()
    check = np.zeros(len(half), np.int64)
    for b in range(31):
        check ^= np.where((half >> np.uint64(b)) & np.uint64(1), column[b], 0)
    flip = np.zeros(32, np.uint64)
    flip[1:] = np.uint64(1) << np.arange(31, dtype=np.uint64)
    home = half ^ flip[check]  # flip[0] is no flip: a code word is its own anchor
    # distance 2: flip bits with columns s and s ^ check, each pair once; distance 2 by the free bit: flip it at home
    # only if the home is at distance 1 at most, so that it is kept within 2
    out = [home, home ^ (np.uint64(1) << np.uint64(31))]
    rows = np.arange(1, 32)
    for s in rows:
        other = s ^ check
        # one pair for each s; (s, other) and (other, s) are the same; other == 0 is the home itself
        pair = half ^ flip[s] ^ flip[other]
        out.append(np.where((other > s), pair, home))
    return np.stack(out, axis=1), home


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, node, fp, home, check) for each different anchor of either half of each of a node's fingerprints. An anchor's
    number holds the place of the fingerprint and the half, so that only like halves meet.

    Halves that differ in one bit have unlike parities, and equal halves have the same home. So a half with an even number
    of ones waits at its home alone, where every odd neighbour comes by: an odd half goes to all its anchors."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            prints = np.array(part.column(1).to_pylist(), np.int64).reshape(part.num_rows, -1).view(np.uint64)
            for which in range(prints.shape[1]):
                for half in (0, 1):
                    fp = np.ascontiguousarray(prints[:, which])
                    word = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                    to, home = anchors(word)
                    odd = (np.bitwise_count(word) & 1).astype(bool)
                    first = np.ones(to.shape, bool)
                    first[:, 1:] = (to[:, 1:] != home[:, None]) & odd[:, None]
                    row, col = np.nonzero(first)
                    key = to[row, col] | (np.uint64(2 * which + half) << np.uint64(32))
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), part.column(0).take(rows), pa.array(fp[row].view(np.int64)), pa.array(col == 0),
                         part.column(2).take(rows)],
                        ["anchor", "node", "fp", "home", "check"],
                    )


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Union-find over row numbers: each row's root."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


class _Rows:
    """Columns of sorted rows; ``check`` is an array of rows with the same number of words, which may be none."""

    def __init__(self, group, node, fp, home, check) -> None:
        self.group, self.node, self.fp, self.home, self.check = group, node, fp, home, check

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        group, node, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        check = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(len(group), -1)
        return cls(group, node, fp.view(np.uint64), home.astype(bool), check)

    def __getitem__(self, at) -> _Rows:
        return _Rows(self.group[at], self.node[at], self.fp[at], self.home[at], self.check[at])

    def then(self, other: _Rows) -> _Rows:
        return _Rows(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("group", "node", "fp", "home", "check")))


def _near(a: _Rows, b: _Rows, most: int, far: int) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` (broadcast) are linked."""
    near = (np.bitwise_count(a.fp ^ b.fp) <= most) & (a.home | b.home)
    if a.check.shape[-1]:
        near &= sum(np.bitwise_count(a.check[..., i] ^ b.check[..., i]).astype(np.int64) for i in range(a.check.shape[-1])) <= far
    return near


def _linked(rows: _Rows, most: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the rows of one group, thinned to a forest: enough to join what the group joins."""
    n = len(rows.fp)
    root = np.arange(n)
    for at in range(0, n, 64):  # bounds the room of a comparison
        if rows.home[at:].any():
            i, j = np.nonzero(_near(rows[at : at + 64][:, None], rows[at:][None], most, far))
            pairs = np.stack([root[i + at], root[j + at]], axis=1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            if len(pairs):
                root = _roots(n, pairs)[root]
    moved = np.nonzero(root != np.arange(n))[0]
    yield rows.node[moved], rows.node[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch], most: int, far: int, linked: Callable, near: Callable) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; the links of each group. Groups of few rows are compared together, by their distance in
    the sorted rows; ones with more links than rows are left to ``linked``, as are groups of many rows: the links grow as the
    rows do. A group above ``SIDE`` rows yields its number (as a, b null) and is compared in squares later."""
    rest: _Rows | None = None
    large = None

    def out(a: np.ndarray, b) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            second = pa.nulls(len(a[part]), pa.int64()) if b is None else pa.array(b[part])
            yield pa.RecordBatch.from_arrays([pa.array(a[part]), second], ["na", "nb"])

    def links(rows: _Rows) -> Iterator[pa.RecordBatch]:
        starts = np.nonzero(np.append(True, rows.group[1:] != rows.group[:-1]))[0]
        sizes = np.diff(np.append(starts, len(rows.group)))
        small = np.repeat(sizes <= 32, sizes)
        met, gap = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, int(min(32, sizes.max(initial=1)))):
            i = np.nonzero((rows.group[d:] == rows.group[:-d]) & small[d:])[0]
            met.append(i[near(rows[i], rows[i + d], most, far)])
            gap.append(np.full(len(met[-1]), d))
        i, d = np.concatenate(met), np.concatenate(gap)
        own = np.searchsorted(starts, i, side="right") - 1
        many = np.bincount(own, minlength=len(sizes)) > sizes
        i, d = i[~many[own]], d[~many[own]]
        yield from out(rows.node[i], rows.node[i + d])
        for k in np.nonzero(many | (sizes > 32))[0]:
            for a, b in linked(rows[starts[k] : starts[k] + sizes[k]], most, far):
                yield from out(a, b)

    for batch in batches:
        for at in range(0, batch.num_rows, SIDE):
            rows = _Rows.of(batch.slice(at, SIDE))
            if large is not None:
                rows = rows[rows.group != large]
                if not len(rows.group):
                    continue
                large = None
            if rest is not None:
                rows = rest.then(rows)
            cut = int(np.searchsorted(rows.group, rows.group[-1]))  # the last group may go on
            if cut:
                yield from links(rows[:cut])
            rest = rows[cut:]
            if len(rest.group) > SIDE:
                large, rest = rest.group[0], None
                yield from out(np.array([large]), None)
    if rest is not None:
        yield from links(rest)


SENT = "anchor long, node long, fp long, home boolean, check binary"


def _compared(rows: DataFrame, group: str, most: int, far: int, linked: Callable, near: Callable, order: tuple[str, ...] = ()) -> DataFrame:
    rows = rows.select(F.col(group).alias("group"), "node", "fp", "home", "check")
    rows = rows.repartition(width(rows.sparkSession), "group").sortWithinPartitions("group", *order)
    return written(rows.mapInArrow(lambda it: _compare(it, most, far, linked, near), "na long, nb long"), "links")


def square_links(sent: DataFrame, most: int, far: int, linked: Callable, near: Callable) -> DataFrame:
    """(na, nb): links of the rows that meet at an anchor (see ``SENT``). An anchor with more than ``SIDE`` rows is cut: its
    rows get one of k columns by hash, and each row goes to the k squares of its column. A square has about ``SIDE`` rows, and
    every pair of the anchor meets in one. Rows are compared in the order of their nodes."""
    counts = sent.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    k = F.when(F.col("n") <= SIDE, 1).otherwise(F.ceil(F.col("n") / (SIDE // 4))).cast("int")
    cut = sent.join(written(counts.select("anchor", k.alias("k")), "columns"), "anchor")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int"))
    cut = cut.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    squares = cut.withColumn("square", F.xxhash64("anchor", F.least("own", "to"), F.greatest("own", "to")))
    found = _compared(squares, "square", most, far, linked, near, ("node",))
    if found.filter("nb is null").limit(1).count():
        raise RuntimeError("a square of an anchor has more rows than a comparison takes")
    return found


def near_links(
    nodes: DataFrame, most: int = 3, far: int = 0, sent_by: Callable = _sent, linked: Callable = _linked, near: Callable = _near,
    left: bool = False,
) -> DataFrame:
    """(a, b): links between rows of ``nodes``, (node long, prints array<long>, check binary), each with its own node and as
    many fingerprints as the others. Two rows are linked if one of their fingerprints differs in ``most`` <= 3 bits or
    fewer and, where ``check`` isn't empty, their checks differ in ``far`` bits or fewer.

    Of two fingerprints within 3 bits, one half differs in at most one bit. Each half has its covering code (see
    ``anchors``), so both meet at an anchor that is the home of one of them, of the one with the even half (see ``_sent``). Within an anchor the links are thinned to a
    forest, so that n alike rows give n - 1 links, not all pairs.

    An anchor with more than ``SIDE`` rows is left to a second pass (see ``square_links``). With ``left`` there is none: such
    anchors, and those that ``linked`` leaves, are returned as (anchor, null).

    ``sent_by`` sends the rows to other anchors, ``linked`` finds the links within a group of over 32 rows or of more
    links than rows, ``near`` says which rows of another one are linked.
    """
    if not 0 <= most <= 3:
        raise ValueError("most: 0 to 3; each half of a pair must differ in at most one bit")
    sent = nodes.mapInArrow(sent_by, SENT)
    found = _compared(sent, "anchor", most, far, linked, near)
    links = found if left else found.filter("nb is not null")
    large = found.filter("nb is null").select(F.col("na").alias("anchor"))
    if not left and large.limit(1).count():
        links = links.unionByName(square_links(written(sent.join(large, "anchor"), "busy"), most, far, linked, near))
    return links.select(F.col("na").alias("a"), F.col("nb").alias("b"))


def near_components(docs: DataFrame, words: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): for each row its fingerprint (16 hex digits) and the smallest id it reaches over
    links between fingerprints that differ in ``most`` bits or fewer. Ids are integers.

    Rows with the same fingerprint are linked by it: only different fingerprints are compared. Rows without words
    (null, empty, blank) share fingerprint 0. A null id stays null and never names a component (a component of null ids
    only has none); repeated rows are rows of their own. Every step is written, nothing is collected.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    # a fingerprint's own number, the smallest id that has it, names it among the links
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    sides = nodes.select(F.col("fp").alias("node"), F.array("fp").alias("prints"), F.lit("").cast("binary").alias("check"))
    named = components(near_links(sides, most))
    whole = nodes.join(named, nodes["fp"] == named["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("class")
    )
    whole = written(whole, "classes")
    least = written(whole.groupBy("class").agg(F.min("first").alias("component_id")), "least")
    ids = written(whole.join(least, "class").select("fp", "component_id"), "component_ids")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(ids, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
