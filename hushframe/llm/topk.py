"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import width, written

#: Rows of one block of the index, at most; queries of one chunk; chunks that one copy of a block serves.
BLOCK, CHUNK, SERVED = 8192, 256, 64
#: Blocks of the index at least, so that a small table keeps several tasks busy.
LEAST_BLOCKS = 16
#: Quantised components beyond this are refused: their products would leave 64 bits.
LARGEST = 1 << 24
_ALL = ~np.uint64(0)


def quantise(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def valid(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    )
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bitmaps, offsets, bits) of a block's integer columns: column d is offset d plus the bitmaps of its ``bits[d]``
    slices, least significant first. Bitmaps have a bit for each row, padded to whole words."""
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    bits = np.array([int(x).bit_length() for x in above.max(axis=0)], np.int64)
    pad = -len(values) % 64
    maps = []
    for d, b in enumerate(bits):
        for j in range(b):
            on = np.append((above[:, d] >> np.uint64(j)) & np.uint64(1), np.zeros(pad, np.uint64)).astype(np.uint8)
            maps.append(np.packbits(on, bitorder="little").view(np.uint64))
    words = (len(values) + pad) // 64
    return np.array(maps, np.uint64).reshape(-1, words), low, bits


def _summed(levels: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Adds bitmaps by bitmap arithmetic: ``levels[l]`` is (queries, bitmaps, words), each bitmap worth 2^l where set. Full
    adders turn three bitmaps of a level into one there and one a level up, until each level has one. The result is the
    sum's slices, least significant first."""
    out, level = [], 0
    while levels:
        x = levels.pop(level, None)
        while x is not None and x.shape[1] > 1:
            if x.shape[1] == 2:
                a, b = x[:, :1], x[:, 1:]
                total, carry = a ^ b, a & b
            else:
                m = x.shape[1] // 3
                a, b, c, rest = x[:, :m], x[:, m : 2 * m], x[:, 2 * m : 3 * m], x[:, 3 * m :]
                half = a ^ b
                total, carry = np.concatenate([half ^ c, rest], axis=1), (a & b) | (half & c)
            up = levels.get(level + 1)
            levels[level + 1] = carry if up is None else np.concatenate([up, carry], axis=1)
            x = total
        out.append(None if x is None else x[:, 0])
        level += 1
    return out


def _best(slices: list[np.ndarray | None], alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sure, tied) rows of each query as bitmaps: from the most significant slice down, rows that are surely among the k
    highest, and rows that tie at the boundary."""
    sure, tied = np.zeros_like(alive), alive.copy()
    for s in reversed(slices):
        if s is None:
            continue
        more = sure | (tied & s)
        n = np.bitwise_count(more).sum(axis=1, dtype=np.int64)[:, None]
        many, few = n > k, n < k
        sure = np.where(many, sure, more)
        tied = np.where(many, tied & s, np.where(few, tied & ~s, np.zeros_like(tied)))
    return sure, tied


def _at_least(slices: list[np.ndarray | None], least: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Rows of each query whose sum is its ``least`` or more, by comparing slices from the most significant one down."""
    least = least[:, None]
    above, even = np.zeros_like(alive), np.where(least >> len(slices) > 0, 0, alive)
    for level in reversed(range(len(slices))):
        s, one = slices[level], (least >> level) & 1 == 1
        if s is None:  # nobody has this bit
            even = np.where(one, 0, even)
            continue
        above = np.where(one, above, above | (even & s))
        even = even & np.where(one, s, ~s)
    return np.where(least <= 0, alive, above | even)


def _digits(queries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(level, sign, where) of the signed binary digits of integers, no two neighbours of which are set: fewer than bits."""
    size = np.abs(queries)
    half = size >> 1
    sum_ = size + half
    plus, minus = sum_ & (half ^ sum_), half & (half ^ sum_)
    for level in range(int(size.max(initial=0)).bit_length() + 1):
        for digit, sign in ((plus, 1), (minus, -1)):
            on = (digit >> level) & 1 == 1
            for s in (1, -1):
                yield level, s, on & ((queries > 0) if s == sign else (queries < 0))


def search_block(ids: np.ndarray, values: np.ndarray, index, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query, row, score) of each query's k best rows of one block, ``ids`` sorted. ``index`` is ``slices_of`` the values.

    Queries are rounded to multiples of a step. The sums of the rounded ones are added up from the slices by bitmap
    arithmetic; the k best of them, picked from the most significant slice down, have exact scores of which the lowest is a
    threshold. What rounding may have changed is at most the product of the remainder's and the longest row's lengths: all
    rows whose sum reaches the threshold less that, found from the slices again, are scored exactly."""
    maps, low, bits = index
    words = maps.shape[1]
    first = np.append(0, np.cumsum(bits))
    alive = np.packbits(np.append(np.ones(len(ids), np.uint8), np.zeros(words * 64 - len(ids), np.uint8)), bitorder="little")
    table = np.concatenate([maps, ~maps, np.zeros((1, words), np.uint64)])  # a digit's sign picks a bitmap or its complement
    none = len(table) - 1
    longest = float(np.sqrt((values.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    at_q, at_row, at_score = [], [], []
    group = max(1, min(len(queries), (1 << 22) // max(1, words * 64 * 2)))
    for at in range(0, len(queries), group):
        q = queries[at : at + group]
        typical = float(np.sqrt((q.astype(np.float64) ** 2).mean())) if q.size else 0.0
        shift = max(0, int(typical).bit_length() - 2)
        rounded = (q + (1 << shift >> 1)) >> shift
        rest = np.sqrt(((q - (rounded << shift)).astype(np.float64) ** 2).sum(axis=1))
        slack = np.ceil(rest * longest * (1 + 1e-9)).astype(np.int64)
        who, what, level = [], [], []
        taken = np.zeros(len(q), np.int64)  # what complements add to the sums
        for v, sign, on in _digits(rounded):
            i, d = np.nonzero(on)
            own = bits[d]
            each = np.repeat(np.arange(len(i)), own)
            b = np.arange(len(each)) - np.repeat(np.cumsum(own) - own, own)
            who.append(i[each])
            what.append(first[d[each]] + b + (len(maps) if sign < 0 else 0))
            level.append(v + b)
            if sign < 0:
                np.add.at(taken, i, ((np.int64(1) << own) - 1) << v)
        levels = {}
        who, what, level = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, what, level))
        order = np.lexsort((who, level))
        who, what, level = who[order], what[order], level[order]
        ends = np.searchsorted(level, np.arange(level.max(initial=-1) + 2))
        for lv, (x, y) in enumerate(zip(ends, ends[1:])):
            if x < y:
                w = who[x:y]
                place = np.arange(y - x) - np.searchsorted(w, w)
                pick = np.full((len(q), int(place.max()) + 1), none)
                pick[w, place] = what[x:y]
                levels[lv] = table[pick]
        here = np.repeat(alive.view(np.uint64)[None], len(q), axis=0)
        own = np.searchsorted(ids, query_ids[at : at + group])
        for i, x in enumerate(query_ids[at : at + group]):
            for r in range(own[i], len(ids)):
                if ids[r] != x:
                    break
                here[i, r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        sums = _summed(levels)
        sure, tied = _best(sums, here, k)
        threshold = np.zeros(len(q), np.int64)
        for i in range(len(q)):
            rows = _rows_of(sure[i])
            rows = np.append(rows, _rows_of(tied[i])[: k - len(rows)])
            # with fewer than k rows, all are wanted
            threshold[i] = (values[rows] @ q[i]).min() if len(rows) == k else np.iinfo(np.int64).min // 4
        floor = (threshold - slack + (1 << shift) - 1) >> shift
        wanted = _at_least(sums, np.maximum(floor - rounded @ low + taken, 0), here)
        for i in range(len(q)):
            rows = _rows_of(wanted[i])
            score = values[rows] @ q[i]
            best = np.lexsort((rows, -score))[:k]  # ties go to the smaller id
            at_q.append(np.full(len(best), at + i))
            at_row.append(rows[best])
            at_score.append(score[best])
    return np.concatenate(at_q), np.concatenate(at_row).astype(np.int64), np.concatenate(at_score)


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[0]


def _pack(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and id; one row for each group of up to ``by`` rows: its ids and components as bytes."""
    held: tuple[int, list[int], list[list[int]]] | None = None

    def packed(group: int, ids: list[int], rows: list[list[int]]) -> pa.RecordBatch:
        wide = max(map(len, rows))
        m = np.zeros((len(rows), wide), np.int64)
        for i, r in enumerate(rows):
            m[i, : len(r)] = r
        if m.size and np.abs(m).max() > LARGEST:
            raise ValueError(f"a quantised component lies beyond {LARGEST}")
        return pa.RecordBatch.from_arrays(
            [pa.array([group]), pa.array([wide]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([m.astype(np.int32).tobytes()])],
            ["group", "wide", "ids", "data"],
        )

    for batch in batches:
        for g, i, v in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held[0] != g or len(held[1]) >= by:
                if held:
                    yield packed(*held)
                held = (g, [], [])
            held[1].append(i)
            held[2].append(v)
    if held:
        yield packed(*held)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64
) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest integer inner products over all other rows, ties to the smaller
    id; all rows where there are fewer than k.

    Components become floor(scale * x). Rows are dealt evenly to blocks, each block is indexed by bit slices, and every
    chunk of queries meets every block once: an exact search compares all queries with all rows, and the pairs of block
    and chunk are spread over the tasks. Within a block see ``search_block``. Blocks' results are merged by query.

    Vectors that are null or hold a null, NaN or infinite component take no part, as queries or as rows; shorter vectors
    count as filled up with zeros, empty ones score 0. A null id takes no part. Rows with a query's own id are left out
    for that query; repeated ids are rows of their own otherwise. Ids are integers. Of
    queries with the same id the one with the least vector is asked. No queries or rows give no rows.
    """

    def ready(df: DataFrame) -> DataFrame:
        rows = df.filter(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
        return rows.select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vector_col), scale).alias("v"))

    spark = vectors.sparkSession
    tasks = width(spark)
    rows = written(ready(vectors), "vectors")
    asked = written(ready(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(LEAST_BLOCKS, -(-rows.count() // (BLOCK * 3 // 4)))
    chunks = max(1, -(-asked.count() // CHUNK))
    packed = "group long, wide long, ids binary, data binary"

    def dealt(df: DataFrame, groups: int, by: int, label: str) -> DataFrame:
        group = F.pmod(F.xxhash64("id"), F.lit(groups))
        out = df.select(group.alias("group"), "id", "v").repartition(min(tasks, groups), "group")
        return written(out.sortWithinPartitions("group", "id").mapInArrow(lambda it: _pack(it, by), packed), label)

    index = dealt(rows, blocks, BLOCK, "index").withColumn("kind", F.lit(0))
    turns = -(-chunks // SERVED)
    index = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    # chunks go to the numbers of the blocks: a pair is a row of 256 queries that meets its block in the same task
    chunk = (
        dealt(asked, chunks, CHUNK, "chunks").withColumn("kind", F.lit(1))
        .withColumn("turn", F.floor(F.col("group") / SERVED).cast("int"))
        .withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    )
    pairs = index.unionByName(chunk).withColumn("place", F.col("group") * turns + F.col("turn"))
    pairs = pairs.repartitionByRange(max(min(tasks, blocks), -(-blocks * turns // 8)), "place")
    pairs = pairs.sortWithinPartitions("place", "kind").select("place", "kind", "wide", "ids", "data")
    found = pairs.mapInArrow(lambda it: _search(it, k), "query_id long, id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return (
        found.withColumn("rank", best).filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by place and kind: a block, then the chunks of queries that meet it."""
    place, blocks = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            here, kind, wide = (batch.column(i)[at].as_py() for i in range(3))
            ids = np.frombuffer(batch.column(3)[at].as_py(), np.int64)
            m = np.frombuffer(batch.column(4)[at].as_py(), np.int32).reshape(len(ids), wide).astype(np.int64)
            if here != place:
                place, blocks = here, []
            if kind == 0:
                blocks.append((ids, m, slices_of(m)))
                continue
            for own, values, index in blocks:
                w = min(wide, values.shape[1])  # further components meet zeros
                q = np.zeros((len(m), values.shape[1]), np.int64)
                q[:, :w] = m[:, :w]
                qs, rows, scores = search_block(own, values, index, ids, q, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[qs]), pa.array(own[rows]), pa.array(scores)], ["query_id", "id", "score"]
                )
