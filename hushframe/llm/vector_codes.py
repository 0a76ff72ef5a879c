"""Vector code compression: parts of vectors as numbers of codebook entries, found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .topk import valid

#: Vectors compared at once.
ROWS = 1 << 13
#: A table of sums by label above this many bytes isn't sent around.
LABEL_BYTES = 8 << 20
_END = np.int64(1) << 40
_MOST = (1 << 62) - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]`` holds part p's entries: (parts, entries, dimension of a part) integers."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Digest of all components by part, entry and position, as comma-joined decimals."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        at = [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
        return [x / self.scale for p, e in enumerate(at) for x in self.entries[p, e].tolist()]


def largest(wide: int, parts: int) -> int:
    """Components up to this keep every squared distance, and its product with the dimension, within 64 bits."""
    return min(isqrt(_MOST // (wide * max(wide, parts))) // 2, (1 << 31) - 1)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row; ties go to the lower entry.

    Entries are sorted by the sum of their components. From the place of a row's own sum the search goes outwards, each time
    to the side with the smaller gap. A squared gap of sums is at most the dimension times the squared distance, so a row is
    done when the next one exceeds the dimension times its best distance; strictly, for with an equal one it may still tie."""
    wide = rows.shape[1]
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    line = np.concatenate([[-_END], sums[order], [_END]])
    own = rows.sum(axis=1)
    up = np.searchsorted(line, own)
    down = up - 1
    best = np.full(len(rows), _MOST // wide)
    entry = np.full(len(rows), len(entries))
    left = np.arange(len(rows))
    while len(left):
        above, below = line[up[left]] - own[left], own[left] - line[down[left]]
        rises = above <= below
        gap = np.where(rises, above, below)
        live = (gap < _END // 2) & (gap * gap <= best[left] * wide)  # past the last entry a gap is about _END
        left, rises = left[live], rises[live]
        which = order[np.where(rises, up[left], down[left]) - 1]
        up[left] += rises
        down[left] -= ~rises
        off = rows[left] - entries[which]
        distance = np.einsum("ij,ij->i", off, off)
        better = (distance < best[left]) | ((distance == best[left]) & (which < entry[left]))
        won = left[better]
        best[won], entry[won] = distance[better], which[better]
    return entry, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to ``dims``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows whose vector is neither null nor holds a null, NaN or infinite component."""
    kept = vectors.filter(valid(F.col(vector_col)))
    ints = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), ints.alias("v"))


def learn_codebooks(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of (id, label, v), or None where there are no rows.

    A part's codebook starts as that part of the first ``entries`` rows by id (then by vector; null ids last). Each round
    assigns every part to its nearest entry and moves each entry to the floor of its parts' mean; unused entries stay. A
    round is one pass: tasks add up their parts by entry, and parts x entries rows meet, which the driver reads."""
    dims, low, high = rows.agg(
        F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))
    ).first()
    if dims is None:
        return None
    wide = max(1, -(-dims // parts))
    if max(abs(low or 0), abs(high or 0)) > largest(wide, parts):
        raise ValueError(f"a quantised component lies beyond {largest(wide, parts)}")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((len(first), parts * wide), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = r["v"]
    books = start.reshape(len(first), parts, wide).transpose(1, 0, 2)
    for _ in range(rounds):
        found = rows.mapInArrow(_adding(books), "part int, entry int, n long, s array<long>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(wide))
        )
        books = books.copy()
        for r in found.collect():
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(wide)]
    return Codebooks(books, scale)


def _adding(books: np.ndarray):
    """A task's sums of parts by part and entry."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                m = _matrix(batch.column(batch.schema.get_field_index("v")).slice(at, ROWS), parts * wide)
                for p in range(parts):
                    own = m[:, p * wide : (p + 1) * wide]
                    entry, _ = nearest(own, books[p])
                    n[p] += np.bincount(entry, minlength=entries)
                    np.add.at(s[p], entry, own)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(s[p, e].tolist(), pa.list_(pa.int64()))],
            ["part", "entry", "n", "s"],
        )

    return run


def encode_vectors(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): two hex digits for each part's entry, and the squared distances summed over the parts."""
    parts, _, wide = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "label", "v"))
            for at in range(0, batch.num_rows, ROWS):
                m = _matrix(vectors.slice(at, ROWS), parts * wide)
                found = [nearest(m[:, p * wide : (p + 1) * wide], books.entries[p]) for p in range(parts)]
                code = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, ROWS), labels.slice(at, ROWS), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(sum(d for _, d in found))],
                    ["id", "label", "code", "error"],
                )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): each kept vector as the numbers of its parts' nearest entries.

    Components become floor(scale * x); vectors are cut into ``parts`` equal parts, each with a codebook of ``entries`` <=
    256 (see ``learn_codebooks``). ``label_error`` is the error summed over all rows of the same label, nulls together.

    Rows whose vector is null or holds a null, NaN or infinite component are dropped. Vectors of other lengths count as
    filled up with zeros to the longest one, or to a multiple of ``parts``; an empty vector is all zeros. Repeated rows and
    ids, and null ids, are rows of their own. Components beyond ``largest`` are refused. No kept rows give no rows.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries: 1 to 256; parts: 1 or more")
    rows = written(integer_vectors(vectors, scale, id_col, vector_col, label_col), "vectors")
    books = learn_codebooks(rows, parts, entries, rounds, scale)
    if books is None:
        empty = rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit(""))
    coded = written(encode_vectors(rows, books), "codes")
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    n, size = sums.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.length(F.col("of").cast("string")), F.lit(0)))).first()
    beside = F.broadcast(sums) if 16 * n + 4 * (size or 0) <= LABEL_BYTES else sums
    return coded.join(beside, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
