"""Byte-level BPE: encoding with a queue of merge ranks over a linked list of symbols, decoding by vocabulary strings."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The split pattern of byte-level BPE with the white space of Unicode's property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|"
    r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The same classes within U+0000 to U+00FF, for texts that hold nothing else: letters, numbers, white space.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
SPLIT_LATIN = rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Distinct words in each of the two generations that a task remembers. Words met again move to the young one; when that is
#: full it becomes the old one, so that frequent words stay. This changes no result.
REMEMBERED = 150_000
#: Words longer than this aren't remembered.
LONG_WORD = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Codec:
    """Encodes and decodes with a tokenizer file's vocabulary and merges (``definition`` is the file's text)."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.first = [vocab[c] for c in letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: rank of each pair of ids, by first id * 2^20 + second id; made: the id that a rank's merge makes
        self.rank, self.made = {}, []
        for a, b in pairs:
            self.rank[(vocab[a] << 20) + vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = vocab | self.added
        self.piece = [b""] * (max(strings.values()) + 1)
        for s, i in strings.items():
            own = [of_letter.get(c) for c in s]
            self.piece[i] = s.encode() if None in own else bytes(own)
        self.split, self.split_latin = regex.compile(SPLIT), re.compile(SPLIT_LATIN)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        #: ids of words as bytes of 32-bit numbers
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(len(self.piece))]

    def merged(self, word: str) -> list[int]:
        """Ids of one word. The queue holds rank * length + place of the left symbol; an entry is stale when the pair that
        now stands at its place has another rank."""
        ids = [self.first[b] for b in word.encode()]
        n, find, made = len(ids), self.rank.get, self.made
        here = [find((a << 20) + b, -1) for a, b in zip(ids, ids[1:])]
        here.append(-1)
        queue = [r * n + i for i, r in enumerate(here) if r >= 0]
        heapify(queue)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            r = entry // n
            i = entry - r * n
            if here[i] != r:
                continue
            j = after[i]
            new = ids[i] = made[r]
            ids[j] = here[j] = -1
            k = after[i] = after[j]
            if k < n:
                ahead[k] = i
                s = here[i] = find((new << 20) + ids[k], -1)
                if s >= 0:
                    heappush(queue, s * n + i)
            else:
                here[i] = -1
            h = ahead[i]
            if h >= 0:
                s = here[h] = find((ids[h] << 20) + new, -1)
                if s >= 0:
                    heappush(queue, s * n + h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, words from memory where they have been met."""
        if self.marks and any(m in text for m in self.added):
            parts = enumerate(self.marks.split(text))
            packed = b"".join([array("i", [self.added[p]]).tobytes() if i % 2 else self.plain(p) for i, p in parts])
        else:
            packed = self.plain(text)
        return memoryview(packed).cast("i").tolist()

    def plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            words = self.split_latin.findall(text)
        except UnicodeEncodeError:
            words = self.split.findall(text)
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old, own = self.young, self.old, {}
        for word in set(words).difference(young):
            if len(word) > LONG_WORD:
                own[word] = array("i", self.merged(word)).tobytes()
            else:
                young[word] = old.get(word) or array("i", self.merged(word)).tobytes()
        return b"".join([young[w] for w in words] if not own else [young.get(w) or own[w] for w in words])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


def read_definition(path: str) -> str:
    """The tokenizer file, read once by the driver; it is sent to the tasks, so executors need no copy of it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def shared_codec(spark: SparkSession, path: str):
    """A function that gives a task its codec, built once for each Python worker."""
    sent = spark.sparkContext.broadcast(read_definition(path))
    return lambda: _codec(sent.value)


@lru_cache(maxsize=2)
def _codec(definition: str) -> Codec:
    return Codec(definition)


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_digests: bool = False
) -> DataFrame:
    """One row for each row of ``docs``: (id, n_tokens), with ``ids`` and ``decoded`` if ``with_ids``, and with
    ``ids_sha256`` and ``decoded_sha256`` if ``with_digests``, for callers that need no more than that.

    Whole texts are encoded as the tokenizer's library does without adding special tokens: the strings of added tokens
    become their ids, everything else is split into words and merged. A null text counts as empty: no ids, "" decoded.
    Ids are passed through, null or repeated; no rows give no rows. Texts never leave their task and no row waits for another.
    """
    codec_of = shared_codec(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long"
    schema += ", ids array<int>, decoded string" if with_ids else ""
    schema += ", ids_sha256 string, decoded_sha256 string" if with_digests else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # ids take several times the room of their text
                part = batch.slice(at, 64)
                out: list[list] = [[] for _ in range(5)]
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text)
                    decoded = codec.decode(ids)
                    out[0].append(len(ids))
                    if with_ids:
                        out[1].append(ids)
                        out[2].append(decoded)
                    if with_digests:
                        listed = ",".join(map(codec.decimal.__getitem__, ids))
                        out[3].append(hashlib.sha256(listed.encode()).hexdigest())
                        out[4].append(hashlib.sha256(decoded.encode()).hexdigest())
                cols = [part.column(0), pa.array(out[0], pa.int64())]
                names = ["id", "n_tokens"]
                if with_ids:
                    cols += [pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.string())]
                    names += ["ids", "decoded"]
                if with_digests:
                    cols += [pa.array(out[3], pa.string()), pa.array(out[4], pa.string())]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
