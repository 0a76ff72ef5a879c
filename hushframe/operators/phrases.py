"""Many fixed phrases in many texts.

The phrases are cut into shards of counted bytes. Each shard becomes one automaton, built in the tasks, and meets every text
in one pass; texts are neither cut into words nor shuffled, and only hits are put together when there is more than one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Bytes of the phrases of one automaton; in a task it takes about 60 times as much.
SHARD_BYTES = 2 << 20
#: Hits that leave a task at once.
PIECE = 1 << 16
HITS = "array<struct<identifier:string,start:int,end:int>>"


def shards(phrases: DataFrame, most: int = SHARD_BYTES) -> Iterator[list[str]]:
    """The phrases of the one column ``identifier``, in lists of about ``most`` bytes at most (a longer phrase is alone with
    those that share its hash). Phrases that are NULL or empty are in no list; without any there is no list."""
    usable = phrases.select("identifier").filter("identifier <> ''")
    size = usable.agg(F.coalesce(F.sum(F.octet_length("identifier")), F.lit(0))).first()[0]
    n = 1 + 2 * size // most  # hashed lists differ in size: half the bytes on average
    if n == 1:
        lists = [usable]
    else:
        numbered = usable.withColumn("shard", F.pmod(F.xxhash64("identifier"), F.lit(n)))
        # sorted by shard, so that each read skips the other shards' row groups
        kept = Workspace(phrases.sparkSession).keep(numbered.repartitionByRange("shard").sortWithinPartitions("shard"), "phrases")
        lists = [kept.filter(F.col("shard") == i) for i in range(n)]
    for part in lists:
        if found := sorted({r.identifier for r in part.select("identifier").collect()}):
            yield found


def hits_in(text: Column, shard: Broadcast) -> Column:
    """All occurrences of a shard's phrases in the case-folded text that have no word character on either side, overlapping
    ones included, as positions in the text as it is. NULL holds none.

    Hits are kept as numbers and leave the task in pieces of about ``PIECE``, and a text's own hits at the least. The function
    counts as not deterministic, so that a filter on its result doesn't make Spark evaluate it twice."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from array import array
        from unicodedata import category

        import ahocorasick
        import pyarrow as pa

        phrases = shard.value
        names = pa.array(phrases, pa.string())
        automaton = ahocorasick.Automaton()
        for i, phrase in enumerate(phrases):
            automaton.add_word(phrase, i)
        automaton.make_automaton()

        def in_word(folded, at):
            return 0 <= at < len(folded) and (folded[at] == "_" or category(folded[at])[0] in "LN")

        def listed(ends, which, first, last):
            def ints(values):
                return pa.array(values, pa.int32())

            fields = [pa.field("identifier", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32())]
            hits = pa.StructArray.from_arrays([names.take(ints(which)), ints(first), ints(last)], fields=fields)
            return pa.ListArray.from_arrays(ints(ends), hits)

        def empty():
            return array("i", [0]), array("i"), array("i"), array("i")

        for texts in batches:
            ends, which, starts, stops = empty()
            for each in texts:
                if (text := each.as_py()) is not None:
                    folded = text.casefold()
                    # folding never shortens: only where it lengthens do positions move
                    origin = None if len(folded) == len(text) else [i for i, ch in enumerate(text) for _ in ch.casefold()]
                    for last, i in automaton.iter(folded):
                        start = last + 1 - len(phrases[i])
                        if not in_word(folded, start - 1) and not in_word(folded, last + 1):
                            which.append(i)
                            starts.append(start if origin is None else origin[start])
                            stops.append(last + 1 if origin is None else origin[last] + 1)
                ends.append(len(which))
                if len(which) >= PIECE:
                    yield listed(ends, which, starts, stops)
                    ends, which, starts, stops = empty()
            if len(ends) > 1 or not len(texts):
                yield listed(ends, which, starts, stops)

    # hints by hand: the tasks needn't import Arrow to read them
    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, HITS).asNondeterministic()(text)


def with_hits(texts: DataFrame, key: str, column: str, phrases: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """``texts`` with their hits in the new column ``known`` (never NULL); ``key`` names a text."""
    context = texts.sparkSession.sparkContext
    sent = [context.broadcast(s) for s in shards(phrases, most)]
    if not sent:
        return texts.withColumn("known", F.array().cast(HITS))
    if len(sent) == 1:
        return texts.withColumn("known", hits_in(F.col(column), sent[0]))
    found = None
    for shard in sent:
        one = texts.select(key, hits_in(F.col(column), shard).alias("known")).filter(F.size("known") > 0)
        found = one if found is None else found.unionByName(one)
    per_text = found.groupBy(key).agg(F.flatten(F.collect_list("known")).alias("known"))
    return texts.join(per_text, key, "left").withColumn("known", F.coalesce("known", F.array().cast(HITS)))
