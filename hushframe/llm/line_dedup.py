"""Line dedup: a suffix array over line ids by distributed prefix doubling; repeated runs lose their later copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .common import count_words, current, fresh, scratch, width, written

#: A repeated run counts from so many words on; shorter ones recur in texts that share no passage.
LEAST_WORDS = 10
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _ranked(keys: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Adds ``rank`` to different keys: a range-partitioned sort, then numbers that rise through the partitions."""
    tasks = width(keys.sparkSession)
    in_order = keys.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns)
    return written(in_order.withColumn("rank", F.monotonically_increasing_id()), label)


def numbered_lines(text: Column) -> Column:
    """(line, body) of the lines that aren't blank; ``line`` counts all lines from 0."""
    every = F.transform(F.split(text, "\n"), lambda body, i: F.struct(i.alias("line"), body.alias("body")))
    return F.filter(every, lambda x: x["body"].rlike(_HAS_WORD))


def suffix_ranks(lines: DataFrame, longest: int) -> DataFrame:
    """(level, row, at, rank): the places (row, at) in the order of the 2^level lines from there on, for all levels up to
    2^level <= ``longest``. ``lines`` has (row, at, rank). Equal ranks are equal lines: the classes of one level are the
    intervals of the suffix array whose longest common prefix has at least 2^level lines.

    Prefix doubling: the order of twice as many lines is the order of two ranks, that of the place and that of the place
    2^level further on. Places whose class has no other member cannot repeat for longer and are left out.
    """
    now = lines.select("row", "at", "rank")
    levels, level = [now.withColumn("level", F.lit(0))], 0
    while 2 << level <= longest:
        further = now.select("row", (F.col("at") - (1 << level)).alias("at"), F.col("rank").alias("r2"))
        pairs = written(now.withColumnRenamed("rank", "r1").join(further, ["row", "at"]), "pairs")
        repeated = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        names = _ranked(repeated, ["r1", "r2"], "names")
        now = written(pairs.join(names, ["r1", "r2"]).select("row", "at", "rank"), "ranks")
        level += 1
        levels.append(now.withColumn("level", F.lit(level)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _runs(active: DataFrame, least: int) -> DataFrame:
    """(doc, row, start, size): of each line the shortest run of at least ``least`` words that begins with it, and the
    shortest that ends with it, over unbroken stretches of repeated lines."""
    stretch = F.col("at") - F.row_number().over(Window.partitionBy("row").orderBy("at"))
    rows = active.withColumn("stretch", stretch)
    place = Window.partitionBy("row", "stretch")
    rows = rows.withColumn("upto", F.sum("words").over(place.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("words"))
    # the line that holds the word ``least - 1`` words further on, and the one that holds it so far back
    end = F.last(F.struct("at", "upto")).over(place.orderBy("before").rangeBetween(0, least - 1))
    begin = F.first(F.struct("at", "before")).over(place.orderBy("upto").rangeBetween(-(least - 1), 0))
    rows = rows.withColumn("end", end).withColumn("begin", begin)
    ahead = F.when(F.col("end.upto") - F.col("before") >= least, F.struct(F.col("at").alias("start"), (F.col("end.at") - F.col("at") + 1).alias("size")))
    back = F.when(F.col("upto") - F.col("begin.before") >= least, F.struct(F.col("begin.at").alias("start"), (F.col("at") - F.col("begin.at") + 1).alias("size")))
    both = F.array_distinct(F.filter(F.array(ahead, back), lambda r: r.isNotNull()))
    return rows.select("doc", "row", F.inline(both))


def dedup_lines(
    docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with shortened texts, and ``lines_removed`` beside them (``lines_removed_`` if there is such a column).

    A run of whole consecutive lines (blank ones don't count and don't interrupt) with ``least_words`` words or more that
    occurs earlier, in the order of id and place, is a later copy and is deleted; the first copy stays. Every line in any
    such run goes, so maximal repeated runs go whole. That is settled by each line's shortest sufficient runs: every longer
    repeated run is covered by these. A run of n lines is named by two overlapping ranks of the suffix array (see
    ``suffix_ranks``), so the array is sorted as deep as the longest of these runs needs.

    Texts split at ``\\n``; lines are equal if all their characters are. Blank lines stay. A null text stays null, an
    empty one empty; a text that loses all its lines becomes "". A null id comes first; of rows with the same id and
    different texts one comes first in every run; rows with the same id and text are one document, and each gets its new
    text. No rows give no rows.
    """
    row, gone_col, removed = fresh(docs, "row_key"), fresh(docs, "lines_gone"), fresh(docs, "lines_removed")
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("\x00"), F.col(text_col))
    keyed = docs.withColumn(row, F.substring(F.unhex(F.sha2(name, 256)), 1, 16))
    lines = keyed.select(
        F.col(id_col).alias("doc"), F.col(row).alias("row"), F.posexplode(numbered_lines(F.col(text_col))).alias("at", "x")
    )
    lines = lines.select(
        "doc", "row", "at", F.substring(F.unhex(F.sha2("x.body", 256)), 1, 16).alias("id"), count_words(F.col("x.body")).alias("words")
    )
    outer = current() or Workspace(docs.sparkSession)
    with scratch(docs.sparkSession):
        lines = written(lines, "lines")
        repeated = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        active = lines.join(_ranked(repeated, ["id"], "names"), "id").select("doc", "row", "at", "words", "rank")
        active = written(active.distinct(), "active")
        runs = written(_runs(active, least_words), "runs")
        longest = runs.agg(F.max("size")).first()[0] or 1
        ranks = suffix_ranks(active, longest)
        runs = runs.withColumn("level", F.floor(F.log2(F.col("size") + F.lit(0.5))).cast("int"))
        second = (F.col("start") + F.col("size") - F.pow(F.lit(2), F.col("level")).cast("int")).alias("second")
        at1 = ranks.select("level", "row", F.col("at").alias("start"), F.col("rank").alias("r1"))
        at2 = ranks.select("level", "row", F.col("at").alias("second"), F.col("rank").alias("r2"))
        named = runs.withColumn("second", second).join(at1, ["level", "row", "start"]).join(at2, ["level", "row", "second"])
        named = written(named.select("size", "r1", "r2", "doc", "row", "start"), "named")
        first = named.groupBy("size", "r1", "r2").agg(F.min(F.struct("doc", "row", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
        first = written(first.filter("n > 1").drop("n"), "first")
        later = named.join(first, ["size", "r1", "r2"]).filter(
            (F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))
        )
        places = later.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at"))
        gone = written(places.groupBy("row").agg(F.collect_set("at").alias("at")), "gone", outer)
    gone = gone.select(F.col("row").alias(row), F.col("at").alias(gone_col))
    out = keyed.join(gone, row, "left")
    lines_now = F.split(F.col(text_col), "\n")
    numbers = F.transform(numbered_lines(F.col(text_col)), lambda x: x["line"])
    lost = F.transform(F.col(gone_col), lambda a: F.get(numbers, a))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_now) - 1), lost)
    shorter = F.array_join(F.transform(stay, lambda i: F.get(lines_now, i)), "\n")
    text = F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(shorter)
    return out.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col(gone_col).isNull(), 0).otherwise(F.size(gone_col)).alias(removed))
