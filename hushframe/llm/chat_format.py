"""Chat formatting into budgeted, turn-aligned windows with a loss mask, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of the template. All begin with "<|", which an escaped text never holds.
NEW, AGAIN, SAYS, END = "<|turn|>", "<|again|>", "<|says|>", "<|end|>"
# Control strings of this and of other common templates: "<|", "<s>", "</s>", "[INST]", "[/INST]". Any number of
# backslashes may stand after the first character; escaping adds one, unescaping takes one away.
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def turn_cost(text: Column) -> Column:
    """Estimated tokens of a turn: one for four characters, and four for its marks."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def format_windows(
    conversations: DataFrame,
    budget: int = 1024,
    history: int = 256,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    cost=turn_cost,
) -> DataFrame:
    """(conv_id, window, first_turn, formatted, loss_spans): one row for each window of each conversation.

    Prefix sums of turn costs place every turn on a line that is cut each ``budget``: turns that lie between two cuts
    form a span, a turn across a cut is a span of its own. A span of several turns so keeps within the budget, and no
    turn is split. A window is its span, before it the earlier turns that start at most ``history`` tokens back, and
    before these the conversation's first system turn, if it comes before the span and isn't there already. Repeated turns carry
    the mark ``<|again|>``. ``loss_spans`` are the places (code points, end exclusive) of the assistant texts of the
    span: each assistant text is a target in exactly one window.

    Turns are taken in the order of turn, role, text (nulls first); repeated rows are turns of their own. A null text
    or role is empty. Rows without a conversation id form one conversation. No rows give no windows. A very long turn is a
    window of its own, whole. A conversation is sorted in one task, as its digests need all of its turns in order.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("plain_role"), text.alias("plain"),
        escape(role).alias("role"), escape(text).alias("body"),
    )
    rows = rows.withColumn("said", F.concat("role", F.lit(SAYS), "body", F.lit(END))).withColumn("cost", cost(F.col("body")))
    in_order = Window.partitionBy("conv").orderBy("turn", "plain_role", "plain")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        rows.withColumn("pos", F.row_number().over(in_order))
        .withColumn("start", F.sum("cost").over(so_far) - F.col("cost"))
        .withColumn("chars", F.length("said") + len(NEW))
        .withColumn("char", F.sum("chars").over(so_far) - F.col("chars"))
        .withColumn("system", F.first(F.when(F.col("plain_role") == "system", F.struct("pos", "said")), ignorenulls=True).over(so_far))
        .withColumn("block", F.floor(F.col("start") / budget))
        .withColumn(
            "span", 2 * F.col("block") + (F.floor((F.col("start") + F.col("cost") - 1) / budget) > F.col("block")).cast("long")
        )
    )
    recent = Window.partitionBy("conv").orderBy("start").rangeBetween(-history, -1)
    rows = rows.withColumn("before", F.collect_list(F.struct("pos", "said")).over(recent))
    lead = F.min(F.struct("pos", "char", "before", "system"))
    turns = F.sort_array(F.collect_list(F.struct("pos", "char", "role", "body", "said", "plain_role")))
    spans = rows.groupBy("conv", "span").agg(lead.alias("lead"), turns.alias("turns"))
    past = F.transform("lead.before", lambda t: F.concat(F.lit(AGAIN), t["said"]))
    system = F.col("lead.system")
    there = F.exists("lead.before", lambda t: t["pos"] == system["pos"])
    with_system = F.coalesce((system["pos"] < F.col("lead.pos")) & ~there, F.lit(False))
    head = F.concat(F.when(with_system, F.concat(F.lit(AGAIN), system["said"])).otherwise(""), F.array_join(past, ""))
    spans = spans.withColumn("head", head)

    def place(t: Column) -> Column:
        begin = F.length("head") + t["char"] - F.col("lead.char") + len(NEW) + F.length(t["role"]) + len(SAYS)
        return F.struct(begin.cast("int").alias("start"), (begin + F.length(t["body"])).cast("int").alias("end"))

    own = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(NEW), t["said"])), "")
    targets = F.filter("turns", lambda t: t["plain_role"] == "assistant")
    return spans.select(
        F.col("conv").alias(conv_col), F.col("span").alias("window"), F.col("lead.pos").alias("first_turn"),
        F.concat("head", own).alias("formatted"), F.transform(targets, place).alias("loss_spans"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) out of formatted windows alone: ``turns`` holds role and text of each
    turn once, in order; ``loss_text`` all text under the loss mask. Both are unescaped. No windows give no rows."""
    said = F.filter(F.split("formatted", r"\Q" + END + r"\E"), lambda p: p.startswith(NEW))
    turns = F.transform(
        said,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(NEW) + 1, 1 << 30), SAYS, 1)).alias("role"),
            unescape(F.substring_index(p, SAYS, -1)).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    parts = windows.select(
        F.col(conv_col).alias("conv"), "window", turns.alias("turns"), F.array_join(loss, "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    each = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    return (
        parts.groupBy("conv").agg(each.alias("each"), F.sum("chars").alias("formatted_chars"))
        .select(
            F.col("conv").alias(conv_col), F.flatten("each.turns").alias("turns"),
            F.array_join("each.loss", "").alias("loss_text"), "formatted_chars",
        )
    )


def digests(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The digest columns of ``read_back``'s rows."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
