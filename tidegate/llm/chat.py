"""Chat formatting into windows with a token budget, in DataFrame functions only.

Running sums of the turns' tokens cut a conversation into spans of whole turns.  Each span
becomes a window: the system turn, the last turns before the span as far as the history budget
goes, and the span.  The loss mask covers the assistant texts of the span; a turn that is
repeated as history is not a target again.

The template puts every turn between ``<s>`` and ``</s>``; inside, a user's text stands between
``[INST]`` and ``[/INST]``, a system text between ``<<SYS>>`` and ``<</SYS>>``, an assistant's text
alone, and any other role between ``[ROLE]`` and ``[/ROLE]`` before its text.  In texts and roles
a backslash is doubled and one is put behind the first character of each of these strings, so
that none of them occurs but as a mark, and the text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import WORD

# Tokens and turns of a span; a single longer turn is a span of its own.
SPAN_TOKENS = 512
SPAN_TURNS = 64
# What is repeated before a span, at most.
HISTORY_TOKENS = 128
HISTORY_TURNS = 4

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
_MARK = r"([<\[])(?=s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _MARK, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _open(role: Column) -> Column:
    return (F.when(role == "user", "<s>[INST]").when(role == "system", "<s><<SYS>>")
            .when(role == "assistant", "<s>").otherwise(F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"))))


def _close(role: Column) -> Column:
    return F.when(role == "user", "[/INST]</s>").when(role == "system", "<</SYS>></s>").otherwise("</s>")


def windows(turns: DataFrame) -> DataFrame:
    """One row per window: ``conv_id``, ``window`` (from 1), ``n_repeated`` (turns at its start that
    are repeated), ``formatted`` and ``loss_mask`` (places of the targets in ``formatted``).

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not read.  Turns are
    in the order of ``turn``, null first, ties by role and text, repeated rows each for itself.
    A null role or text is empty; null ids are one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    tokens = F.regexp_count("text", F.lit(WORD)).cast("long")
    placed = (
        rows.withColumn("tokens", tokens)
        .withColumn("nr", F.row_number().over(order))
        .withColumn("start", F.sum("tokens").over(upto) - F.col("tokens"))
    )
    # Turns with the same cell at both ends fit into one span; one that crosses stands alone.
    last = F.greatest(F.col("start"), F.col("start") + F.col("tokens") - 1)
    cell = F.struct(F.floor(F.col("start") / SPAN_TOKENS), F.floor(last / SPAN_TOKENS),
                    F.floor((F.col("nr") - 1) / SPAN_TURNS))
    turn = F.struct("nr", "start", _open(F.col("role")).alias("open"), escape(F.col("text")).alias("text"),
                    _close(F.col("role")).alias("close"), (F.col("role") == "assistant").alias("target"),
                    (F.col("role") == "system").alias("system"))
    cut = (
        placed.select("conv_id", "turn", "role", "text", "nr", "start", cell.alias("cell"), turn.alias("item"))
        .withColumn("head", F.coalesce(F.lag("cell").over(order) != F.col("cell"), F.lit(True)))
        .withColumn("window", F.sum(F.col("head").cast("int")).over(upto))
        .withColumn("first", F.first("item").over(upto))
        .withColumn("before", F.collect_list("item").over(order.rowsBetween(-HISTORY_TURNS, -1)))
    )
    whole = F.col("first.system")
    history = F.filter("before", lambda h: (h["start"] >= F.col("start") - HISTORY_TOKENS) & ~(whole & (h["nr"] == 1)))
    system = F.when(whole & (F.col("nr") > 1), F.array("first")).otherwise(F.filter("before", lambda h: F.lit(False)))
    spans = (
        cut.select("conv_id", "window", "nr", "item", F.when(F.col("head"), F.concat(system, history)).alias("repeated"))
        .groupBy("conv_id", "window")
        .agg(F.sort_array(F.collect_list("item")).alias("span"), F.min_by("repeated", "nr").alias("repeated"))
    )
    items = F.concat(
        F.transform("repeated", lambda t: F.struct(t["open"].alias("open"), t["text"].alias("text"),
                                                   t["close"].alias("close"), F.lit(False).alias("target"))),
        F.transform("span", lambda t: F.struct(t["open"].alias("open"), t["text"].alias("text"),
                                               t["close"].alias("close"), t["target"].alias("target"))))
    none = F.array().cast("array<struct<start:int,length:int>>")
    mask = F.aggregate(
        "items", F.struct(F.lit(0).alias("at"), none.alias("mask")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["open"]) + F.length(t["text"]) + F.length(t["close"])).alias("at"),
            F.when(t["target"], F.concat(s["mask"], F.array(F.struct(
                (s["at"] + F.length(t["open"])).alias("start"), F.length(t["text"]).alias("length")))))
            .otherwise(s["mask"]).alias("mask")),
        lambda s: s["mask"])
    return spans.withColumn("items", items).select(
        "conv_id", "window", F.size("repeated").alias("n_repeated"),
        F.array_join(F.transform("items", lambda t: F.concat(t["open"], t["text"], t["close"])), "").alias("formatted"),
        mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Each window of ``windows`` with ``turns`` (role and text of those that are not repeated) and
    ``targets`` (the texts under the loss mask), both from ``formatted`` alone."""

    def inside(x: Column, opening: str, closing: str) -> Column:
        return x.substr(F.lit(len(opening) + 1), F.length(x) - len(opening) - len(closing))

    def parsed(x: Column) -> Column:
        role_end = F.instr(x, "[/ROLE]")
        return (
            F.when(x.startswith("[INST]"), F.struct(F.lit("user").alias("role"), inside(x, "[INST]", "[/INST]").alias("text")))
            .when(x.startswith("<<SYS>>"), F.struct(F.lit("system").alias("role"), inside(x, "<<SYS>>", "<</SYS>>").alias("text")))
            .when(x.startswith("[ROLE]"), F.struct(
                unescape(x.substr(F.lit(7), role_end - 7)).alias("role"),
                x.substr(role_end + 7, F.length(x)).alias("text")))
            .otherwise(F.struct(F.lit("assistant").alias("role"), x.alias("text"))))

    marked = F.split("formatted", "</s>")
    new = F.slice(marked, F.col("n_repeated") + 1, F.size(marked) - 1 - F.col("n_repeated"))
    turns = F.transform(
        F.transform(new, lambda x: parsed(x.substr(F.lit(4), F.length(x)))),
        lambda t: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text")))
    targets = F.transform("loss_mask", lambda m: unescape(F.col("formatted").substr(m["start"] + 1, m["length"])))
    return formatted.withColumn("turns", turns).withColumn("targets", targets)
