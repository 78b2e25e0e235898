"""Chat formatting from event logs, with DataFrame functions only.

A log has one row per event: conversation, sequence number, message number, kind, role and text. Kinds:

* `message`: the message begins (anew) with this text, and takes this role;
* `delta`: the text is appended to the message;
* `edit`: the text replaces what the message has so far;
* `regenerate`: the message starts over, empty, and every later message that was begun before is dropped.

Logs are partitioned by conversation and sorted by sequence; each message is what its events since its last
`message`, `edit` or `regenerate` add up to. Final messages are rendered in order as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

where a run of backslashes between `<` and `|` inside a text or role gets one more, so that no control string is left in it
(`<|` becomes `<\\|`, `<\\|` becomes `<\\\\|`); `unescape` takes it away again.

One shuffle, by conversation. A conversation is one string in the end, so its rows must meet in one task; they are
sorted there by Spark, which spills, and only folded messages are gathered.

Nulls and edge cases: a null text or role counts as empty; events of a null kind, and deltas, edits or regenerations
of a message that has not begun, count too (the message then has an empty role, unless an event names one); a null
conversation is one of its own; ties in the sequence go by message, kind, role, text; repeated rows count each;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a line feed in a role; no escaped string has it in it.
LINE = "<|line|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def fold(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, message, role, text) of logs (conv_id, seq, message, kind, role, text)."""
    events = events.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    conversation = Window.partitionBy("conv_id")
    ordered = events.withColumn("n", F.row_number().over(conversation.orderBy("seq", "message", "kind", "role", "text")))
    regenerated = F.max(F.when(F.col("kind") == "regenerate", F.col("n"))).over(conversation.orderBy("message").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.max(F.when(F.col("kind") == "regenerate", F.col("n"))).over(Window.partitionBy("conv_id", "message"))
    earlier = F.when(regenerated > F.coalesce(own, F.lit(0)), regenerated)
    reset = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("n"))).over(Window.partitionBy("conv_id", "message"))
    live = ordered.withColumns({"earlier": earlier, "reset": reset}).where(F.col("earlier").isNull() | (F.col("n") > F.col("earlier")))
    parts = F.array_sort(F.collect_list(F.when(F.col("reset").isNull() | (F.col("n") >= F.col("reset")), F.struct("n", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))))
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("n")))
    return live.groupBy("conv_id", "message").agg(F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns) from messages (conv_id, message, role, text).

    `turns` has for each turn, in order, where it starts and ends and where its part of the loss mask starts and ends, as
    code points of `formatted`; the mask is empty (start = end) but for the texts of the assistant.
    """
    head = F.concat(F.lit(START), F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    said = messages.select("conv_id", "message", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("said"), (F.col("role") == LEARNED).alias("learned"))
    said = said.withColumn("piece", F.concat("head", "said", F.lit(END + "\n")))
    size = F.length("piece").cast("long")
    end = F.sum(size).over(Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = end - size
    begin = start + F.length("head")
    stop = F.when(F.coalesce("learned", F.lit(False)), begin + F.length("said")).otherwise(begin)
    placed = said.withColumns({"start": start, "end": end, "loss_start": begin, "loss_end": stop})
    turns = F.array_sort(F.collect_list(F.struct("start", "end", "loss_start", "loss_end", "piece")))
    whole = placed.groupBy("conv_id").agg(turns.alias("turns"))
    bare = F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["loss_start"].alias("loss_start"), t["loss_end"].alias("loss_end")))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), bare.alias("turns"))


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns) from event logs."""
    return render(fold(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted_chars, turns, loss) from what `render` returns: an array of (role, text), and the text under the mask, all unescaped.

    Only the string and its mask are read: the string is cut at its control strings, and the mask's parts out of the cuts.
    """
    pieces = F.filter(F.split("formatted", r"(?=<\|im_start\|>)"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, F.lit(len(START) + 1), F.length(piece)), "\n", 1)
        before = F.length(role) + len(START) + 1
        text = F.substring(piece, before + 1, F.length(piece) - before - len(END) - 1)
        return F.struct(unescape(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    def lost(both: Column) -> Column:
        mask = both["mask"]
        return unescape(F.substring(both["piece"], (mask["loss_start"] - mask["start"] + 1).cast("int"), (mask["loss_end"] - mask["loss_start"]).cast("int")))

    cut = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), pieces.alias("piece"), F.col("turns").alias("mask"))
    return cut.select("conv_id", "formatted_chars", F.transform("piece", turn).alias("turns"), F.array_join(F.transform(F.arrays_zip("piece", "mask"), lost), "").alias("loss"))
