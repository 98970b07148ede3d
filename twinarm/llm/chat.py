"""Chat formatting from event logs, with DataFrame functions only.

A log row is (conv_id, seq, message_id, turn, role, kind, text). ``kind`` is one of

* ``message``     the message's text is this text (a whole message in one event)
* ``delta``       append this text to the message
* ``edit``        replace what the message holds with this text
* ``regenerate``  discard what the message holds, and all that was logged before for later turns

The log is partitioned by conversation once; within one, events are sorted by seq and folded message by message, and the messages are rendered in the same partition. A
conversation's formatted text is one value in the end, so its events have to meet; a window passes over them and spills.

Defined results: a null text counts as empty, a null or unknown kind as ``message``, a null role as the empty role; a null seq comes before all others; events of
equal seq fold in order of kind and text and are not before each other; an event belongs to the turn that it names, its message to the least of those that are left, a null
turn before all others; a message of which no event is left is gone; turns that tie are ordered by first seq, role and text; repeated rows
with their own message_id are messages of their own; a null conv_id is a conversation like any other; an empty log gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Make a text free of ``<|``, reversibly: backslashes double, then ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Invert :func:`escape`. ``<`` before a single backslash never comes from doubling, so the two replacements don't interfere."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`, and a newline, which ends the role in the header, becomes ``<\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    """Invert :func:`escape_role`."""
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, turn, role, first_seq, text)."""
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise(F.lit("message"))
    named = events.select("conv_id", "message_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    # The last regeneration of an earlier turn: what was logged before it is discarded.
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_ends").rowsBetween(Window.unboundedPreceding, 0)
    # A turn's own regenerations stand behind all its events in this order, so they count for later turns only.
    ends = F.explode(F.when(F.col("kind") == "regenerate", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    spread = named.withColumn("_ends", ends).withColumn("cut", F.max(F.when(F.col("_ends") == 1, F.col("seq"))).over(first)).where("_ends = 0")
    kept = spread.withColumn("cut", F.when(F.col("turn").isNotNull(), F.col("cut"))).where(F.col("cut").isNull() | F.coalesce(F.col("seq") >= F.col("cut"), F.lit(False)))
    folded = kept.groupBy("conv_id", "message_id").agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("turn"),
        F.max_by("role", F.struct("seq", "kind", "text")).alias("role"),
        F.min(F.struct(F.col("seq").isNotNull(), "seq")).alias("first_seq"),
        F.sort_array(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"),
    )
    # What counts begins at the last event that isn't a delta.
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(0)))
    live = F.slice("log", last + 1, F.size("log") - last)
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"])), "")
    return folded.select("conv_id", "message_id", F.col("turn.turn").alias("turn"), "role", F.col("first_seq.seq").alias("first_seq"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and parts, an array of (text, loss) whose texts concatenate to formatted.

    The loss mask covers the (escaped) text of assistant turns.
    """
    turn = F.struct(
        "turn",
        "first_seq",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("loss"),
    )
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def parts(t: Column) -> Column:
        def part(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(part(t["head"], F.lit(False)), part(t["body"], t["loss"]), part(F.lit(END + "\n"), F.lit(False)))

    whole = turns.select("conv_id", F.flatten(F.transform("turns", parts)).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), "parts")


def parse(formatted: Column) -> Column:
    """Read turns back from formatted text: array of (role, text), unescaped."""
    chunks = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda _, i: i > 0)

    def turn(chunk: Column) -> Column:
        role = F.substring_index(chunk, "\n", 1)
        head = F.length(role)
        body = F.substr(chunk, head + 2, F.length(chunk) - head - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(chunks, turn)


def format_chats(events: DataFrame) -> DataFrame:
    """Event log to rendered conversations: :func:`fold_events`, then :func:`render`."""
    return render(fold_events(events))
