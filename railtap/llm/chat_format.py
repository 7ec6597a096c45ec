"""Chat formatting from event logs.

A conversation is a log of events.  Each belongs to a message and has a kind:
``delta`` appends its text, ``edit`` puts its text in place of all before it,
``regenerate`` empties the message and strikes every message that began between
the message and this event.  Events fold to messages keyed by (conversation,
message), so a long log spreads over tasks; then the messages of a conversation
are sorted by their first event and rendered.

Template: each message is ``<s>role`` line break, text, ``</s>`` line break, the
role URL-encoded.  A control string inside a text gets one more backslash after
its first character, and reading back takes one away, so any text comes back as
it was.  Text of the assistant is under the loss mask.

Everything is Column expressions.  Edge cases: a null text or role is empty; a
null conversation is one conversation; a null sequence comes before all others;
messages with equal first sequence go by role, then text; repeated rows of a
table without events are messages of their own; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings, and how a text that holds one is changed.
OPEN, CLOSE = "<s>", "</s>\n"
_PLAIN = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>)"

LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_PLAIN), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def messages(events: DataFrame) -> DataFrame:
    """Fold events (conv_id, message, seq, kind, role, text) to conv_id, message, first, role, text and ``redone``.

    ``redone`` is the sequence of the last regeneration of the message, or null.
    """
    event = F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    reset = F.col("kind").isin("edit", "regenerate")
    one = events.groupBy("conv_id", "message").agg(
        F.min(F.struct("seq", F.coalesce("role", F.lit("")).alias("role"))).alias("begin"),
        F.max(F.when(reset, F.struct("seq", "kind"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
        F.sort_array(F.collect_list(event)).alias("events"))
    live = F.filter("events", lambda e: F.col("reset").isNull() | (e["seq"] > F.col("reset.seq"))
                    | ((e["seq"] == F.col("reset.seq")) & (e["kind"] == "edit")))
    text = F.concat_ws("", F.transform(live, lambda e: e["text"]))
    return one.select("conv_id", "message", F.col("begin.seq").alias("first"), F.col("begin.role").alias("role"),
                      text.alias("text"), "redone")


def conversations(folded: DataFrame) -> DataFrame:
    """conv_id and its messages (role, text) in order, without those that a regeneration struck."""
    turn = F.struct("first", "role", "text")
    again = F.when(F.col("redone").isNotNull(), F.struct("first", "redone"))
    one = folded.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.collect_list(again).alias("again"))
    kept = F.filter("turns", lambda t: ~F.exists("again", lambda g: (g["first"] < t["first"]) & (t["first"] < g["redone"])))
    return one.select("conv_id", F.transform(kept, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(chats: DataFrame) -> DataFrame:
    """conv_id and the formatted text."""
    one = F.transform("turns", lambda t: F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE)))
    return chats.select("conv_id", F.concat_ws("", one).alias("formatted"))


def parse(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted and the turns (role, text, whether it is learned) read back from the formatted text."""
    parts = F.filter(F.split("formatted", OPEN, -1), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("head"), p.alias("all")))
    turns = F.transform(cut, lambda c: F.struct(
        F.url_decode(c["head"]).alias("role"),
        unescape(F.substring(c["all"], F.length(c["head"]) + 2, F.length(c["all"]) - F.length(c["head"]) - 1 - len(CLOSE))).alias("text")))
    return rendered.select("conv_id", "formatted", F.transform(turns, lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"), (t["role"] == LEARNED).alias("learned"))).alias("turns"))


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and hashes of what :func:`parse` read back."""
    every = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]))
    return (parsed.withColumn("learned", learned)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
                    F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def events_of(turns: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as an event log: each row is a message of one delta."""
    return turns.select("conv_id", F.monotonically_increasing_id().alias("message"), F.col("turn").alias("seq"),
                        F.lit("delta").alias("kind"), "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    return render(conversations(messages(events_of(turns))))
