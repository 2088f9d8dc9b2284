r"""Chat formatting from event logs, in DataFrame functions only.

A log row is an event of a conversation: ``message`` opens the next message,
``delta`` appends to a message, ``edit`` replaces its text and ``regenerate``
starts its text anew (its own text, then later deltas). Deltas, edits and
regenerations go to message number ``ref``, or to the latest message if that is
null. Events are read by ``seq``; ties by role, then text.

A conversation becomes one string of turns::

    <|im_start|>role<|im_sep|>text<|im_end|>

Control strings inside roles and texts (these, and <s>, </s>, [INST], [/INST])
get one backslash after their first sign; where backslashes stand there already,
one more is added, so taking one away restores the text exactly.

``loss_spans`` marks, in code points of the string, the texts of assistants.

Null text and null role count as empty; a null kind is a message; rows with null
conversation form the conversation null; rows with null ``seq`` come first.
Repeated rows are repeated events. Extra columns are ignored. An empty log gives
no rows. A conversation is one record of the result: its messages are folded one
by one, and only finished messages are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ASSISTANT = "assistant"
_CONTROL = r"(\||/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)\\(\\*)" + _CONTROL, r"$1$2$3")


def fold_events(events: DataFrame, conv: str = "conv_id", seq: str = "seq") -> DataFrame:
    """(conv, message, role, text): final messages of the log (conv, seq, kind, ref, role, text)."""
    log = events.select(
        F.col(conv).alias("conv"), F.col(seq).alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.col("ref").cast("bigint"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv").orderBy("seq", "role", "text", "kind")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = log.withColumn("at", F.row_number().over(w)).withColumn(
        "message", F.coalesce("ref", F.sum((F.col("kind") == "message").cast("bigint")).over(so_far)))
    folded = placed.groupBy("conv", "message").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("events"),
        F.max(F.when(F.col("kind") != "delta", F.col("at"))).alias("reset"),
        F.min(F.when(F.col("kind") == "message", F.col("at"))).alias("opened"))
    return folded.select(
        "conv", "message",
        F.expr("coalesce(get(filter(events, e -> e.at = opened), 0), events[0]).role").alias("role"),
        F.expr("array_join(transform(filter(events, e -> e.at >= coalesce(reset, 0)), e -> e.text), '')").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv, formatted, loss_spans) of folded messages."""
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    body = escaped(F.col("text"))
    turns = messages.select("conv", "message", (F.col("role") == ASSISTANT).alias("loss"), head.alias("head"), body.alias("body"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(END))
    before = Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    return (
        turns.groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct(
            "message", F.concat("head", "body", F.lit(END)).alias("turn"), "loss", "start", F.length("body").alias("length")))).alias("t"))
        .select(
            "conv", F.array_join(F.col("t.turn"), "").alias("formatted"),
            F.expr("transform(filter(t, x -> x.loss), x -> named_struct('start', x.start, 'length', x.length))").alias("loss_spans")))


def format_chats(events: DataFrame, conv: str = "conv_id", seq: str = "seq") -> DataFrame:
    """One row per conversation: (conv, formatted, loss_spans)."""
    return render(fold_events(events, conv, seq)).withColumnRenamed("conv", conv)


def read_back(chats: DataFrame) -> DataFrame:
    """Add what the formatted string says: ``turns`` (role, text) and ``loss_text``, both unescaped."""
    parts = F.split("formatted", START.replace("|", r"\|"), -1)
    parts = F.slice(parts, 2, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        pieces = F.split(part, SEP.replace("|", r"\|"), 2)
        rest = pieces[1]
        return F.struct(unescaped(pieces[0]).alias("role"),
                        unescaped(rest.substr(F.lit(1), F.length(rest) - len(END))).alias("text"))

    spans = F.transform("loss_spans", lambda s: unescaped(F.col("formatted").substr(
        (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(spans, ""))
