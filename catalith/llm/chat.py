"""Chat formatting from an event log, with built-in functions only.

A conversation is a log of events, ordered by ``seq``:

``message``     opens a message of a role,
``delta``       appends streamed text to the last message opened,
``edit``        replaces the text of a message: number ``target`` of the conversation
                (from 0), or the last one where that is null,
``regenerate``  starts the last message's text anew; later deltas fill it.

The fold: windows over a conversation's events number its messages and the versions of
each; the last version's texts are put together, then the messages are rendered.
Events are shuffled once, by conversation.

A turn is rendered as ``### role: text</turn>`` and a line feed. In roles and texts a
backslash is doubled, ``##`` becomes ``#\\#``, ``</turn>`` becomes ``<\\/turn>``, and a
colon in a role becomes ``\\:``; so neither mark can come from a text, and dropping the
backslash of each pair gives it back. The loss mask covers the texts of the learned
roles, without header and end mark.

Defined cases: null texts are empty; a null role is the empty role; a null
conversation id is one conversation. A null ``kind`` is a message. Events of equal
``seq`` follow kind (messages first), role and text; repeated events each count. An
event before the first message opens one of its role. An edit of a message that does
not exist is dropped. A conversation without messages has no row. Extra columns are
not handed through: rows are conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, number, role, text``.

    ``events`` has ``conv_id, seq, kind, target, role, text``.
    """
    kind = F.coalesce("kind", F.lit("message"))
    rank = F.when(kind == "message", 0).when(kind == "delta", 1).when(kind == "edit", 2)
    rows = events.select(
        "conv_id",
        "seq",
        kind.alias("kind"),
        rank.otherwise(3).alias("rank"),
        F.col("target").cast("long").alias("target"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["seq", "rank", "role", "text"]
    log = Window.partitionBy("conv_id").orderBy(*order)
    so_far = log.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.row_number().over(log))
    opens = (F.col("kind") == "message") | ((F.col("place") == 1) & (F.col("kind") != "edit"))
    rows = rows.withColumn("opened", F.sum(opens.cast("long")).over(so_far) - 1)
    rows = rows.withColumn("opens", opens).withColumn(
        "number",
        F.when(F.col("kind") == "edit", F.coalesce("target", "opened")).otherwise(F.col("opened")),
    )
    message = Window.partitionBy("conv_id", "number").orderBy("place")
    resets = F.col("opens") | F.col("kind").isin("edit", "regenerate")
    rows = rows.where("number >= 0").withColumn(
        "version",
        F.sum(resets.cast("long")).over(message.rowsBetween(Window.unboundedPreceding, 0)),
    )
    whole = Window.partitionBy("conv_id", "number")
    rows = rows.withColumn("last", F.max("version").over(whole)).withColumn(
        "exists", F.max("opens").over(whole)
    )
    parts = F.array_sort(
        F.collect_list(
            F.when(F.col("version") == F.col("last"), F.struct("place", "text"))
        )
    )
    return (
        rows.where("exists")
        .groupBy("conv_id", "number")
        .agg(
            F.max(F.when(F.col("opens"), F.col("role"))).alias("role"),
            F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per conversation: ``conv_id`` and ``segments`` of ``text`` and ``loss``.

    The texts of the segments, put together, are the formatted conversation; those
    with ``loss`` are what is learned.
    """
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:"))
    turns = messages.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "number",
                    F.concat(F.lit(OPEN), role, F.lit(": ")).alias("head"),
                    escape(F.col("text")).alias("body"),
                    F.col("role").isin(*learned).alias("loss"),
                )
            )
        ).alias("turns")
    )
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)
    return turns.select(
        "conv_id",
        F.flatten(
            F.transform(
                "turns",
                lambda t: F.array(
                    segment(t["head"], off),
                    segment(t["body"], t["loss"]),
                    segment(F.lit(CLOSE), off),
                ),
            )
        ).alias("segments"),
    )


def format_chats(events: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Events to rendered conversations."""
    return render(fold(events), learned)


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the mask, unescaped."""
    under = F.filter(segments, lambda s: s["loss"])
    return unescape(F.array_join(F.transform(under, lambda s: s["text"]), ""))


def parse(text: Column) -> Column:
    """Turns of a formatted conversation, read back: ``role`` and ``text``."""
    bodies = F.filter(F.split(text, "</turn>\n"), lambda t: t != "")
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"
    return F.transform(
        bodies,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, head, 1)).alias("role"),
            unescape(F.regexp_extract(t, head, 2)).alias("text"),
        ),
    )
