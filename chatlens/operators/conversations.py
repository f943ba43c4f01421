"""Conversations as documents.

A conversation becomes one row with its messages in event order: that is the unit that is annotated and
compared. The row is bounded by the conversation's own length; one beyond Spark's row limit fails.

For annotators that cannot read so much at once, the caller may choose ``block_events``: rows then cover so
many consecutive event numbers, numbered by PART, whatever the length of the log, and ``merge_parts`` makes
one row of features per conversation again.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a message within a conversation.
MESSAGE_FIELDS = ("USERNICK", "USERTYPE", "AN_MSGTEXT")


def assemble_conversations(
    chat: DataFrame,
    fields: Sequence[str] = MESSAGE_FIELDS,
    block_events: int | None = None,
) -> DataFrame:
    """INTERACTION_ID (and PART, if ``block_events`` is given) and the array ``chats`` in event order.

    The messages are shuffled once. Events without INTERACTION_ID belong to no conversation and are left
    out. Messages without event number come first, in PART 0; equal numbers are ordered by the fields.
    """
    keys = ["INTERACTION_ID"]
    events = chat.filter(F.col("INTERACTION_ID").isNotNull())
    if block_events is not None:
        keys.append("PART")
        number = F.coalesce("EVENT_ID", F.lit(1)) - 1
        events = events.withColumn("PART", F.floor(number / block_events).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("EVENT_ID", *fields)))
    return (
        events.groupBy(*keys)
        .agg(ordered.alias("chats"))
        .withColumn(
            "chats", F.transform("chats", lambda m: F.struct(*[m[f].alias(f) for f in fields]))
        )
    )


def conversation_json(docs: DataFrame, column: str = "json_string") -> DataFrame:
    """The messages as JSON text, with null fields kept and other alphabets as they are."""
    return docs.withColumn(column, F.to_json("chats", {"ignoreNullFields": "false"}))


def render_prompt(
    docs: DataFrame,
    template: str,
    slots: Mapping[str, str] | None = None,
    text: str = "json_string",
    column: str = "prompt",
) -> DataFrame:
    """Instruction text, with its ``{slots}`` filled, followed by the conversation."""
    for name, value in (slots or {}).items():
        template = template.replace("{" + name + "}", value)
    return docs.withColumn(column, F.concat(F.lit(template), F.col(text)))


def matches(text: Column, regex: str) -> Column:
    """Whether ``regex`` occurs in the text, ignoring case."""
    return text.rlike(f"(?i){regex}")
