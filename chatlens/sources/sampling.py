"""Whole-conversation samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest id list, in characters, that is broadcast; longer lists are left to the planner.
MAX_BROADCAST_CHARS = 8_000_000

# Fixed value: an interaction id is 16 letters or digits.
ID_LENGTH = 16
ID_PATTERN = "[0-9A-Za-z]{16}"


def _keep_ids(df: DataFrame, ids: DataFrame, max_chars: int) -> DataFrame:
    small = F.broadcast(ids) if max_chars <= MAX_BROADCAST_CHARS else ids
    return df.join(small, "INTERACTION_ID", "left_semi")


def sample_by_ids(df: DataFrame, ids: str, id_pattern: str = ID_PATTERN) -> DataFrame:
    """Events of the conversations whose ids occur in the pasted text ``ids``."""
    listed = (
        df.sparkSession.range(1)
        .select(
            F.explode(F.regexp_extract_all(F.lit(ids), F.lit(id_pattern), F.lit(0))).alias(
                "INTERACTION_ID"
            )
        )
        .distinct()
    )
    return _keep_ids(df, listed, len(ids))


def sample_top_conversations(df: DataFrame, n: int = 10_000) -> DataFrame:
    """Events of the ``n`` conversations with most rows, in conversation and event order.

    Equal row counts are settled by the smaller id.
    """
    top = (
        df.groupBy("INTERACTION_ID")
        .count()
        .orderBy(F.desc("count"), "INTERACTION_ID")
        .limit(n)
        .select("INTERACTION_ID")
    )
    return _keep_ids(df, top, n * ID_LENGTH).orderBy("INTERACTION_ID", "EVENT_ID")
