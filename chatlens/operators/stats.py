"""Corpus, conversation, user and time statistics of a cleaned chat log.

Metrics that belong together come out of one pass. Where several distinct counts meet, the log is
first reduced to a grain that keeps them (conversation, day, user type), so that only this reduced
table is expanded for the distinct counts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.roles import ROLES, Roles
from chatlens.functions.tokens import Tokenizer, blank_separated_tokens

# Bins and upper end of the distribution charts.
HISTOGRAM_BINS = 50
HISTOGRAM_UPPER = 40.0


def _ratio(total: Column, n: Column, digits: int = 2) -> Column:
    """Rounded ratio of exact sums: the same on every run, unlike a sum of fractions."""
    return F.round(total.cast("double") / n, digits)


def corpus_summary(chat: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """One row: rows, conversations, conversations per day, user types, human, system, null messages."""
    grain = chat.groupBy("INTERACTION_ID", "DATE", "USERTYPE").agg(
        F.count("*").alias("n"),
        F.count_if(roles.is_human()).alias("human"),
        F.count_if(roles.is_system()).alias("system"),
        F.count_if(F.col("MSGTEXT").isNull()).alias("no_text"),
    )
    has_id = F.col("INTERACTION_ID").isNotNull()
    return grain.agg(
        F.sum("n").alias("total_rows"),
        F.count_distinct("INTERACTION_ID").alias("conversations"),
        _ratio(
            F.count_distinct(F.when(has_id, F.struct("DATE", "INTERACTION_ID"))),
            F.count_distinct(F.struct("DATE")),
        ).alias("avg_conversations_per_day"),
        F.count_distinct("USERTYPE").alias("user_types"),
        F.sum("human").alias("human_messages"),
        F.sum("system").alias("system_messages"),
        F.sum("no_text").alias("null_messages"),
    )


def messages_by_role(chat: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """One row: messages of clients, human agents, all agents, the bot and external systems."""
    return chat.agg(
        F.count_if(roles.is_client()).alias("client"),
        F.count_if(roles.is_human_agent()).alias("human_agent"),
        F.count_if(roles.is_agent()).alias("agent"),
        F.count_if(roles.is_bot()).alias("bot"),
        F.count_if(roles.is_external()).alias("external"),
    )


def messages_by_usertype(chat: DataFrame) -> DataFrame:
    """Messages per USERTYPE."""
    return chat.groupBy("USERTYPE").agg(F.count("*").alias("messages"))


def null_messages(chat: DataFrame) -> DataFrame:
    """One row: events without text, and those among them that give a REASON."""
    no_text = F.col("MSGTEXT").isNull()
    return chat.agg(
        F.count_if(no_text).alias("null_messages"),
        F.count_if(no_text & F.col("REASON").isNotNull()).alias("null_messages_with_reason"),
    )


def chats_without_human(chat: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """One row: conversations in which no human agent wrote."""
    per_chat = (
        chat.filter(F.col("INTERACTION_ID").isNotNull())
        .groupBy("INTERACTION_ID")
        .agg(F.coalesce(F.bool_or(roles.is_human_agent()), F.lit(False)).alias("human"))
    )
    return per_chat.agg(F.count_if(~F.col("human")).alias("chats_without_human"))


def off_hours_chats(chat: DataFrame, opens: int = 9, last_hour: int = 22) -> DataFrame:
    """One row: conversations with an event before ``opens`` or after the end of ``last_hour``."""
    hour = F.hour("DATE_TIME")
    return chat.filter((hour < opens) | (hour > last_hour)).agg(
        F.count_distinct("INTERACTION_ID").alias("off_hours_chats")
    )


def _chat_seconds(chat: DataFrame) -> DataFrame:
    return chat.groupBy("INTERACTION_ID").agg(
        (F.max("TIMESHIFT") - F.min("TIMESHIFT")).cast("bigint").alias("seconds")
    )


def _minutes(seconds: Column) -> Column:
    return F.round(seconds / F.lit(60.0), 2)


def chat_durations(chat: DataFrame) -> DataFrame:
    """Minutes from the first to the last event of each conversation, to 2 decimals."""
    return _chat_seconds(chat).select(
        "INTERACTION_ID", _minutes(F.col("seconds")).alias("CHAT_DURATION")
    )


def duration_summary(chat: DataFrame) -> DataFrame:
    """One row: average, longest and shortest conversation in minutes."""
    return _chat_seconds(chat).agg(
        _ratio(F.sum("seconds"), F.count("seconds") * 60).alias("avg_minutes"),
        _minutes(F.max("seconds")).alias("max_minutes"),
        _minutes(F.min("seconds")).alias("min_minutes"),
        (F.sum("seconds").cast("double") / (F.count("seconds") * 60)).alias(
            "avg_minutes_unrounded"
        ),
    )


def duration_ranked(chat: DataFrame) -> DataFrame:
    """Durations, longest first; the id keeps runs of equal durations apart in the sort."""
    return chat_durations(chat).orderBy(F.desc("CHAT_DURATION"), "INTERACTION_ID")


def duration_stddev(chat: DataFrame) -> DataFrame:
    """One row: sample standard deviation of the rounded durations."""
    return chat_durations(chat).agg(F.stddev_samp("CHAT_DURATION").alias("stddev_minutes"))


def longest_conversation(chat: DataFrame) -> DataFrame:
    """All events of the longest conversation; the smaller id wins a tie."""
    longest = (
        _chat_seconds(chat)
        .filter(F.col("INTERACTION_ID").isNotNull())
        .orderBy(F.desc("seconds"), "INTERACTION_ID")
        .limit(1)
        .select("INTERACTION_ID")
    )
    return chat.join(F.broadcast(longest), "INTERACTION_ID", "left_semi")


def _histogram(values: DataFrame, column: str, bins: int, upper: float) -> DataFrame:
    """Equal bins from the smallest value to ``upper``, which belongs to the last bin.

    The values are counted first: the counts are as few as there are distinct values, and the smallest
    value is read off them.
    """
    counted = (
        values.groupBy(F.col(column).cast("double").alias("x"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("x").isNotNull())
    )
    lower = counted.agg(F.min("x")).scalar()
    filled = (
        counted.filter(F.col("x") <= upper)
        .groupBy(
            F.least(
                F.width_bucket("x", lower, F.lit(upper), F.lit(bins)), F.lit(bins).cast("bigint")
            ).alias("bin")
        )
        .agg(F.sum("n").alias("n"))
    )
    # One row per bin, so never more than the number of bins.
    edges = values.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    width = (F.lit(upper) - lower) / bins
    return edges.join(filled, "bin", "left").select(
        "bin",
        F.round(lower + (F.col("bin") - 1) * width, 6).alias("bin_start"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("conversations"),
    )


def duration_histogram(
    chat: DataFrame, bins: int = HISTOGRAM_BINS, upper: float = HISTOGRAM_UPPER
) -> DataFrame:
    """Conversations per duration bin; those longer than ``upper`` minutes are outside the chart."""
    return _histogram(chat_durations(chat), "CHAT_DURATION", bins, upper)


def chat_message_counts(chat: DataFrame) -> DataFrame:
    """Events per conversation."""
    return chat.groupBy("INTERACTION_ID").agg(F.count("*").alias("CHAT_MESS"))


def message_count_summary(chat: DataFrame) -> DataFrame:
    """One row: average, largest and smallest number of events per conversation."""
    return chat_message_counts(chat).agg(
        _ratio(F.sum("CHAT_MESS"), F.count("*")).alias("avg_messages"),
        F.max("CHAT_MESS").alias("max_messages"),
        F.min("CHAT_MESS").alias("min_messages"),
    )


def message_count_ranked(chat: DataFrame) -> DataFrame:
    """Event counts, largest first."""
    return chat_message_counts(chat).orderBy(F.desc("CHAT_MESS"), "INTERACTION_ID")


def message_count_stddev(chat: DataFrame) -> DataFrame:
    """One row: sample standard deviation of the event counts."""
    return chat_message_counts(chat).agg(F.stddev_samp("CHAT_MESS").alias("stddev_messages"))


def message_count_histogram(
    chat: DataFrame, bins: int = HISTOGRAM_BINS, upper: float = HISTOGRAM_UPPER
) -> DataFrame:
    """Conversations per event-count bin; those with more than ``upper`` are outside the chart."""
    return _histogram(chat_message_counts(chat), "CHAT_MESS", bins, upper)


def modal_message_count(chat: DataFrame) -> DataFrame:
    """One row: the most frequent event count and how often it occurs; the smaller one wins a tie."""
    return (
        chat_message_counts(chat)
        .groupBy("CHAT_MESS")
        .agg(F.count("*").alias("occurrence_count"))
        .orderBy(F.desc("occurrence_count"), "CHAT_MESS")
        .limit(1)
    )


def token_counts(
    chat: DataFrame, tokenizer: Tokenizer = blank_separated_tokens, text: str = "MSGTEXT"
) -> DataFrame:
    """The log with a ``token_count`` column."""
    return chat.withColumn("token_count", tokenizer(F.col(text)))


def token_summary(
    chat: DataFrame,
    tokenizer: Tokenizer = blank_separated_tokens,
    text: str = "MSGTEXT",
    roles: Roles = ROLES,
) -> DataFrame:
    """One row: tokens in all and per conversation, over all and over human messages."""
    counted = token_counts(chat, tokenizer, text)
    per_chat = counted.groupBy("INTERACTION_ID").agg(
        F.sum("token_count").alias("tokens"),
        F.sum(F.when(roles.is_human(), F.col("token_count"))).alias("human_tokens"),
    )
    return per_chat.agg(
        F.sum("tokens").alias("total_tokens"),
        _ratio(F.sum("tokens"), F.count("tokens")).alias("avg_tokens_per_chat"),
        F.sum("human_tokens").alias("human_tokens"),
        _ratio(F.sum("human_tokens"), F.count("human_tokens")).alias("avg_human_tokens_per_chat"),
    )


def _client_conversations(chat: DataFrame, roles: Roles) -> DataFrame:
    # The distinct count is planned over (USERNICK, INTERACTION_ID) first, so a nick that many
    # conversations share is spread over the cluster.
    return (
        chat.filter(roles.is_client())
        .groupBy("USERNICK")
        .agg(F.count_distinct("INTERACTION_ID").alias("NumberOfConversations"))
    )


def returning_clients(chat: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Client nicks with more than one conversation."""
    return _client_conversations(chat, roles).filter(F.col("NumberOfConversations") > 1)


def client_return_summary(chat: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """One row: returning clients and distinct clients."""
    return _client_conversations(chat, roles).agg(
        F.count_if(F.col("NumberOfConversations") > 1).alias("returning_clients"),
        F.count("USERNICK").alias("distinct_clients"),
    )


def messages_per_month(chat: DataFrame) -> DataFrame:
    """Per calendar month, all years together: distinct timestamps and events.

    Events are counted per timestamp first; otherwise a month would be one group of the distinct count.
    """
    per_time = chat.groupBy("DATE_TIME").agg(F.count("*").alias("n"))
    return per_time.groupBy(F.month("DATE_TIME").alias("month")).agg(
        F.count("DATE_TIME").alias("distinct_timestamps"),
        F.sum("n").alias("messages"),
    )


def active_hours(chat: DataFrame) -> DataFrame:
    """Hours of the day that have events, in order."""
    return chat.select(F.hour("DATE_TIME").alias("hour")).distinct().orderBy("hour")


def timestamps_in_hour(chat: DataFrame, hour: int = 12) -> DataFrame:
    """Distinct timestamps within one hour of the day."""
    return (
        chat.select(F.hour("DATE_TIME").alias("hour"), "DATE_TIME")
        .filter(F.col("hour") == hour)
        .distinct()
    )


def interactions_per_hour(chat: DataFrame) -> DataFrame:
    """Conversations per hour of the day, busiest hour first."""
    return (
        chat.groupBy(F.hour("DATE_TIME").alias("hour_of_day"))
        .agg(F.count_distinct("INTERACTION_ID").alias("interaction_count"))
        .orderBy(F.desc("interaction_count"), "hour_of_day")
    )
