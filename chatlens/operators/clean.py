"""Error rows, types and participant attributes of a raw chat log."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.roles import ROLES, Roles
from chatlens.schema import CHAT_COLUMNS, CORRUPT_LINE, TIMESTAMP_FORMAT, USER_ATTRIBUTES

# Texts that stand for a missing value.
NULL_TOKENS = ("None", "NULL")


def _is_error() -> Column:
    return (
        F.col("INTERACTION_ID").isNull()
        | F.col("USER_ID").isNull()
        | F.col("DATE_TIME").try_cast("date").isNull()
    )


def null_profile(df: DataFrame, null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """One row: per column, how many values are null, empty, NaN or contain a null token."""

    def missing(field: T.StructField) -> Column:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return col.isNull() | F.isnan(col)
        if isinstance(field.dataType, T.StringType):
            test = col.isNull() | (col == "")
            for token in null_tokens:
                test = test | col.contains(token)
            return test
        return col.isNull()

    return df.agg(*[F.count_if(missing(f)).alias(f.name) for f in df.schema.fields])


def find_error_rows(df: DataFrame) -> DataFrame:
    """Rows without conversation, user or a readable date; also malformed lines, where the log tells them.

    A malformed line whose fields are readable stays in the cleaned log as well.
    """
    error = _is_error()
    if CORRUPT_LINE in df.columns:
        error = error | F.col(CORRUPT_LINE).isNotNull()
    return df.filter(error)


def remove_error_rows(df: DataFrame) -> DataFrame:
    """The other rows, each once: exact duplicates go too."""
    return df.filter(~_is_error()).drop(CORRUPT_LINE).distinct()


def cleaning_report(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """One row: total = errors + duplicates + remaining, and the human and system share of the latter.

    Copies are reduced to one row with a count before anything else, so the log is shuffled once.
    """
    error = _is_error()
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    rows = fill_user_attributes(copies, attributes_from=df.filter(~error))
    return rows.agg(
        F.sum("copies").alias("total_rows"),
        F.sum(F.when(error, F.col("copies")).otherwise(0)).alias("error_rows"),
        F.sum(F.when(~error, F.col("copies") - 1).otherwise(0)).alias("duplicate_rows"),
        F.count_if(~error).alias("remaining_rows"),
        F.count_if(~error & roles.is_human()).alias("human_rows"),
        F.count_if(~error & roles.is_system()).alias("system_rows"),
    )


def normalise_time(df: DataFrame) -> DataFrame:
    """DATE_TIME as timestamp, with DATE and the time of day as text."""
    text = F.col("DATE_TIME")
    return df.withColumns(
        {
            "DATE": text.try_cast("date"),
            "TIME": F.substring(text, 12, 8),
            "DATE_TIME": F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT)),
        }
    )


def cast_event_columns(df: DataFrame) -> DataFrame:
    """TIMESHIFT and EVENT_ID as int, null where they are no number."""
    return df.withColumns(
        {name: F.col(name).try_cast("int") for name in ("TIMESHIFT", "EVENT_ID")}
    )


#: Stands for an EVENT_ID that is null or no number: before all others.
_NO_EVENT = -(1 << 40)


def first_event_attributes(
    df: DataFrame,
    columns: Sequence[str] = USER_ATTRIBUTES,
    ignore_nulls: bool = False,
) -> DataFrame:
    """One row per USER_ID with the attributes of its first event.

    In two steps: the least event number of each user is a hash aggregate over one number, partial before the
    shuffle, so a hot user is a row per task; then the rows that carry it, few, are compared by conversation,
    time and the attributes themselves. A single minimum over texts would sort the whole log instead.
    With ``ignore_nulls`` each attribute has a first event of its own.
    """
    number = F.coalesce(F.col("EVENT_ID").try_cast("int").cast("bigint"), F.lit(_NO_EVENT))
    events = df.select("USER_ID", "INTERACTION_ID", "DATE_TIME", *columns, number.alias("__event"))
    event = F.col("__event")
    asked = {c: F.when(F.col(c).isNotNull(), event) for c in columns} if ignore_nulls else {"all": event}
    least = events.groupBy(F.col("USER_ID").alias("__user")).agg(
        *[F.min(e).alias(f"__first_{i}") for i, e in enumerate(asked.values())]
    )
    carries = {c: e == F.col(f"__first_{i}") for i, (c, e) in enumerate(asked.items())}
    same_user = F.col("USER_ID").eqNullSafe(F.col("__user"))
    order = ("INTERACTION_ID", "DATE_TIME")
    if ignore_nulls:
        # Users without any value keep a row; only rows that carry one are compared.
        rows = events.join(least, same_user & reduce(lambda x, y: x | y, carries.values()))
        found = rows.groupBy("USER_ID").agg(
            *[F.min_by(c, F.when(carries[c], F.struct(*order, c))).alias(c) for c in columns]
        )
        filled = least.select("__user").join(found, same_user, "left")
        return filled.select(F.col("__user").alias("USER_ID"), *columns)
    rows = events.join(least, same_user & carries["all"])
    first = rows.groupBy("USER_ID").agg(F.min(F.struct(*order, *columns)).alias("first"))
    return first.select("USER_ID", *[F.col(f"first.{c}").alias(c) for c in columns])


def fill_user_attributes(
    df: DataFrame,
    columns: Sequence[str] = USER_ATTRIBUTES,
    ignore_nulls: bool = False,
    attributes_from: DataFrame | None = None,
) -> DataFrame:
    """Give every event the attributes of the first event of its USER_ID.

    A window over USER_ID would send all events of a user to one task. Here the first events are
    aggregated and joined back, so that a hot user can be split by the adaptive skew join. The second
    join key, a hash of the first, keeps the aggregate from lending its own partitioning to the join:
    the rule only splits joins whose two inputs come straight from a shuffle. If no filled column is
    used, the optimizer drops the join, as the attributes hold one row per key.

    ``attributes_from`` may name a frame with the same users that is cheaper to read, for instance
    the log before duplicates were removed.
    """
    source = df if attributes_from is None else attributes_from
    first = first_event_attributes(source, columns, ignore_nulls)
    first = first.select(
        F.col("USER_ID").alias("first_user"),
        F.xxhash64("USER_ID").alias("first_hash"),
        *[F.col(c).alias(f"first_{c}") for c in columns],
    )
    joined = df.join(
        first,
        (F.col("USER_ID") == F.col("first_user"))
        & (F.xxhash64("USER_ID") == F.col("first_hash")),
        "left",
    )
    return joined.select(
        *[F.col(f"first_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def clean_chat(raw: DataFrame) -> DataFrame:
    """Raw log to cleaned log: errors and copies removed, attributes filled, types set."""
    filled = fill_user_attributes(
        remove_error_rows(raw), attributes_from=raw.filter(~_is_error())
    )
    return cast_event_columns(normalise_time(filled)).select(*CHAT_COLUMNS)


def split_human_messages(chat: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Events of clients and human agents."""
    return chat.filter(roles.is_human())


def split_system_messages(chat: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Events of the bot and of external systems."""
    return chat.filter(roles.is_system())


def event_time(chat: DataFrame) -> DataFrame:
    """DATE_TIME moved forward by the TIMESHIFT seconds."""
    shift = F.make_dt_interval(secs=F.col("TIMESHIFT"))
    return chat.withColumn("DATE_TIME", F.col("DATE_TIME") + shift)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; names that do not occur are passed over."""
    return df.drop(*names)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns; names that do not occur are passed over."""
    return df.withColumnsRenamed(names)
