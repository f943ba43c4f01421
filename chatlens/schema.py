"""Schemas of the chat tables.

Raw logs are read as text only: inference would cost a second pass over the files and could turn
ids or times into numbers.
"""

from pyspark.sql import types as T

# The column names and their order are those of the log export.
RAW_CHAT_COLUMNS = (
    "DATE_TIME",
    "INTERACTION_ID",
    "USER_ID",
    "TIMESHIFT",
    "VISIBILITY",
    "EVENT_ID",
    "PERSON_ID",
    "USERNICK",
    "USERTYPE",
    "PROTOCOLTYPE",
    "TZOFFSET",
    "CLIENTVERSION",
    "MSGTEXT",
    "ASKERID",
    "REASON",
)

#: Columns given on the first event of a USER_ID only.
USER_ATTRIBUTES = ("PERSON_ID", "USERNICK", "USERTYPE", "PROTOCOLTYPE", "CLIENTVERSION")

RAW_CHAT = T.StructType([T.StructField(name, T.StringType()) for name in RAW_CHAT_COLUMNS])

_CHAT_TYPES = {
    "DATE_TIME": T.TimestampType(),
    "DATE": T.DateType(),
    "TIMESHIFT": T.IntegerType(),
    "EVENT_ID": T.IntegerType(),
}

CHAT_COLUMNS = RAW_CHAT_COLUMNS[:1] + ("DATE", "TIME") + RAW_CHAT_COLUMNS[1:]

CHAT = T.StructType(
    [T.StructField(name, _CHAT_TYPES.get(name, T.StringType())) for name in CHAT_COLUMNS]
)

#: Cleaned log with the redacted message beside the original one.
ANONYMISED_CHAT = T.StructType(CHAT.fields + [T.StructField("AN_MSGTEXT", T.StringType())])

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

#: Column for the whole line of a malformed row, where a reader is asked for it.
CORRUPT_LINE = "CORRUPT_LINE"
