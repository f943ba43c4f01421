"""The stages of an analysis, from raw log to annotated features, and a run that writes them.

Each stage reads what the one before has written, so no stage recomputes another and a lost executor
costs the tasks of one stage only. Output goes to the shared folder the caller names.
"""

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chatlens.functions.features import (
    CLOSED,
    CLOSED_LIST,
    DEFAULT_FEATURES,
    DEFAULT_TOPIC_RULES,
    OPEN_LIST,
    TEXT,
    Feature,
    alias_map,
)
from chatlens.operators import agreement, insights, stats
from chatlens.operators.annotate import flatten_features, merge_parts, parse_responses
from chatlens.operators.clean import (
    clean_chat,
    find_error_rows,
    split_human_messages,
    split_system_messages,
)
from chatlens.operators.conversations import assemble_conversations, conversation_json
from chatlens.operators.redact import pii_label, pii_redact
from chatlens.schema import ANONYMISED_CHAT, CHAT, CORRUPT_LINE
from chatlens.sources.tables import read_annotations, read_chat_log, write_table


class CleanTables(NamedTuple):
    errors: DataFrame
    cleaned: DataFrame
    humans: DataFrame
    systems: DataFrame


def clean_stage(raw: DataFrame) -> CleanTables:
    """Error rows, cleaned log, and its human and system parts."""
    cleaned = clean_chat(raw)
    return CleanTables(
        find_error_rows(raw), cleaned, split_human_messages(cleaned), split_system_messages(cleaned)
    )


def redact_stage(chat: DataFrame) -> DataFrame:
    """Cleaned log with the redacted message and the kind of what was found."""
    return pii_label(pii_redact(chat))


def annotate_stage(
    chat: DataFrame,
    annotator: Callable[[DataFrame], DataFrame],
    features: Sequence[Feature] = DEFAULT_FEATURES,
    block_events: int | None = None,
) -> DataFrame:
    """Redacted log to one row of features per conversation.

    ``annotator`` adds the ``response`` column to the documents. With ``block_events`` it is asked about blocks
    of so many events, whose features are merged.
    """
    docs = conversation_json(assemble_conversations(chat, block_events=block_events))
    return feature_stage(annotator(docs), features)


def feature_stage(answered: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Answered documents, or parts of them, to one row of features per conversation."""
    rows = flatten_features(parse_responses(answered), features)
    return merge_parts(rows, features) if "PART" in rows.columns else rows


def run_stages(
    spark: SparkSession,
    raw_path: str,
    out_dir: str,
    annotator: Callable[[DataFrame], DataFrame],
    features: Sequence[Feature] = DEFAULT_FEATURES,
    sep: str = ";",
    block_events: int | None = None,
) -> None:
    """Read a raw CSV log and write ``errors``, ``cleaned``, ``humans``, ``systems``, ``redacted``,
    ``responses`` and ``features`` as parquet below ``out_dir``.

    The cleaned log is in order of conversation and event, as are the tables made from it row by row.
    """
    raw = read_chat_log(spark, raw_path, sep=sep, corrupt_column=CORRUPT_LINE)
    tables = clean_stage(raw)
    write_table(tables.errors, f"{out_dir}/errors")
    write_table(tables.cleaned, f"{out_dir}/cleaned", sort_by=("INTERACTION_ID", "EVENT_ID"))
    cleaned = read_chat_log(spark, f"{out_dir}/cleaned", schema=CHAT, fmt="parquet")
    write_table(split_human_messages(cleaned), f"{out_dir}/humans")
    write_table(split_system_messages(cleaned), f"{out_dir}/systems")
    write_table(redact_stage(cleaned), f"{out_dir}/redacted")
    redacted = read_chat_log(spark, f"{out_dir}/redacted", schema=ANONYMISED_CHAT, fmt="parquet")
    docs = conversation_json(assemble_conversations(redacted, block_events=block_events))
    write_table(annotator(docs).drop("chats", "json_string", "prompt"), f"{out_dir}/responses")
    answered = spark.read.parquet(f"{out_dir}/responses")
    write_table(feature_stage(answered, features), f"{out_dir}/features")


#: Statistics of a cleaned log, by the table they are written to.
STATISTICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "corpus_summary": stats.corpus_summary,
    "messages_by_role": stats.messages_by_role,
    "chats_without_human": stats.chats_without_human,
    "duration_summary": stats.duration_summary,
    "duration_histogram": stats.duration_histogram,
    "message_count_summary": stats.message_count_summary,
    "message_count_histogram": stats.message_count_histogram,
    "modal_message_count": stats.modal_message_count,
    "token_summary": stats.token_summary,
    "client_return_summary": stats.client_return_summary,
    "messages_per_month": stats.messages_per_month,
    "interactions_per_hour": stats.interactions_per_hour,
}


def run_statistics(spark: SparkSession, out_dir: str) -> None:
    """Write the statistics of ``cleaned`` below ``out_dir``, one table each."""
    cleaned = read_chat_log(spark, f"{out_dir}/cleaned", schema=CHAT, fmt="parquet")
    for name, statistic in STATISTICS.items():
        write_table(statistic(cleaned), f"{out_dir}/statistics/{name}")


def run_agreement(
    spark: SparkSession,
    out_dir: str,
    annotations: Mapping[str, str],
    columns: Sequence[str],
    features: Sequence[Feature] = DEFAULT_FEATURES,
    tones: Sequence[str] = ("Tono_cliente", "Tono_operatore"),
    sep: str = ";",
) -> None:
    """Compare ``features`` with people's annotations: one CSV per annotator, with the given ``columns``.

    Columns may go under any alias of a feature. Writes ``agreement/mismatch`` (with the average row) and
    ``agreement/disagreement`` below ``out_dir``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    people = agreement.align_columns(
        read_annotations(spark, annotations, schema, sep), alias_map(tuple(features))
    )
    emotions = [f.name for f in features if f.kind == CLOSED_LIST and f.name in people.columns]
    compared = [f.name for f in features if f.kind == CLOSED and f.name in people.columns]
    people = agreement.normalise_annotations(
        people, emotions=emotions, tones=[t for t in tones if t in people.columns]
    )
    model = agreement.primary_emotion(spark.read.parquet(f"{out_dir}/features"), emotions)
    compared += emotions
    counts = agreement.mismatch_counts(model, people, compared)
    write_table(agreement.mismatch_with_average(counts), f"{out_dir}/agreement/mismatch")
    sets = agreement.disagreement_sets(model, people, compared)
    write_table(sets, f"{out_dir}/agreement/disagreement")


def run_insights(
    spark: SparkSession,
    out_dir: str,
    features: Sequence[Feature] = DEFAULT_FEATURES,
    topic_rules: Sequence[tuple[str, str]] = DEFAULT_TOPIC_RULES,
) -> None:
    """Write what the features hold and how well they keep to their vocabulary, below ``out_dir``."""
    rows = spark.read.parquet(f"{out_dir}/features")
    single = [f.name for f in features if f.kind == CLOSED]
    lists = [f.name for f in features if f.is_list]
    tables = {
        "failed": insights.failed_annotation_count(rows),
        "out_of_vocabulary": insights.out_of_vocabulary_values(rows, features),
        "list_sizes": insights.list_size_stats(rows, lists),
        "all_na": insights.all_na_count(rows, single),
    }
    for f in features:
        if f.kind == OPEN_LIST:
            classes = insights.classify_topics(rows, f.name, topic_rules)
            tables[f"topics_{f.name}"] = classes
            tables[f"topic_classes_{f.name}"] = insights.topic_class_counts(classes)
        elif f.kind == TEXT:
            tables[f"lengths_{f.name}"] = insights.summary_length_stats(rows, f.name)
    for name, table in tables.items():
        write_table(table, f"{out_dir}/insights/{name}")
