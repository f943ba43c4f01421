"""The registered queries: every operator on the whole of the tables it is meant for."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.features import CLOSED, CLOSED_LIST, DEFAULT_FEATURES, alias_map
from chatlens.operators import agreement, annotate, clean, conversations, insights, redact, stats
from chatlens.plans import adapters as A
from chatlens.plans.stages import annotate_stage, feature_stage
from chatlens.schema import CHAT, CHAT_COLUMNS, CORRUPT_LINE
from chatlens.sources import (
    read_chat_log,
    register_views,
    rename_positional,
    sample_by_ids,
    sample_top_conversations,
    scratch_path,
    write_table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SAMPLE_IDS = """
0000000000000003
0000000000000005
0000000000000008
0000000000000013
"""
SAMPLE_SIZE = 25
PROMPT = "Read the chat, classes: {class_list}. Chat: "
LISTED_IDS = ("0000000000000003", "0000000000000017")


def comparable(df: DataFrame) -> DataFrame:
    """Types that every engine writes alike: times as text, lists as JSON, integers as bigint."""

    def plain(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return col.cast("string").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            return col.cast("bigint").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return col.cast("double").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.to_json(col, {"ignoreNullFields": "false"}).alias(field.name)
        return col

    return df.select(*[plain(f) for f in df.schema.fields])


def _register(name: str, source: Callable[[SparkSession, str], DataFrame], operator) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(operator(source(spark, sf_dir)))

    QUERIES[name] = query


def _on(source: Callable[[SparkSession, str], DataFrame], **operators) -> None:
    for name, operator in operators.items():
        _register(name, source, operator)


def _rounded(df: DataFrame) -> DataFrame:
    """Standard deviations to 6 decimals: the order of a sum of doubles is not fixed."""
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


def view_in_sql(raw: DataFrame) -> DataFrame:
    """A query in SQL text over a registered view."""
    register_views({"raw_chat": raw})
    return raw.sparkSession.sql("SELECT VISIBILITY, count(*) AS n FROM raw_chat GROUP BY VISIBILITY")


_on(
    A.raw_log,
    rename_positional=lambda raw: rename_positional(
        raw.select("INTERACTION_ID", "EVENT_ID"), ("a", "b")
    ),
    drop_and_rename_columns=lambda raw: clean.rename_columns(
        clean.drop_columns(
            raw, *[c for c in raw.columns if c not in ("INTERACTION_ID", "EVENT_ID")], "unknown"
        ),
        {"INTERACTION_ID": "conversation", "missing": "x"},
    ),
    view_in_sql=view_in_sql,
    null_profile=clean.null_profile,
    find_error_rows=clean.find_error_rows,
    remove_error_rows=clean.remove_error_rows,
    cleaning_report=clean.cleaning_report,
    normalise_time=clean.normalise_time,
    cast_event_columns=clean.cast_event_columns,
    fill_user_attributes=lambda raw: clean.fill_user_attributes(clean.remove_error_rows(raw)),
    fill_user_attributes_not_null=lambda raw: clean.fill_user_attributes(
        clean.remove_error_rows(raw), columns=("MSGTEXT", "REASON"), ignore_nulls=True
    ),
    clean_chat=clean.clean_chat,
    null_profile_cleaned=lambda raw: clean.null_profile(clean.clean_chat(raw)),
)

_on(
    A.chat_log,
    split_human_messages=clean.split_human_messages,
    split_system_messages=clean.split_system_messages,
    event_time=clean.event_time,
    sample_by_ids=lambda chat: sample_by_ids(chat, SAMPLE_IDS).select(
        "INTERACTION_ID", "EVENT_ID", "USERNICK", "USERTYPE", "MSGTEXT"
    ),
    sample_top_conversations=lambda chat: sample_top_conversations(chat, SAMPLE_SIZE),
    corpus_summary=stats.corpus_summary,
    messages_by_role=stats.messages_by_role,
    messages_by_usertype=stats.messages_by_usertype,
    null_messages=stats.null_messages,
    chats_without_human=stats.chats_without_human,
    off_hours_chats=stats.off_hours_chats,
    chat_durations=stats.chat_durations,
    duration_summary=stats.duration_summary,
    duration_ranked=stats.duration_ranked,
    duration_stddev=lambda chat: _rounded(stats.duration_stddev(chat)),
    longest_conversation=stats.longest_conversation,
    duration_histogram=stats.duration_histogram,
    chat_message_counts=stats.chat_message_counts,
    message_count_summary=stats.message_count_summary,
    message_count_ranked=stats.message_count_ranked,
    message_count_stddev=lambda chat: _rounded(stats.message_count_stddev(chat)),
    message_count_histogram=stats.message_count_histogram,
    modal_message_count=stats.modal_message_count,
    token_counts=lambda chat: stats.token_counts(chat).select(
        "INTERACTION_ID", "EVENT_ID", "token_count"
    ),
    token_summary=stats.token_summary,
    returning_clients=stats.returning_clients,
    client_return_summary=stats.client_return_summary,
    messages_per_month=stats.messages_per_month,
    active_hours=stats.active_hours,
    timestamps_in_hour=stats.timestamps_in_hour,
    interactions_per_hour=stats.interactions_per_hour,
)

_on(
    A.messages,
    pii_flags=lambda m: redact.pii_flags(m).drop("MSGTEXT"),
    pii_filter=lambda m: redact.pii_filter(m, "PHONE_NUMBER"),
    pii_counts=redact.pii_counts,
    pii_replace_message=lambda m: redact.pii_replace_message(
        m, columns=("source", "message_id")
    ),
    pii_label=lambda m: redact.pii_label(m).drop("MSGTEXT"),
    pii_redact=lambda m: redact.pii_redact(m).drop("MSGTEXT"),
    pii_redact_first_category=lambda m: redact.pii_redact_first_category(m).drop("MSGTEXT"),
    pii_label_from_redacted=lambda m: redact.pii_label_from_redacted(redact.pii_redact(m)).drop(
        "MSGTEXT", "AN_MSGTEXT"
    ),
    pii_label_counts=lambda m: redact.pii_label_counts(redact.pii_label(m)),
    pii_pairs=lambda m: redact.pii_pairs(redact.pii_label(redact.pii_redact(m))),
)


def documents_of(chat: DataFrame) -> DataFrame:
    """Conversations of the redacted log as JSON documents."""
    return conversations.conversation_json(
        conversations.assemble_conversations(redact.pii_redact(chat))
    )


def _parsed(responses: DataFrame) -> DataFrame:
    return annotate.parse_responses(responses)


def _make_lexicon_annotator() -> annotate.LexiconAnnotator:
    return annotate.LexiconAnnotator(A.LEXICON)


_on(
    A.chat_log,
    assemble_conversations=lambda chat: documents_of(chat).select(
        "INTERACTION_ID", F.size("chats").alias("messages"), "json_string"
    ),
    conversation_json=lambda chat: documents_of(chat).select("INTERACTION_ID", "json_string"),
    render_prompt=lambda chat: conversations.render_prompt(
        documents_of(chat), PROMPT, {"class_list": "Bonus, Account"}
    ).select("INTERACTION_ID", "prompt"),
    annotate=lambda chat: annotate.annotate(documents_of(chat), _make_lexicon_annotator).select(
        "INTERACTION_ID", "response"
    ),
    annotate_with_lexicon=lambda chat: annotate.annotate_with_lexicon(
        documents_of(chat), A.LEXICON
    ).select("INTERACTION_ID", "response"),
    annotate_parse_flatten=lambda chat: annotate_stage(
        redact.pii_redact(chat),
        lambda docs: annotate.annotate_with_lexicon(docs, A.LEXICON),
        A.FEATURES,
    ).drop("response"),
)

_on(
    A.responses,
    parse_responses=lambda r: _parsed(r).drop("parsed"),
    flatten_features=lambda r: annotate.flatten_features(_parsed(r), A.FEATURES),
    flatten_struct=lambda r: annotate.flatten_struct(
        r.withColumn(
            "parsed",
            F.from_json(
                "response",
                "resolution string, tone struct<client: string>, emotions array<string>, extra int",
            ),
        ).drop("response"),
        "parsed",
    ),
)


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    model = agreement.primary_emotion(
        A.predictions(spark, sf_dir), ("client_emotions", "operator_emotions")
    )
    people = agreement.normalise_annotations(
        A.annotations(spark, sf_dir),
        emotions=("client_emotions", "operator_emotions"),
        tones=("client_tone", "operator_tone"),
        tone_map=A.TONE_MAP,
    )
    return model, people


def _agreement(operator) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, people = _compared(spark, sf_dir)
        return comparable(operator(model, people, A.COMPARED))

    return query


QUERIES["mismatch_counts"] = _agreement(agreement.mismatch_counts)
QUERIES["mismatch_counts_strict"] = _agreement(
    lambda m, p, fs: agreement.mismatch_counts(m, p, fs, null_is_match=False)
)
QUERIES["mismatch_with_average"] = _agreement(
    lambda m, p, fs: agreement.mismatch_with_average(agreement.mismatch_counts(m, p, fs))
)
QUERIES["mismatch_fields"] = _agreement(agreement.mismatch_fields)
QUERIES["disagreement_sets"] = _agreement(agreement.disagreement_sets)

_on(
    A.annotations,
    normalise_annotations=lambda a: agreement.normalise_annotations(
        a,
        emotions=("client_emotions", "operator_emotions"),
        tones=("client_tone", "operator_tone"),
        tone_map=A.TONE_MAP,
    ),
)
_on(
    A.predictions,
    primary_emotion=lambda p: agreement.primary_emotion(
        p, ("client_emotions", "operator_emotions")
    ).select("INTERACTION_ID", "client_emotions", "operator_emotions"),
    align_columns=lambda p: agreement.align_columns(
        p.select("INTERACTION_ID", "client_tone", "operator_tone"),
        {"client_tone": "Tono_cliente", "operator_tone": "Tono_operatore", "Tono.Altro": "x"},
    ),
    parse_list_text=lambda p: insights.parse_list_text(
        p.select("INTERACTION_ID", "client_emotions", "topics"),
        ("client_emotions", "topics"),
        keep_blanks=("topics",),
    ),
    coalesce_variant_columns=lambda p: insights.coalesce_variant_columns(
        p.select("INTERACTION_ID", "client_tone", "client_tone_variant"),
        {"client_tone": "client_tone_variant"},
    ),
    failed_annotations=lambda p: insights.failed_annotations(p, LISTED_IDS).select(
        "INTERACTION_ID", "success"
    ),
    failed_annotation_count=lambda p: insights.failed_annotation_count(p, LISTED_IDS),
)
_on(
    A.parsed_predictions,
    out_of_vocabulary_counts=lambda p: insights.out_of_vocabulary_counts(p, A.FEATURES),
    out_of_vocabulary_values=lambda p: insights.out_of_vocabulary_values(p, A.FEATURES),
    out_of_vocabulary_value_counts=lambda p: insights.out_of_vocabulary_value_counts(
        p, A.FEATURES
    ),
    generated_list_items=lambda p: insights.generated_list_items(p, A.FEATURES).select(
        "INTERACTION_ID", "generated_client_emotions", "generated_operator_emotions"
    ),
    multi_valued_rows=lambda p: insights.multi_valued_rows(p, "client_emotions").select(
        "INTERACTION_ID", "client_emotions"
    ),
    generated_item_counts=lambda p: insights.generated_item_counts(
        insights.generated_list_items(p, A.FEATURES), "generated_client_emotions"
    ),
    generated_item_totals=lambda p: insights.generated_item_totals(
        insights.generated_list_items(p, A.FEATURES), "generated_client_emotions"
    ),
    summary_length_stats=lambda p: insights.summary_length_stats(p, "summary"),
    list_size_stats=lambda p: insights.list_size_stats(
        p, ("client_emotions", "operator_emotions", "topics")
    ),
    distinct_topic_sets=lambda p: insights.distinct_topic_sets(p, "topics"),
    topic_counts=lambda p: insights.topic_counts(p, "topics"),
    classify_topics=lambda p: insights.classify_topics(p, "topics", A.TOPIC_RULES, A.OTHER_TOPIC),
    classify_topics_default=lambda p: insights.classify_topics(p, "topics"),
    topic_class_counts=lambda p: insights.topic_class_counts(
        insights.classify_topics(p, "topics", A.TOPIC_RULES, A.OTHER_TOPIC)
    ),
    topic_class_weights=lambda p: insights.topic_class_counts(
        insights.classify_topics(p, "topics", A.TOPIC_RULES, A.OTHER_TOPIC), weight="all"
    ),
    all_na_rows=lambda p: insights.all_na_rows(p, A.SCALARS).select("INTERACTION_ID"),
    all_na_count=lambda p: insights.all_na_count(p, A.SCALARS),
)


# Blocks of events, responses whose keys nobody declared

_on(
    A.dialogue_parts,
    merge_parts=lambda parts: feature_stage(parts, A.BLOCK_FEATURES),
)
_on(
    A.responses,
    flatten_discovered=lambda r: annotate.flatten_discovered(_parsed(r).drop("response", "success")),
)

# The default scheme

_on(
    A.italian_features,
    italian_features=lambda f: f.drop("response"),
    italian_out_of_vocabulary=lambda f: insights.out_of_vocabulary_values(f, DEFAULT_FEATURES),
    italian_generated_items=lambda f: insights.generated_item_counts(
        insights.generated_list_items(f, DEFAULT_FEATURES), "generated_Emozioni_cliente"
    ),
    italian_topics=lambda f: insights.classify_topics(f, "Argomento_conversazione"),
    italian_list_sizes=lambda f: insights.list_size_stats(f, ("Emozioni_cliente", "Argomento_conversazione")),
)


def _italian_agreement(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    people = agreement.align_columns(A.italian_annotations(spark, sf_dir), alias_map(DEFAULT_FEATURES))
    emotions = [f.name for f in DEFAULT_FEATURES if f.kind == CLOSED_LIST]
    people = agreement.normalise_annotations(people, emotions, ("Tono_cliente", "Tono_operatore"))
    model = agreement.primary_emotion(A.italian_features(spark, sf_dir), emotions)
    return model, people, [f.name for f in DEFAULT_FEATURES if f.kind in (CLOSED, CLOSED_LIST)]


def italian_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatch table with its average row, from files and responses under the default scheme."""
    model, people, features = _italian_agreement(spark, sf_dir)
    return comparable(agreement.mismatch_with_average(agreement.mismatch_counts(model, people, features)))


def italian_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, people, features = _italian_agreement(spark, sf_dir)
    return comparable(agreement.disagreement_sets(model, people, features))


QUERIES["italian_mismatch"] = italian_mismatch
QUERIES["italian_disagreement"] = italian_disagreement


# Reading and writing


def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log from CSV files with malformed lines, and which lines are."""
    log = read_chat_log(spark, A.log_files(spark, sf_dir), multi_line=True, corrupt_column=CORRUPT_LINE)
    return log.withColumn(CORRUPT_LINE, F.col(CORRUPT_LINE).isNotNull()).withColumnRenamed(CORRUPT_LINE, "malformed")


def written_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned log from a table whose partition column has one hot value."""
    path = scratch_path(spark, "chat-by-type")
    write_table(A.chat_log(spark, sf_dir), path, partition_by=("USERTYPE",))
    return comparable(spark.read.parquet(path).select(*CHAT_COLUMNS))


def written_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned log from a CSV table in global order."""
    path = scratch_path(spark, "chat-in-order")
    write_table(A.chat_log(spark, sf_dir), path, fmt="csv", sort_by=("INTERACTION_ID", "EVENT_ID"))
    return comparable(read_chat_log(spark, path, sep=",", schema=CHAT, multi_line=True))


QUERIES["read_chat_log"] = read_log
QUERIES["read_annotations"] = lambda spark, sf_dir: comparable(A.annotation_files(spark, sf_dir))
QUERIES["write_table"] = written_log
QUERIES["write_table_sorted"] = written_in_order
