"""Statistics: golden rows, and invariants over the test tables."""

import pytest
from pyspark.sql import functions as F

from chatlens.functions.tokens import encoder_tokens
from chatlens.operators import stats
from chatlens.plans import adapters as A


def chat(spark, *rows):
    """Rows of (INTERACTION_ID, USERTYPE, USERNICK, TIMESHIFT, MSGTEXT, DATE_TIME)."""
    df = spark.createDataFrame(
        [(*r, *(None,) * (6 - len(r))) for r in rows],
        "INTERACTION_ID string, USERTYPE string, USERNICK string, TIMESHIFT int, MSGTEXT string, DATE_TIME string",
    )
    return df.withColumns(
        {"DATE_TIME": F.to_timestamp("DATE_TIME"), "DATE": F.to_date("DATE_TIME"), "REASON": F.lit(None).cast("string")}
    )


def bins(df):
    return {r.bin: r.conversations for r in df.collect() if r.conversations}


def durations(spark, *minutes):
    rows = [(f"c{i}", "CLIENT", "n", s) for i, m in enumerate(minutes) for s in (0, round(m * 60))]
    return chat(spark, *rows)


def test_histogram_edges(spark):
    """The top of the chart belongs to the last bin; what lies above it is left out."""
    values = spark.createDataFrame([(x,) for x in (0.0, 0.79, 0.8, 40.0, 41.0, None)], "x double")
    assert bins(stats._histogram(values, "x", 50, 40.0)) == {1: 2, 2: 1, 50: 1}


def test_histogram_has_all_bins(spark):
    rows = stats.duration_histogram(durations(spark, 1, 2, 39, 45)).orderBy("bin").collect()
    assert [r.bin for r in rows] == list(range(1, 51))
    assert rows[0].bin_start == 1.0 and sum(r.conversations for r in rows) == 3


def test_histograms_hold_every_value_up_to_the_top(spark, sf_dir):
    log = A.chat_log(spark, sf_dir)
    up_to_40 = stats.chat_message_counts(log).filter("CHAT_MESS <= 40").count()
    total = stats.message_count_histogram(log).agg(F.sum("conversations")).first()[0]
    assert total == up_to_40


def test_durations(spark):
    log = durations(spark, 1.5, 3, 0)
    row = stats.duration_summary(log).first()
    assert (row.avg_minutes, row.max_minutes, row.min_minutes) == (1.5, 3.0, 0.0)
    assert row.avg_minutes_unrounded == 1.5
    assert [r.CHAT_DURATION for r in stats.duration_ranked(log).collect()] == [3.0, 1.5, 0.0]
    assert stats.duration_stddev(log).first()[0] == pytest.approx(1.5)
    assert {r.INTERACTION_ID for r in stats.longest_conversation(log).collect()} == {"c1"}


def test_ties_are_settled(spark):
    log = chat(spark, ("b",), ("a",), ("d",), ("d",), ("c",), ("c",))
    assert tuple(stats.modal_message_count(log).first()) == (1, 2)
    assert {r.INTERACTION_ID for r in stats.longest_conversation(durations(spark, 2, 2)).collect()} == {"c0"}


def test_roles_overlap_and_leave_gaps(spark):
    log = chat(
        spark,
        ("a", "AGENT", None),
        ("a", "CLIENT", "Live Chat"),
        ("a", "AGENT", "Live Chat"),
        ("b", "AGENT", "Ann"),
        ("b", "EXTERNAL", None),
    )
    row = stats.corpus_summary(log).first()
    assert (row.human_messages, row.system_messages) == (2, 3)
    assert tuple(stats.messages_by_role(log).first()) == (1, 1, 3, 2, 1)
    assert stats.chats_without_human(log).first()[0] == 1


def test_null_id_does_not_hide_chats(spark):
    log = chat(spark, ("a", "CLIENT", "x"), (None, "AGENT", "Ann"))
    assert stats.chats_without_human(log).first()[0] == 1


def test_conversations_per_day(spark):
    log = chat(
        spark,
        *[(i, "CLIENT", "n", 0, "", d) for i, d in (("a", "2024-01-01 23:30:00"), ("a", "2024-01-02 00:10:00"), ("b", "2024-01-02 12:00:00"))],
    )
    assert stats.corpus_summary(log).first().avg_conversations_per_day == 1.5
    assert stats.off_hours_chats(log).first()[0] == 1
    assert [r.hour for r in stats.active_hours(log).collect()] == [0, 12, 23]
    assert [tuple(r) for r in stats.interactions_per_hour(log).collect()] == [(0, 1), (12, 1), (23, 1)]
    assert stats.timestamps_in_hour(log).count() == 1


def test_months_of_all_years_meet(spark):
    log = chat(spark, *[("a", None, None, 0, None, f"{y}-03-01 10:00:00") for y in (2023, 2024, 2024)])
    assert [tuple(r) for r in stats.messages_per_month(log).collect()] == [(3, 2, 3)]


def test_returning_clients(spark):
    log = chat(spark, ("a", "CLIENT", "x"), ("a", "CLIENT", "x"), ("b", "CLIENT", "x"), ("c", "CLIENT", "y"), ("c", "AGENT", "y"), ("d", "AGENT", "y"))
    assert [tuple(r) for r in stats.returning_clients(log).collect()] == [("x", 2)]
    assert tuple(stats.client_return_summary(log).first()) == (1, 2)


def test_tokens(spark):
    log = chat(spark, ("a", "CLIENT", "x", 0, "one two"), ("a", "AGENT", "Live Chat", 1, "three"), ("b", "EXTERNAL", None, 2, None))
    assert tuple(stats.token_summary(log).first()) == (3, 1.5, 2, 2.0)


def test_sub_word_tokens(spark):
    pytest.importorskip("tiktoken")

    def load_encoder():
        import tiktoken

        ranks = {bytes([i]): i for i in range(256)}
        return tiktoken.Encoding("bytes", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}).encode

    log = chat(spark, ("a", "CLIENT", "x", 0, "abc"), ("a", "CLIENT", "x", 0, None), ("a", "CLIENT", "x", 0, "è"))
    counted = stats.token_counts(log, encoder_tokens(load_encoder))
    assert sorted(r.token_count for r in counted.collect()) == [0, 2, 3]
    assert stats.token_summary(log, encoder_tokens(load_encoder)).first().total_tokens == 5


def test_summaries_take_one_scan(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("INTERACTION_ID"),
        F.col("role").alias("USERTYPE"),
        F.col("role").alias("USERNICK"),
        F.col("text").alias("MSGTEXT"),
        F.col("turn").alias("TIMESHIFT"),
    )
    for df in (stats.token_summary(log), stats.duration_summary(log), stats.chats_without_human(log)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan
