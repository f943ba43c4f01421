"""Cleaning: golden rows, invariants, and the plan of the attribute fill."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlens.operators import clean
from chatlens.plans import adapters as A
from chatlens.schema import CHAT, RAW_CHAT, RAW_CHAT_COLUMNS


def raw(spark, *rows):
    full = [{**dict.fromkeys(RAW_CHAT_COLUMNS), **r} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in RAW_CHAT_COLUMNS) for r in full], RAW_CHAT)


GOOD = {"DATE_TIME": "2024-01-02 10:11:12", "INTERACTION_ID": "I1", "USER_ID": "U1", "EVENT_ID": "1"}


def test_copies_with_nulls_become_one_row(spark):
    assert clean.remove_error_rows(raw(spark, GOOD, GOOD)).count() == 1


def test_error_rows(spark):
    df = raw(
        spark,
        GOOD,
        {**GOOD, "INTERACTION_ID": None},
        {**GOOD, "USER_ID": None},
        {**GOOD, "DATE_TIME": "yesterday"},
        {**GOOD, "DATE_TIME": None},
    )
    assert clean.find_error_rows(df).count() == 4
    assert clean.remove_error_rows(df).count() == 1


def test_null_on_first_event_stays_null(spark):
    df = raw(
        spark,
        {**GOOD, "EVENT_ID": "1"},
        {**GOOD, "EVENT_ID": "2", "USERNICK": "x"},
        {**GOOD, "EVENT_ID": "10", "USERNICK": "y"},
    )
    filled = clean.fill_user_attributes(df)
    assert {r.USERNICK for r in filled.collect()} == {None}
    filled = clean.fill_user_attributes(df, ignore_nulls=True)
    assert {r.USERNICK for r in filled.collect()} == {"x"}


def test_event_numbers_are_compared_as_numbers(spark):
    df = raw(
        spark,
        {**GOOD, "EVENT_ID": "10", "USERNICK": "late"},
        {**GOOD, "EVENT_ID": "9", "USERNICK": "early"},
    )
    assert {r.USERNICK for r in clean.fill_user_attributes(df).collect()} == {"early"}


def test_unreadable_numbers_become_null(spark):
    row = clean.clean_chat(raw(spark, {**GOOD, "TIMESHIFT": "soon", "EVENT_ID": "x"})).first()
    assert row.TIMESHIFT is None and row.EVENT_ID is None


def test_clean_chat_has_the_declared_schema(spark):
    df = clean.clean_chat(raw(spark, GOOD))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in CHAT]
    row = df.first()
    assert (str(row.DATE_TIME), str(row.DATE), row.TIME) == (
        "2024-01-02 10:11:12",
        "2024-01-02",
        "10:11:12",
    )


def test_report_adds_up_and_keys_are_complete(spark, sf_dir):
    log = A.raw_log(spark, sf_dir)
    report = clean.cleaning_report(log).first()
    assert report.total_rows == log.count()
    assert report.total_rows == report.error_rows + report.duplicate_rows + report.remaining_rows
    cleaned = clean.clean_chat(log)
    assert report.remaining_rows == cleaned.count()
    profile = clean.null_profile(cleaned).first()
    assert (profile.INTERACTION_ID, profile.USER_ID, profile.DATE) == (0, 0, 0)


def test_null_profile_of_numbers(spark):
    df = spark.createDataFrame([(float("nan"), "None"), (1.0, "an NULL"), (None, "")], "x double, s string")
    assert tuple(clean.null_profile(df).first()) == (2, 3)


def test_hot_user_is_split(spark):
    """A third of the rows under one USER_ID: the adaptive join reads its partition in slices."""
    sized = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    n = 30_000
    log = spark.range(0, n, 1, 8).select(
        F.lit("2024-01-02 10:11:12").alias("DATE_TIME"),
        F.col("id").cast("string").alias("INTERACTION_ID"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 4000)).alias("USER_ID"),
        F.col("id").cast("string").alias("EVENT_ID"),
        *[
            F.concat(F.lit(c), F.col("id").cast("string")).alias(c)
            for c in ("PERSON_ID", "USERNICK", "USERTYPE", "PROTOCOLTYPE", "CLIENTVERSION")
        ],
    )
    old = {k: spark.conf.get(k, None) for k in sized}
    try:
        for k, v in sized.items():
            spark.conf.set(k, v)
        filled = clean.fill_user_attributes(log)
        rows = filled.filter("USER_ID = 'hot' AND USERNICK = 'USERNICK0'")
        joined = filled.groupBy("USER_ID").agg(F.count("*").alias("n"), F.count_distinct("USERNICK").alias("k"))
        got = {r.USER_ID: (r.n, r.k) for r in joined.collect()}
        assert got["hot"] == (n // 3, 1)
        assert sum(v[0] for v in got.values()) == n
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
        assert rows.count() == n // 3
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_unused_attributes_cost_no_join(spark, sf_dir):
    plan = A.chat_log(spark, sf_dir).select("INTERACTION_ID", "TIMESHIFT")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # The one that is left joins the test tables.
    assert text.count("LeftOuter") == 1 and "event_id" in text.split("LeftOuter")[1].splitlines()[0]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["u1", "u2", None]),
            st.sampled_from(["1", "2", "3", "12", None]),
            st.sampled_from(["a", "b", None]),
        ),
        min_size=1,
        max_size=12,
    )
)
def test_fill_equals_the_window_it_replaces(spark, rows):
    df = raw(
        spark,
        *[{**GOOD, "USER_ID": u, "EVENT_ID": e, "USERNICK": k, "INTERACTION_ID": f"I{i:02}"} for i, (u, e, k) in enumerate(rows)],
    )
    df = clean.remove_error_rows(df)
    got = {r.INTERACTION_ID: r.USERNICK for r in clean.fill_user_attributes(df).collect()}
    df.createOrReplaceTempView("rows_for_window")
    want = spark.sql(
        "SELECT INTERACTION_ID, first(USERNICK) OVER (PARTITION BY USER_ID ORDER BY cast(EVENT_ID AS int), INTERACTION_ID) AS k FROM rows_for_window"
    )
    assert got == {r.INTERACTION_ID: r.k for r in want.collect()}


@pytest.mark.parametrize("shift, expected", [(5, "2024-01-02 10:11:17"), (None, "None")])
def test_event_time(spark, shift, expected):
    df = clean.clean_chat(raw(spark, {**GOOD, "TIMESHIFT": None if shift is None else str(shift)}))
    assert str(clean.event_time(df).first().DATE_TIME) == expected


def test_drop_and_rename_pass_over_unknown_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.drop_columns(df, "b", "zz").columns == ["a"]
    assert clean.rename_columns(df, {"a": "x", "zz": "y"}).columns == ["x", "b"]


@pytest.mark.parametrize("ignore_nulls", [False, True])
def test_the_whole_log_meets_no_sort_aggregate(spark, sf_dir, ignore_nulls):
    """Texts are compared only behind the join with the least event numbers."""
    log = A.raw_log(spark, sf_dir)
    first = clean.first_event_attributes(log, ignore_nulls=ignore_nulls)
    lines = first._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    sorts = [i for i, x in enumerate(lines) if "SortAggregate" in x or "min(struct" in x]
    assert sorts
    for i in sorts:
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert any("Join" in x for x in lines[i + 1 : end])
    assert any("HashAggregate" in x and "partial_min" in x for x in lines)


def test_first_events_with_equal_numbers_and_none(spark):
    """Equal and missing numbers, a user in several conversations, a null user."""
    rows = [
        ("u", "2", "c2", "t", "b"), ("u", "2", "c1", "t", "a"), ("u", "10", "c0", "t", "z"),
        ("v", "x", "c3", "t", None), ("v", None, "c4", "t", "q"), ("v", "1", "c1", "t", "r"),
        ("w", "1", "c1", "t", None), (None, "1", "c1", "t", "n"),
    ]
    log = spark.createDataFrame(rows, "USER_ID string, EVENT_ID string, INTERACTION_ID string, DATE_TIME string, USERNICK string")
    got = lambda skip: {r.USER_ID: r.USERNICK for r in clean.first_event_attributes(log, ("USERNICK",), skip).collect()}
    assert got(False) == {"u": "a", "v": None, "w": None, None: "n"}
    assert got(True) == {"u": "a", "v": "q", "w": None, None: "n"}
