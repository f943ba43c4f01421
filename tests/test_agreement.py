"""Agreement with human annotators."""

from pyspark.sql import functions as F

from chatlens.operators import agreement
from chatlens.plans import adapters as A
from chatlens.plans.catalog import _compared

FEATURES = ("tone", "mood")


def frames(spark):
    model = spark.createDataFrame(
        [("1", "a", "x"), ("2", "b", None), ("3", "c", "z"), ("9", "q", "q")], "INTERACTION_ID string, tone string, mood string"
    )
    people = spark.createDataFrame(
        [("V", "1", "a", "x"), ("V", "2", "B", "y"), ("V", "3", "C", "z"), ("W", "1", "A", "x"), ("W", "3", "C", "Z"), ("W", "7", "a", "a")],
        "annotator string, INTERACTION_ID string, tone string, mood string",
    )
    return model, people


def test_counts_sets_and_fields_tell_the_same(spark):
    model, people = frames(spark)
    counts = {r.annotator: (r.diff_tone, r.diff_mood) for r in agreement.mismatch_counts(model, people, FEATURES).collect()}
    assert counts == {"V": (2, 0), "W": (2, 1)}
    sets = {r.INTERACTION_ID: (r.tone, r.mood) for r in agreement.disagreement_sets(model, people, FEATURES).collect()}
    assert sets == {"1": (["W"], []), "2": (["V"], []), "3": (["V", "W"], ["W"])}
    assert sum(len(t) for t, _ in sets.values()) == sum(t for t, _ in counts.values())


def test_null_rule(spark):
    model, people = frames(spark)
    strict = {r.annotator: r.diff_mood for r in agreement.mismatch_counts(model, people, FEATURES, null_is_match=False).collect()}
    assert strict == {"V": 1, "W": 1}


def test_average_row(spark):
    model, people = frames(spark)
    rows = {r.annotator: (r.diff_tone, r.diff_mood) for r in agreement.mismatch_with_average(agreement.mismatch_counts(model, people, FEATURES)).collect()}
    assert rows == {"V": (2.0, 0.0), "W": (2.0, 1.0), "average": (2.0, 0.5)}


def test_main_emotion_and_tones(spark):
    df = spark.createDataFrame(
        [("Emozione primaria: Gioia; secondaria: Paura;", "Formale", "x"), ("none", "Ironico", "x"), (None, None, "x")],
        "e string, t string, Livello_linguistico_operatore string",
    )
    rows = [tuple(r) for r in agreement.normalise_annotations(df, emotions=["e"], tones=["t"]).collect()]
    assert rows == [("Gioia", "Neutrale"), (None, "Ironico"), (None, None)]


def test_first_emotion_of_arrays_and_of_text(spark):
    df = spark.createDataFrame([(["a", "b"], "['c', 'd']"), ([], "NA"), (None, None)], "x array<string>, y string")
    rows = [tuple(r) for r in agreement.primary_emotion(df, ["x", "y"]).collect()]
    assert rows == [("a", "c"), (None, None), (None, None)]


def test_nulls_alone_make_no_mismatch(spark, sf_dir):
    model, people = _compared(spark, sf_dir)
    rows = agreement.mismatch_counts(model, people, A.COMPARED).collect()
    assert len(rows) == 4 and all(r.diff_satisfaction == 0 for r in rows)


def test_known_answers_for_four_conversations_in_ten(spark, sf_dir):
    model, people = _compared(spark, sf_dir)
    some = people.filter(F.substring("INTERACTION_ID", -1, 1) < "4")
    rows = agreement.mismatch_counts(model, some, A.COMPARED).orderBy("annotator").collect()
    assert [r.diff_resolution for r in rows] == [4, 3, 2, 1]
    assert [r.diff_language_level for r in rows] == [2, 1, 1, 1]


def test_one_join_serves_all_annotators(spark):
    model, people = frames(spark)
    plan = agreement.mismatch_with_average(agreement.mismatch_counts(model, people, FEATURES))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join Inner") == 1


def test_hot_conversation_gives_short_lists(spark):
    """Many rows of one annotator for one conversation end up as one name."""
    model, _ = frames(spark)
    people = spark.range(3000).select(
        F.lit("V").alias("annotator"), F.lit("1").alias("INTERACTION_ID"), F.lit("no").alias("tone"), F.lit("x").alias("mood")
    )
    row = agreement.disagreement_sets(model, people, FEATURES).first()
    assert (row.tone, row.mood) == (["V"], [])
