"""Feature quality and topics."""

from chatlens.functions.features import CLOSED, CLOSED_LIST, Feature, alias_map
from chatlens.operators import insights

TONE = Feature("tone", CLOSED, ("calm", "loud"), ("Tono cliente",))
MOODS = Feature("moods", CLOSED_LIST, ("joy", "fear"))


def test_list_text(spark):
    df = spark.createDataFrame([("['joy', 'no fear']", "['a b', 'c']"), ("NA", "NA"), (None, None)], "m string, t string")
    rows = [tuple(r) for r in insights.parse_list_text(df, ["m", "t"], keep_blanks=["t"]).collect()]
    assert rows == [(["joy", "nofear"], ["a b", " c"]), (["NA"], ["NA"]), (None, None)]
    again = insights.parse_list_text(insights.parse_list_text(df, ["m"]), ["m"])
    assert again.first().m == ["joy", "nofear"]


def test_variants(spark):
    df = spark.createDataFrame(
        [("nan", "x", ["nan"], ["y"]), ("a", "nan", ["b"], ["nan"]), (None, "x", None, ["y"])],
        "t string, t2 string, l array<string>, l2 array<string>",
    )
    rows = [tuple(r) for r in insights.coalesce_variant_columns(df, {"t": "t2", "l": "l2"}).collect()]
    assert rows == [("x", ["y"]), ("a", ["b"]), ("x", ["y"])]


def test_vocabulary(spark):
    df = spark.createDataFrame([("calm",), ("NA",), (None,), ("odd",), ("odd",), ("new",)], "tone string")
    assert insights.out_of_vocabulary_counts(df, [TONE]).first().tone == 3
    rows = {tuple(r) for r in insights.out_of_vocabulary_values(df, [TONE]).collect()}
    assert rows == {("tone", "odd", 2), ("tone", "new", 1)}
    assert tuple(insights.out_of_vocabulary_value_counts(df, [TONE]).first()) == ("tone", 2)


def test_generated_items_keep_repeats(spark):
    df = spark.createDataFrame([(["joy", "hope", "hope"],), (["NA"],), (None,)], "moods array<string>")
    out = insights.generated_list_items(df, [MOODS])
    assert [r.generated_moods for r in out.collect()] == [["hope", "hope"], [], None]
    assert [tuple(r) for r in insights.generated_item_counts(out, "generated_moods").collect()] == [("hope", 2)]
    assert tuple(insights.generated_item_totals(out, "generated_moods").first()) == (2, 1)
    assert insights.multi_valued_rows(df, "moods").count() == 1


def test_missing_lists_do_not_shift_averages(spark):
    df = spark.createDataFrame([(["a", "b"],), (None,)], "l array<string>")
    assert insights.list_size_stats(df, ["l"]).first().avg_l == 2.0


def test_topics(spark):
    df = spark.createDataFrame([(["Bonus benvenuto", " conto"],), (["conto", "Prelievo conto", "Voli"],)], "t array<string>")
    assert tuple(insights.topic_counts(df, "t").first()) == (5, 4)
    classified = insights.classify_topics(df, "t")
    assert {(r.topic, r.n, r.topic_class) for r in classified.collect()} == {
        ("Bonus benvenuto", 1, "bonus"),
        ("conto", 2, "conto"),
        ("Prelievo conto", 1, "prelievi"),
        ("Voli", 1, "altro"),
    }
    assert {tuple(r) for r in insights.topic_class_counts(classified, "all").collect()} == {
        ("bonus", 1), ("conto", 2), ("prelievi", 1), ("altro", 1)
    }
    assert insights.distinct_topic_sets(df, "t").first()[0] == 2


def test_failed_and_empty_annotations(spark):
    df = spark.createDataFrame(
        [("1", True, "NA", "NA"), ("2", False, "NA", "x"), ("3", True, None, "NA")], "INTERACTION_ID string, success boolean, a string, b string"
    )
    assert insights.failed_annotation_count(df).first()[0] == 1
    assert {r.INTERACTION_ID for r in insights.failed_annotations(df, ["3"]).collect()} == {"2", "3"}
    assert [r.INTERACTION_ID for r in insights.all_na_rows(df, ["a", "b"]).collect()] == ["1"]
    assert insights.all_na_count(df, ["a", "b"]).first()[0] == 1


def test_summary_lengths(spark):
    df = spark.createDataFrame([("perché",), ("a",), (None,)], "s string")
    assert tuple(insights.summary_length_stats(df, "s").first()) == (3.5, 6)


def test_alias_map():
    assert alias_map((TONE, MOODS)) == {"Tono cliente": "tone"}
