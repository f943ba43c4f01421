"""Documents, annotators and the responses they give."""

import json

import pytest
from pyspark.sql import functions as F

from chatlens.functions.features import CLOSED, CLOSED_LIST, DEFAULT_FEATURES, Feature
from chatlens.operators import annotate, conversations
from chatlens.plans import adapters as A
from chatlens.plans.catalog import documents_of
from chatlens.plans.stages import annotate_stage


def events(spark, *rows):
    return spark.createDataFrame(rows, "INTERACTION_ID string, EVENT_ID int, USERNICK string, USERTYPE string, AN_MSGTEXT string")


def test_messages_are_in_event_order_with_nulls_kept(spark):
    log = events(spark, ("a", 10, "n", "CLIENT", "last"), ("a", 2, "n", "CLIENT", "perché"), ("a", 1, None, "AGENT", None))
    row = conversations.conversation_json(conversations.assemble_conversations(log)).first()
    assert json.loads(row.json_string) == [
        {"USERNICK": None, "USERTYPE": "AGENT", "AN_MSGTEXT": None},
        {"USERNICK": "n", "USERTYPE": "CLIENT", "AN_MSGTEXT": "perché"},
        {"USERNICK": "n", "USERTYPE": "CLIENT", "AN_MSGTEXT": "last"},
    ]
    assert "perché" in row.json_string


def test_a_long_conversation_becomes_parts_that_join_to_the_whole(spark):
    log = events(spark, *[("hot", i, "n", "CLIENT", f"m{i}") for i in range(1, 26)], ("cold", 1, "n", "CLIENT", "x"))
    docs = conversations.assemble_conversations(log, block_events=10)
    rows = {(r.INTERACTION_ID, r.PART): [m.AN_MSGTEXT for m in r.chats] for r in docs.collect()}
    assert {k: len(v) for k, v in rows.items()} == {("hot", 0): 10, ("hot", 1): 10, ("hot", 2): 5, ("cold", 0): 1}
    assert sum((rows[("hot", p)] for p in range(3)), []) == [f"m{i}" for i in range(1, 26)]


def test_a_long_conversation_is_one_document_and_one_feature_row(spark):
    log = events(spark, *[("hot", i, "n", "CLIENT", f"m{i}") for i in range(2500, 0, -1)], (None, 1, "n", "CLIENT", "x"))
    (row,) = conversations.assemble_conversations(log).collect()
    assert [m.AN_MSGTEXT for m in row.chats] == [f"m{i}" for i in range(1, 2501)]
    features = [Feature("a", CLOSED), Feature("b", CLOSED_LIST)]

    def annotator(docs):
        # Blocks answer with what their first message tells.
        first = F.col("chats")[0]["AN_MSGTEXT"]
        late = F.when(first == "m1", "NA").otherwise(first)
        return docs.withColumn("response", F.to_json(F.struct(late.alias("a"), F.array(first, F.lit("x")).alias("b"))))

    assert annotate_stage(log, annotator, features).count() == 1
    (row,) = annotate_stage(log, annotator, features, block_events=1000).collect()
    assert (row.INTERACTION_ID, row.success, row.a, row.b) == ("hot", True, "m1001", ["m1", "x", "m1001", "m2001"])


def test_merging_parts(spark):
    features = [Feature("a", CLOSED), Feature("b", CLOSED_LIST)]
    rows = [("c", 1, True, "NA", None), ("c", 0, False, None, None), ("d", 2, True, "y", ["q", "r"]), ("d", 0, True, "x", ["r", "p"])]
    parts = spark.createDataFrame(rows, "INTERACTION_ID string, PART int, success boolean, a string, b array<string>")
    got = {r.INTERACTION_ID: (r.success, r.a, r.b) for r in annotate.merge_parts(parts, features).collect()}
    assert got == {"c": (True, "NA", None), "d": (True, "x", ["r", "p", "q"])}


def test_messages_are_shuffled_once(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("INTERACTION_ID"),
        F.col("turn").alias("EVENT_ID"),
        F.col("role").alias("USERNICK"),
        F.col("role").alias("USERTYPE"),
        F.col("text").alias("AN_MSGTEXT"),
    )
    docs = conversations.conversation_json(conversations.assemble_conversations(log))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("FileScan parquet [conv_id#") == 1


def test_only_the_text_goes_to_python(spark):
    docs = spark.createDataFrame([("i", "t", 1)], "INTERACTION_ID string, json_string string, chats int")
    answered = annotate.annotate(docs, lambda: lambda prompts: prompts).select("INTERACTION_ID", "response")
    plan = answered._jdf.queryExecution().optimizedPlan().toString()
    (line,) = [x for x in plan.splitlines() if "EvalPython" in x]
    assert "json_string" in line and "chats" not in line and "INTERACTION_ID" not in line


def test_prompt(spark):
    docs = spark.createDataFrame([("[]",)], "json_string string")
    prompt = conversations.render_prompt(docs, "Use {class_list}, as {json}. ", {"class_list": "A/B"})
    assert prompt.first().prompt == "Use A/B, as {json}. []"


def test_one_bad_row_does_not_spoil_its_batch(spark):
    def fussy():
        def ask(prompts):
            if any("bad" in p for p in prompts):
                raise KeyError("bad prompt")
            return [p.upper() for p in prompts]

        return ask

    docs = spark.createDataFrame([(f"p{i}",) for i in range(9)] + [("bad",)], "json_string string")
    answered = annotate.annotate(docs, fussy, batch_size=4, partitions=2)
    got = {r.json_string: r.response for r in answered.collect()}
    assert got.pop("bad") == "Error: KeyError; ('bad prompt',)"
    assert got == {f"p{i}": f"P{i}" for i in range(9)}


def test_wrong_number_of_answers_is_an_error(spark):
    docs = spark.createDataFrame([("x",)], "json_string string")
    response = annotate.annotate(docs, lambda: lambda prompts: []).first().response
    assert response.startswith("Error: ValueError;")


def test_python_and_native_annotators_agree(spark, sf_dir):
    docs = documents_of(A.chat_log(spark, sf_dir))
    native = annotate.annotate_with_lexicon(docs, A.LEXICON, column="native")
    both = annotate.annotate(native, lambda: annotate.LexiconAnnotator(A.LEXICON)).collect()
    assert both and all(r.native == r.response for r in both)


@pytest.mark.parametrize(
    "text, success",
    [
        ('{"a":"1","E":["x"]}', True),
        (' \n{"a": {"b": null}} ', True),
        ("{}", True),
        ("Error: X; ()", False),
        ("", False),
        (None, False),
        ("[1]", False),
        ('"text"', False),
        ("3", False),
        ('{"a":1', False),
        ('{"a":1} x', False),
        ('{"a":1}{"b":2}', False),
        ('{"a":1},{"b":2}', False),
        ('{"a":1},"w":2', False),
        ('{"a":1}],[{"b":2}', False),
        ('{"a":1}},{"b":{"c":2}', False),
        ('{"a":1,"a":2}', True),
        ('{"a":NaN,"b":[-Infinity]}', True),
        ('{"a":1,"a":2} x', False),
        ('{"a":NaN}}', False),
    ],
)
def test_success_means_one_json_object(spark, text, success):
    try:
        python = isinstance(json.loads(text or ""), dict)
    except json.JSONDecodeError:
        python = False
    row = annotate.parse_responses(spark.createDataFrame([(text,)], "response string")).first()
    assert row.success is success is python
    assert (row.parsed is not None) is success


def flat(spark, text, features):
    df = annotate.parse_responses(spark.createDataFrame([(text,)], "response string"))
    return annotate.flatten_features(df, features).first()


def test_features_under_their_aliases(spark):
    row = flat(
        spark,
        json.dumps(
            {
                "Risoluzione_richiesta_cliente": "Risolto",
                "Emozioni": {"Cliente": ["Gioia", "Paura"]},
                "Emozioni operatore": "Rabbia",
                "Tono.Cliente": "Ironico",
                "Livello_linguistico_cliente": 3,
                "Argomento_conversazione": [],
            }
        ),
        DEFAULT_FEATURES,
    )
    assert row.Risoluzione_richiesta == "Risolto"
    assert row.Emozioni_cliente == ["Gioia", "Paura"]
    assert row.Emozioni_operatore == ["Rabbia"]
    assert row.Tono_cliente == "Ironico"
    assert row.Livello_linguistico_cliente == "3"
    assert row.Argomento_conversazione == []
    assert row.Soddisfazione_cliente is None and row.success is True


def test_repeated_keys_and_words_for_numbers(spark):
    row = flat(spark, '{"a":"x","a":"y","n":{"k":NaN}}', (Feature("a", CLOSED), Feature("n.k", CLOSED)))
    assert (row.a, row["n.k"], row.other_keys) == ("y", "NaN", None)


def test_undeclared_keys_are_kept(spark):
    features = (Feature("a", CLOSED), Feature("t", CLOSED, aliases=("tone.client",)))
    row = flat(spark, '{"a":"x","b":1,"c":{"d":[2],"e":{}},"tone":{"client":"p","mood":null}}', features)
    assert (row.a, row.t) == ("x", "p")
    assert json.loads(row.other_keys) == {"b": 1, "c.d": [2], "c.e": {}, "tone.mood": None}
    assert flat(spark, '{"a":"x"}', features).other_keys is None


def test_flattening_a_failed_response(spark):
    row = flat(spark, "Error: X; ()", (Feature("a", CLOSED), Feature("b", CLOSED_LIST)))
    assert (row.success, row.a, row.b, row.response) == (False, None, None, "Error: X; ()")


def test_flatten_struct_names_leaves_by_their_path(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":{"d":"x"}},"l":[1,2]}',)], "t string").select(
        F.from_json("t", "a struct<b: int, c: struct<d: string>>, l array<int>").alias("p"), "t"
    )
    out = annotate.flatten_struct(df, "p")
    assert out.dtypes == [("t", "string"), ("a_b", "string"), ("a_c_d", "string"), ("l", "array<int>")]
    assert tuple(out.first())[1:] == ("1", "x", [1, 2])


def test_response_schema_can_be_read_back(spark):
    df = annotate.parse_responses(
        spark.createDataFrame([('{"a":1}',), ('{"a":2,"b":{"c":"x"}}',), ("no",)], "response string")
    )
    schema = annotate.response_schema(df).first().schema
    assert "a" in schema and "c" in schema


def discovered(spark, *responses):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "id int, response string")
    return annotate.flatten_discovered(annotate.parse_responses(df).drop("response", "success"))


def test_columns_found_in_the_responses(spark):
    out = discovered(
        spark, '{"a":1,"t":{"u":"x"}}', '{"a":"two","l":["p",null]}', "Error: X; ()", '{"t":{"v":NaN},"n":null}', None, "{}"
    )
    assert out.dtypes == [("id", "int"), ("a", "string"), ("l", "array<string>"), ("n", "string"), ("t_u", "string"), ("t_v", "string")]
    found = {r.id: tuple(r)[1:] for r in out.collect()}
    none = (None,) * 5
    assert found == {
        0: ("1", None, None, "x", None),
        1: ("two", ["p", None], None, None, None),
        2: none,
        3: (None, None, None, None, "NaN"),
        4: none,
        5: none,
    }


def test_no_columns_without_any_object(spark):
    assert discovered(spark, "no", None).columns == ["id"] and discovered(spark).columns == ["id"]
