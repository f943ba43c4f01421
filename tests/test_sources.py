"""Round trips through files, samples, and the run of all stages."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.features import Feature
from chatlens.operators import annotate, clean
from chatlens.plans import adapters as A, stages
from chatlens.plans.stages import run_stages
from chatlens.schema import CHAT, CORRUPT_LINE, RAW_CHAT, RAW_CHAT_COLUMNS
from chatlens.sources import (
    read_annotations,
    read_chat_log,
    register_views,
    rename_positional,
    sample_by_ids,
    sample_top_conversations,
    scratch_path,
    shared_folder,
    write_table,
)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def raw_csv(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "log")
    raw = A.raw_log(spark, sf_dir).withColumn("MSGTEXT", F.translate("MSGTEXT", "\n\r", "  "))
    write_table(raw, path, fmt="csv", sep=";")
    return path


def test_csv_round_trip(spark, sf_dir, raw_csv):
    raw = A.raw_log(spark, sf_dir).withColumn("MSGTEXT", F.translate("MSGTEXT", "\n\r", "  "))
    assert rows(read_chat_log(spark, raw_csv)) == rows(raw)


def test_line_breaks_quotes_and_separators_in_messages(spark, tmp_path):
    text = 'a "quoted"; line\nand another, \\ end'
    df = spark.createDataFrame([(text, "I")], "MSGTEXT string, INTERACTION_ID string")
    write_table(df, str(tmp_path / "t"), fmt="csv", sep=";")
    assert read_chat_log(spark, str(tmp_path / "t"), schema=df.schema, multi_line=True).first().MSGTEXT == text


def test_parquet_partitioned_and_sorted(spark, sf_dir, tmp_path):
    chat = A.chat_log(spark, sf_dir)
    write_table(chat, str(tmp_path / "days"), partition_by=["DATE"])
    assert rows(spark.read.parquet(str(tmp_path / "days")).select(*chat.columns)) == rows(chat)
    write_table(chat, str(tmp_path / "sorted"), sort_by=["INTERACTION_ID", "EVENT_ID"])
    back = read_chat_log(spark, str(tmp_path / "sorted"), schema=CHAT, fmt="parquet")
    assert rows(back) == rows(chat)


def test_unknown_formats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        read_chat_log(spark, str(tmp_path), fmt="xml")
    with pytest.raises(ValueError):
        write_table(spark.range(1), str(tmp_path / "x"), fmt="xml")


def test_rename_positional(spark):
    df = spark.createDataFrame([(1, 2)], "_c0 int, _c1 int")
    assert rename_positional(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError):
        rename_positional(df, ["a"])


def test_annotations_become_one_long_table(spark, tmp_path):
    schema = "INTERACTION_ID string, tone string"
    for name, tone in (("V", "calm"), ("W", "loud")):
        write_table(spark.createDataFrame([("1", tone)], schema), str(tmp_path / name), fmt="csv", sep=";")
    df = read_annotations(
        spark, {n: str(tmp_path / n) for n in ("V", "W")}, spark.createDataFrame([], schema).schema
    )
    assert rows(df) == [("1", "calm", "V"), ("1", "loud", "W")]


def test_views(spark):
    register_views({"v_one": spark.range(3), "v_two": spark.range(5)})
    assert spark.sql("SELECT (SELECT count(*) FROM v_one) + (SELECT count(*) FROM v_two)").first()[0] == 8


def test_pasted_ids(spark):
    ids = ["0" * 15 + c for c in "ABC"]
    df = spark.createDataFrame([(i,) for i in [*ids, "0" * 16]], "INTERACTION_ID string")
    text = "\n" + "\n".join(ids) + "\n"
    assert rows(sample_by_ids(df, text)) == [(i,) for i in ids]


def test_top_conversations(spark):
    df = spark.createDataFrame([(c, i) for c, n in (("b", 2), ("a", 2), ("c", 3), ("d", 1)) for i in range(n)], "INTERACTION_ID string, EVENT_ID int")
    got = [tuple(r) for r in sample_top_conversations(df, 2).collect()]
    assert got == [("a", 0), ("a", 1), ("c", 0), ("c", 1), ("c", 2)]
    plan = sample_top_conversations(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LeftSemi" in plan


def test_all_stages(spark, sf_dir, raw_csv, tmp_path):
    features = [Feature(f.name, f.kind, f.vocabulary) for f in A.FEATURES if f.name in A.LEXICON]
    run_stages(
        spark, raw_csv, str(tmp_path), lambda docs: annotate.annotate_with_lexicon(docs, A.LEXICON), features
    )
    table = {
        name: spark.read.parquet(str(tmp_path / name))
        for name in ("errors", "cleaned", "humans", "systems", "redacted", "responses", "features")
    }
    report = clean.cleaning_report(read_chat_log(spark, raw_csv)).first()
    assert table["errors"].count() == report.error_rows
    assert table["cleaned"].count() == table["redacted"].count() == report.remaining_rows
    assert table["humans"].count() == report.human_rows
    assert table["systems"].count() == report.system_rows
    conversations = table["cleaned"].select("INTERACTION_ID").distinct().count()
    assert table["responses"].count() == table["features"].count() == conversations
    assert table["features"].filter("success").count() == conversations


def test_raw_schema_is_text_only():
    assert {f.dataType.simpleString() for f in RAW_CHAT} == {"string"}
    assert len(RAW_CHAT_COLUMNS) == 15 and len(CHAT) == 17


def test_malformed_lines_are_kept_as_errors(spark, tmp_path):
    good = ["2024-01-01 00:00:00", "i", "u", *["x"] * 12]
    lines = [";".join(RAW_CHAT_COLUMNS), ";".join(good), ";".join([*good, "more"]), ";".join(good[:5])]
    (tmp_path / "log.csv").write_text("\n".join(lines))
    raw = read_chat_log(spark, str(tmp_path / "log.csv"), corrupt_column=CORRUPT_LINE)
    errors = {r[CORRUPT_LINE] for r in clean.find_error_rows(raw).collect()}
    assert errors == {lines[2], lines[3]}
    kept = clean.remove_error_rows(raw)
    assert kept.columns == list(RAW_CHAT_COLUMNS) and kept.count() == 2
    assert CORRUPT_LINE not in read_chat_log(spark, str(tmp_path / "log.csv")).columns


def test_all_stages_with_the_default_scheme(spark, raw_csv, tmp_path):
    """From the raw log and four annotators' tables to mismatches and topic classes."""

    def annotator(docs):
        n = F.crc32("INTERACTION_ID") % 3
        first = F.when(n == 0, "Risolto").when(n == 1, "Boh").otherwise("Non risolto")
        emotions = F.array(F.lit("Gioia"), F.lit("Paura"))
        topics = F.when(n == 0, F.array(F.lit("bonus di benvenuto"))).otherwise(F.array(F.lit("altro tema"), F.lit("Prelievo")))
        fields = {
            "Risoluzione_richiesta_cliente": first,
            "Emozioni cliente": emotions,
            "Tono.Cliente": F.lit("Neutrale"),
            "Argomento_conversazione": topics,
            "Riassunto": F.lit("breve"),
            "Extra": n,
        }
        return docs.withColumn("response", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))

    out = str(tmp_path / "out")
    stages.run_stages(spark, raw_csv, out, annotator)
    ids = sorted(r.INTERACTION_ID for r in spark.read.parquet(f"{out}/features").collect())
    columns = ("INTERACTION_ID", "Risoluzione_richiesta_cliente", "Emozione_prevalente_cliente", "Tono_conversazione_cliente")
    paths = {}
    for name in "ABCD":
        paths[name] = str(tmp_path / f"{name}.csv")
        emotion = "Gioia" if name == "A" else "Rabbia"
        # Emotions hold the separator of this file, hence the quotes.
        rows = [f'{i};Risolto;"Emozione primaria: {emotion}; secondaria: NA;";Formale' for i in ids]
        (tmp_path / f"{name}.csv").write_text("\n".join([";".join(columns), *rows]))
    stages.run_statistics(spark, out)
    stages.run_agreement(spark, out, paths, columns)
    stages.run_insights(spark, out)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert read("statistics/corpus_summary").first().conversations == len(ids)
    features = read("features").collect()
    assert {r.other_keys for r in features} <= {f'{{"Extra":{k}}}' for k in range(3)}
    solved = sum(r.Risoluzione_richiesta == "Risolto" for r in features)
    mismatch = {r.annotator: r for r in read("agreement/mismatch").collect()}
    assert set(mismatch) == {*"ABCD", "average"}
    assert all(r.diff_Risoluzione_richiesta == len(ids) - solved and r.diff_Tono_cliente == 0 for r in mismatch.values())
    assert [mismatch[k].diff_Emozioni_cliente for k in "AB"] == [0, len(ids)]
    assert {tuple(r.Emozioni_cliente) for r in read("agreement/disagreement").collect()} == {("B", "C", "D")}
    classes = {r.topic_class for r in read("insights/topics_Argomento_conversazione").collect()}
    assert classes == {"bonus", "prelievi", "altro"}
    assert {r.value for r in read("insights/out_of_vocabulary").collect()} == {"Boh"}
    assert read("insights/failed").first()[0] == 0


def test_annotators_files_may_differ(spark, tmp_path):
    """Columns in another order, lacking ones, and rows too short for their schema."""
    texts = {"A": "id;x;y\n1;a;b\n2;c\n", "B": "y;id\nq;1\n", "C": "id;z\n"}
    paths, schemas = {}, {}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
        paths[name] = str(tmp_path / f"{name}.csv")
        schemas[name] = T.StructType([T.StructField(c, T.StringType()) for c in text.split("\n")[0].split(";")])
    df = read_annotations(spark, paths, schemas)
    assert df.columns == ["id", "x", "y", "annotator", "z"]
    assert rows(df) == [("1", "a", "b", "A", None), ("1", None, "q", "B", None), ("2", "c", None, "A", None)]


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))
        assert scratch_path(session(master, "s3://bucket/x/"), "t").startswith("s3://bucket/x/t-")
