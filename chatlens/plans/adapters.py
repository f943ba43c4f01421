"""Chat tables derived from the given test tables.

The expressions are written once, in the SQL that Spark and DuckDB share. Spark evaluates them through
the DataFrame API, the oracle pastes them into its SQL text.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.features import (
    CLOSED,
    CLOSED_LIST,
    DEFAULT_FEATURES,
    OPEN_LIST,
    TEXT,
    Feature,
)
from chatlens.operators.annotate import annotate_with_lexicon, flatten_features, parse_responses
from chatlens.operators.clean import clean_chat
from chatlens.operators.conversations import assemble_conversations, conversation_json
from chatlens.operators.insights import coalesce_variant_columns, parse_list_text
from chatlens.operators.redact import pii_redact
from chatlens.sources import read_annotations, scratch_path, write_table

KEY = "(c.conv_id*50+c.turn)"

# Every event is a turn: 50 in a row make a conversation. Where no turn was written the user of the event
# takes part, and says what the event tells; users go from one conversation to the next, but for every
# fourth conversation, which keeps its own users and has no agents but those of written turns.
_ALONE = "floor(e.event_id/50)%4=1"
TURN_COLUMNS = {
    "conv_id": "cast(floor(e.event_id/50) AS bigint)",
    "turn": "e.event_id%50",
    "ts": "e.ts",
    "role": f"CASE WHEN c.conv_id IS NOT NULL THEN c.role WHEN e.user_id%3=0 OR {_ALONE} THEN 'user' WHEN e.user_id%3=1 THEN 'assistant' ELSE 'system' END",
    "text": "CASE WHEN c.conv_id IS NOT NULL THEN c.text ELSE e.props END",
    "participant": f"CASE WHEN c.conv_id IS NULL THEN concat('u',cast(e.user_id AS string), CASE WHEN {_ALONE} THEN concat('-',cast(floor(e.event_id/50) AS bigint)) ELSE '' END) END",
}

RAW_COLUMNS = {
    "DATE_TIME": f"CASE WHEN {KEY}%89=7 THEN 'corrupt' ELSE substring(cast(c.ts AS string),1,19) END",
    "INTERACTION_ID": f"CASE WHEN {KEY}%97=5 THEN NULL ELSE lpad(cast(c.conv_id AS string),16,'0') END",
    "USER_ID": "coalesce(c.participant, concat(cast(c.conv_id AS string),'-',c.role, CASE WHEN c.role='assistant' AND c.turn<=1 THEN '-bot' ELSE '' END))",
    "TIMESHIFT": "cast(c.turn*37 + length(c.text)%30 AS string)",
    "VISIBILITY": "'ALL'",
    "EVENT_ID": "cast(c.turn+1 AS string)",
    "PERSON_ID": "CASE WHEN c.turn<=2 THEN concat('p',cast(c.conv_id%60 AS string)) END",
    "USERNICK": "CASE WHEN c.turn<=3 THEN CASE c.role WHEN 'user' THEN concat('client_',cast(c.conv_id%60 AS string)) WHEN 'assistant' THEN CASE WHEN c.turn<=1 THEN 'Live Chat' ELSE concat('agent_',cast(c.conv_id%5 AS string)) END ELSE 'system' END END",
    "USERTYPE": "CASE WHEN c.turn<=3 THEN CASE c.role WHEN 'user' THEN 'CLIENT' WHEN 'assistant' THEN 'AGENT' ELSE 'EXTERNAL' END END",
    "PROTOCOLTYPE": "CASE WHEN c.turn<=2 THEN 'ESP' END",
    "TZOFFSET": "'60'",
    "CLIENTVERSION": "CASE WHEN c.turn<=2 THEN '1.0' END",
    "MSGTEXT": "CASE WHEN (c.conv_id+c.turn)%11=0 THEN NULL ELSE c.text END",
    "ASKERID": "cast(NULL AS string)",
    "REASON": "CASE WHEN (c.conv_id+c.turn)%22=0 THEN 'left' END",
}

# Conversations as the model sees them: every turn a message, with sensitive data to be redacted.
DIALOGUE_COLUMNS = {
    "INTERACTION_ID": "lpad(cast(c.conv_id AS string),16,'0')",
    "EVENT_ID": "cast(c.turn+1 AS int)",
    "USERNICK": "CASE c.role WHEN 'user' THEN concat('client_',cast(c.conv_id%60 AS string)) WHEN 'assistant' THEN concat('agent_',cast(c.conv_id%5 AS string)) ELSE 'system' END",
    "USERTYPE": "CASE c.role WHEN 'user' THEN 'CLIENT' WHEN 'assistant' THEN 'AGENT' ELSE 'EXTERNAL' END",
}

# What the model reads out of the redacted text of a conversation.
MODEL_LEXICON = {
    "resolution": (("Solved", "eded"), ("Unsolved", "ouou"), ("Unsolvable", "hathe"), ("Partly solved", "ndnd")),
    "satisfaction": (
        ("Very happy", "hesh"),
        ("Happy", "ingin"),
        ("Neutral", "atat"),
        ("Unhappy", "ouer"),
        ("Very unhappy", "edwh"),
    ),
    "client_tone": (
        ("Ironic", "shou"),
        ("Sarcastic", "blere|tihe"),
        ("Emotional", "onre"),
        ("Polite", "orin"),
        ("Neutral", "thly"),
    ),
    "operator_tone": (("Formal", "lyly"), ("Emotional", "whwh"), ("Ironic", "ingti"), ("Neutral", "nded")),
    "language_level": (("High", "bleble"), ("Low", "nting"), ("Medium", "erer")),
    "emotion": (("Joy", "eaan"), ("Anger", "haou"), ("Irony", "tiones"), ("Fear", "anan"), ("Sadness", "inin")),
    "second_emotion": (("Hope", "hain"), ("Sadness", "edea"), ("Joy", "stst")),
    "operator_emotion": (("Neutrality", "thth"), ("Patience", "inghe")),
    "topic": (
        ("Welcome bonus", "shsh"),
        ("Withdrawal", "ly of"),
        ("Registration", "ouer"),
        ("Responsible gaming", "hesh"),
        ("Operator wait", "nded"),
        ("Other matter", "erer"),
    ),
    "second_topic": (("Account closure", "orin"), ("Top-up", "hathe"), ("BONUS missing", "tihe")),
    "summary": (("Much was said", "er.*er.*er"), ("Little was said", "e")),
}


def _listed(first: str, second: str | None = None) -> str:
    """SQL of list text from one or two values, ``NA`` if the first is."""
    both = "" if second is None else f""" WHEN {second}<>'NA' THEN concat('["', {first}, '", "', {second}, '"]')"""
    text = f"""CASE WHEN {first}='NA' THEN 'NA'{both} ELSE concat('["', {first}, '"]') END"""
    # List text has single quotes around its items; written with double ones above for legibility.
    return f"replace({text}, '\"', chr(39))"


# Columns of the features from what the model read, some of it varied by the number of the conversation: nothing
# told at all, a value under the name of a twin column, a missing one, a failure.
PREDICTION_COLUMNS = {
    "INTERACTION_ID": "lpad(cast(conv_id AS string),16,'0')",
    "conv_id": "conv_id",
    "resolution": "CASE WHEN conv_id%13=0 THEN 'NA' ELSE resolution END",
    "satisfaction": "CASE WHEN conv_id%13=0 THEN 'NA' ELSE satisfaction END",
    "client_tone": "CASE WHEN conv_id%13=0 THEN 'NA' WHEN conv_id%7=0 THEN 'nan' ELSE client_tone END",
    "client_tone_variant": "CASE WHEN conv_id%7=0 THEN client_tone ELSE 'nan' END",
    "operator_tone": "CASE WHEN conv_id%13=0 THEN 'NA' WHEN operator_tone='NA' AND conv_id%3=2 THEN NULL ELSE operator_tone END",
    "language_level": "CASE WHEN conv_id%13=0 THEN 'NA' ELSE language_level END",
    "client_emotions": _listed("emotion", "second_emotion"),
    "operator_emotions": _listed("operator_emotion"),
    "topics": _listed("topic", "second_topic"),
    "summary": "concat('Summary of chat ', cast(conv_id AS string), ': ', summary)",
    "success": "conv_id%17<>0 AND NOT (resolution='NA' AND topic='NA')",
}

ANNOTATORS = (("A1", 2), ("A2", 3), ("A3", 5), ("A4", 7))

ANNOTATION_COLUMNS = {
    "annotator": "a.annotator",
    "INTERACTION_ID": "p.INTERACTION_ID",
    "resolution": "CASE WHEN p.conv_id%a.k=0 THEN 'Unsolved' ELSE p.resolution END",
    "satisfaction": "CASE WHEN p.conv_id%(a.k+1)=0 THEN NULL ELSE p.satisfaction END",
    "client_tone": "CASE WHEN p.conv_id%(a.k+2)=0 THEN 'Informal' ELSE p.client_tone END",
    "operator_tone": "CASE WHEN p.conv_id%(a.k+3)=0 THEN 'Formal' ELSE p.operator_tone END",
    "language_level": "CASE WHEN p.conv_id%(a.k+4)=0 THEN 'High' ELSE p.language_level END",
    "client_emotions": "concat('Emozione primaria: ', CASE WHEN p.conv_id%a.k=1 THEN 'Surprise' ELSE 'Joy' END, '; secondaria: NA;')",
    "operator_emotions": "CASE WHEN p.conv_id%(a.k+1)=2 THEN 'no emotion given' ELSE 'Emozione primaria: Neutrality; secondaria: NA;' END",
}

RESPONSE_COLUMNS = {
    "INTERACTION_ID": "INTERACTION_ID",
    "response": """CASE conv_id%8 WHEN 0 THEN 'Error: RateLimitError; ()' WHEN 1 THEN '' WHEN 2 THEN NULL
 WHEN 3 THEN concat('{"resolution":"', resolution, '","tone":{"client":"', client_tone, '"}}')
 WHEN 4 THEN concat('{"resolution":"', resolution, '","emotions":["Joy",null,"Hope|x"],"extra":1}')
 WHEN 5 THEN concat('{"resolution":"first","resolution":"', resolution, '"}')
 WHEN 6 THEN concat('{"resolution":"', resolution, '","tone":{"client":"', client_tone, '","mood":NaN}}')
 ELSE '{"resolution": "Solved"' END""",
}

# Sensitive data of every kind, made from the keys of a conversation turn.
MESSAGE_SNIPPET = f"""CASE {KEY}%13
 WHEN 0 THEN concat(' Write to user.', cast(c.conv_id AS string), '@mail.example.com today')
 WHEN 1 THEN concat(' Card 4', lpad(cast({KEY} AS string),15,'0'))
 WHEN 2 THEN concat(' Card 51', lpad(cast({KEY} AS string),14,'0'), ' expired')
 WHEN 3 THEN concat(' Card 37', lpad(cast({KEY} AS string),13,'0'))
 WHEN 4 THEN concat(' Card 6759', lpad(cast({KEY} AS string),12,'0'))
 WHEN 5 THEN concat(' Call 333-123-', lpad(cast({KEY}%10000 AS string),4,'0'), '.')
 WHEN 6 THEN concat(' See https://shop.example.com/o/', cast({KEY} AS string), '?x=1.')
 WHEN 7 THEN concat(' Pay GB29 6016 1331 9268 ', lpad(cast({KEY}%10000 AS string),4,'0'), ' now')
 WHEN 8 THEN concat(' I am RSSMRA85T10A', cast(100+{KEY}%900 AS string), 'S, hello')
 WHEN 9 THEN concat(' Mail a', cast(c.turn AS string), '@b.example.it or call +39 333 123', lpad(cast({KEY}%10000 AS string),4,'0'))
 WHEN 10 THEN ' At http://a.b@c.it or https://x.com/333-123-4567'
 WHEN 11 THEN concat(' Card 2221', lpad(cast({KEY} AS string),12,'0'), ', IBAN GB29601613319268', lpad(cast({KEY}%10000 AS string),4,'0'))
 ELSE '' END"""
MESSAGE_COLUMNS = {
    "source": "'conversations'",
    "message_id": KEY,
    "MSGTEXT": f"CASE WHEN (c.conv_id+c.turn)%11=0 THEN NULL ELSE concat(c.text, {MESSAGE_SNIPPET}) END",
}
DOCUMENT_COLUMNS = {"source": "'documents'", "message_id": "doc_id", "MSGTEXT": "text"}
PAGE_COLUMNS = {"source": "'pages'", "message_id": "page_id", "MSGTEXT": "concat(url, ' ', html)"}

def _case(column: str, values: dict[str, str]) -> str:
    """SQL of a value under another name; ``NA`` for any other."""
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + " ELSE 'NA' END"


# What the model read, in the words of the default scheme, with some that it does not know.
_TONES = {
    "Neutral": "Neutrale",
    "Emotional": "Emotivo",
    "Ironic": "Ironico",
    "Sarcastic": "Sarcastico",
    "Polite": "Cortese",
    "Formal": "Formale",
}
_EMOTIONS = {
    "Joy": "Gioia",
    "Anger": "Rabbia",
    "Fear": "Paura",
    "Sadness": "Tristezza",
    "Irony": "Ironia",
    "Hope": "Speranza",
    "Neutrality": "Neutralità",
    "Patience": "Pazienza",
}
ITALIAN_COLUMNS = {
    "INTERACTION_ID": "lpad(cast(conv_id AS string),16,'0')",
    "conv_id": "conv_id",
    "resolution": _case(
        "resolution",
        {
            "Solved": "Risolto",
            "Unsolved": "Non risolto",
            "Unsolvable": "Non risolvibile",
            "Partly solved": "Risolto in parte",
        },
    ),
    "satisfaction": _case(
        "satisfaction",
        {
            "Very happy": "Molto soddisfatto",
            "Happy": "Soddisfatto",
            "Neutral": "Neutrale",
            "Unhappy": "Insoddisfatto",
            "Very unhappy": "Molto insoddisfatto",
        },
    ),
    "client_tone": _case("client_tone", _TONES),
    "operator_tone": _case("operator_tone", _TONES),
    "language_level": _case("language_level", {"High": "Alto", "Medium": "Medio", "Low": "Scarso"}),
    "emotion": _case("emotion", _EMOTIONS),
    "second_emotion": _case("second_emotion", _EMOTIONS),
    "operator_emotion": _case("operator_emotion", _EMOTIONS),
    "topic": _case(
        "topic",
        {
            "Welcome bonus": "Bonus di benvenuto",
            "Withdrawal": "Prelievo rifiutato",
            "Registration": "registrazione",
            "Responsible gaming": "Gioco responsabile",
            "Operator wait": "Attesa operatore",
            "Other matter": "Varie",
        },
    ),
    "summary": "concat('Riassunto: ', summary)",
}

# Responses under the default scheme. The names of the features go by the number of the conversation: their own, a
# nested one, or that of an earlier scheme.
ITALIAN_RESPONSE = """CASE conv_id%3
 WHEN 0 THEN concat('{"Risoluzione_richiesta":"', resolution, '","Soddisfazione_cliente":"', satisfaction,
  '","Tono_cliente":"', client_tone, '","Tono_operatore":"', operator_tone, '","Emozioni_cliente":["', emotion, '","', second_emotion,
  '"],"Emozioni_operatore":["', operator_emotion, '"],"Livello_linguistico_cliente":"', language_level,
  '","Argomento_conversazione":["', topic, '"],"Riassunto_conversazione":"', summary, '"}')
 WHEN 1 THEN concat('{"Risoluzione_richiesta_cliente":"', resolution, '","Soddisfazione_cliente":"', satisfaction,
  '","Tono":{"Cliente":"', client_tone, '","Operatore":"', operator_tone, '"},"Emozioni":{"Cliente":["', emotion, '","', second_emotion,
  '"],"Operatore":["', operator_emotion, '"]},"Livello_linguistico_cliente":"', language_level,
  '","Argomento_della_conversazione":"', topic, '","Riassunto":"', summary, '"}')
 ELSE concat('{"Risoluzione_richiesta":"', resolution, '","Percezione_soddisfazione_cliente":"', satisfaction,
  '","Tono_conversazione_cliente":"', client_tone, '","Tono operatore":"', operator_tone, '","Emozione_prevalente_cliente":["', emotion, '","', second_emotion,
  '"],"Emozioni operatore":"', operator_emotion, '","Livello_linguistico_cliente":"', language_level,
  '","Argomento_conversazione":["', topic, '"],"Riassunto":"', summary, '","Nota":', cast(conv_id AS string), '}') END"""
ITALIAN_RESPONSE_COLUMNS = {"INTERACTION_ID": "INTERACTION_ID", "response": ITALIAN_RESPONSE}

# People's files under the names that they use, with tones beyond the scheme; varied by number.
ITALIAN_ANNOTATION_COLUMNS = {
    "INTERACTION_ID": "p.INTERACTION_ID",
    "Risoluzione_richiesta_cliente": "CASE WHEN p.conv_id%a.k=0 THEN 'Non risolto' ELSE p.resolution END",
    "Percezione_soddisfazione_cliente": "CASE WHEN p.conv_id%(a.k+1)=0 THEN NULL ELSE p.satisfaction END",
    "Tono_conversazione_cliente": "CASE WHEN p.client_tone='Neutrale' THEN 'Informale' ELSE p.client_tone END",
    "Tono_conversazione_operatore": "CASE WHEN p.conv_id%(a.k+3)=0 THEN 'Formale' ELSE p.operator_tone END",
    "Livello_linguistico_cliente": "CASE WHEN p.conv_id%(a.k+4)=0 THEN 'Alto' ELSE p.language_level END",
    "Emozione_prevalente_cliente": "concat('Emozione primaria: ', CASE WHEN p.conv_id%a.k=1 THEN 'Sorpresa' ELSE p.emotion END, '; secondaria: NA;')",
    "Emozione_prevalente_operatore": "CASE WHEN p.conv_id%(a.k+1)=2 THEN 'nessuna' ELSE concat('Emozione primaria: ', p.operator_emotion, '; secondaria: NA;') END",
    "Livello_linguistico_operatore": "'Alto'",
}

#: Columns that an annotator's file lacks.
LACKING = {"A2": ("operator_tone",), "A3": ("language_level", "client_emotions")}

#: Consecutive events that the model is asked about at once, and what is read out of such blocks.
BLOCK_EVENTS = 3
BLOCK_FEATURES = (
    Feature("resolution", CLOSED),
    Feature("language_level", CLOSED),
    Feature("emotion", CLOSED_LIST),
    Feature("topic", OPEN_LIST),
    Feature("summary", TEXT),
)

FEATURES = (
    Feature("resolution", CLOSED, ("Solved", "Unsolved", "Unsolvable")),
    Feature(
        "satisfaction", CLOSED, ("Very unhappy", "Unhappy", "Neutral", "Happy", "Very happy")
    ),
    Feature(
        "client_tone",
        CLOSED,
        ("Neutral", "Emotional", "Ironic", "Sarcastic"),
        ("tone.client", "client_tone_variant"),
    ),
    Feature("operator_tone", CLOSED, ("Neutral", "Emotional", "Ironic", "Sarcastic")),
    Feature("language_level", CLOSED, ("Low", "Medium", "High")),
    Feature(
        "client_emotions",
        CLOSED_LIST,
        ("Joy", "Anger", "Surprise", "Sadness", "Neutrality", "Fear"),
        ("emotions",),
    ),
    Feature(
        "operator_emotions",
        CLOSED_LIST,
        ("Joy", "Anger", "Surprise", "Sadness", "Neutrality", "Fear"),
    ),
    Feature("topics", OPEN_LIST),
    Feature("summary", TEXT),
)
SCALARS = tuple(f.name for f in FEATURES if f.kind == CLOSED)
COMPARED = (*SCALARS, "client_emotions", "operator_emotions")

TOPIC_RULES = (
    ("Bonus", "bonus"),
    ("Registration", "registr"),
    ("Operator", "operator"),
    ("Withdrawals", "withdraw"),
    ("Account", "account"),
    ("Top-up", "top-up"),
    ("Responsible Gaming", "responsible gam"),
)
OTHER_TOPIC = "Other"

LEXICON = {
    "resolution": (("Solved", "thanks|then"), ("Unsolved", "error|was")),
    "client_tone": (("Emotional", "!"), ("Ironic", "oure"), ("Neutral", "the")),
    "language_level": (("High", "tionthe"), ("Low", "ndnd")),
    "satisfaction": (("Very happy", "ingthe"), ("Unhappy", "erer"), ("Neutral", "an")),
    "operator_tone": (("Polite", "thand"), ("Neutral", "agent")),
    "client_emotions": (("Irony", "onon"), ("Joy", "ha"), ("Fear", "k")),
    "operator_emotions": (("Neutrality", "agent"),),
    "topics": (("Welcome bonus", "ea"), ("Account closure", "k")),
    "summary": (("Much was said", "er.*er.*er"), ("Little was said", "e")),
}

TONE_MAP = {"Formal": "Neutral", "Informal": "Neutral"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def _computed_once(df: DataFrame) -> DataFrame:
    """The same rows; passing through explode, long expressions are not pasted into every use of their columns."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("m")).select("m.*")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw event log with corrupt rows, missing ids and exact copies."""
    conversations = table(spark, sf_dir, "conversations").alias("c")
    events = table(spark, sf_dir, "events").alias("e")
    turns = events.join(conversations, F.expr(f"e.event_id = {KEY}"), "left")
    rows = _select(_select(turns, TURN_COLUMNS).alias("c"), RAW_COLUMNS)
    # The third event of every conversation comes twice.
    copies = F.when(F.col("EVENT_ID") == "3", F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return rows.withColumn("copy", F.explode(copies)).drop("copy")


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned event log."""
    return clean_chat(raw_log(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, pages and conversations, the latter with sensitive data added."""
    turns = _select(table(spark, sf_dir, "conversations").alias("c"), MESSAGE_COLUMNS)
    # Passing through explode, the long text expression is not pasted into every regex test.
    turns = turns.withColumn("MSGTEXT", F.explode(F.array("MSGTEXT")))
    parts = [
        _select(table(spark, sf_dir, "documents"), DOCUMENT_COLUMNS),
        _select(table(spark, sf_dir, "pages"), PAGE_COLUMNS),
        turns,
    ]
    return reduce(DataFrame.unionByName, parts)


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as an event, sensitive data redacted."""
    columns = {**DIALOGUE_COLUMNS, "MSGTEXT": MESSAGE_COLUMNS["MSGTEXT"]}
    turns = _select(table(spark, sf_dir, "conversations").alias("c"), columns)
    return pii_redact(turns.withColumn("MSGTEXT", F.explode(F.array("MSGTEXT"))))


def read_by_model(docs: DataFrame) -> DataFrame:
    """Documents with what the word-list model reads in them, by way of its JSON responses."""
    parsed = parse_responses(annotate_with_lexicon(docs, MODEL_LEXICON))
    return flatten_features(parsed, [Feature(name, TEXT) for name in MODEL_LEXICON], other=None).drop("response")


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model reads in each conversation."""
    docs = conversation_json(assemble_conversations(dialogues(spark, sf_dir)))
    return _computed_once(read_by_model(docs).withColumn("conv_id", F.col("INTERACTION_ID").cast("bigint")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model features, one row per conversation, with lists as text."""
    return _select(picks(spark, sf_dir), PREDICTION_COLUMNS)


def parsed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model features with the twin of the client tone merged and lists as arrays."""
    merged = coalesce_variant_columns(
        predictions(spark, sf_dir), {"client_tone": "client_tone_variant"}
    )
    return parse_list_text(
        merged, ("client_emotions", "operator_emotions", "topics"), keep_blanks=("topics",)
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four annotators' view of every conversation, in long form."""
    annotators = F.array(
        *[F.struct(F.lit(a).alias("annotator"), F.lit(k).alias("k")) for a, k in ANNOTATORS]
    )
    df = predictions(spark, sf_dir).withColumn("a", F.explode(annotators)).alias("p")
    return _select(df, ANNOTATION_COLUMNS)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses: errors, empty and missing ones, objects and cut-off JSON."""
    return _computed_once(_select(predictions(spark, sf_dir), RESPONSE_COLUMNS))


def italian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model read, in the words of the default scheme."""
    return _computed_once(_select(picks(spark, sf_dir), ITALIAN_COLUMNS))


def italian_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features under the default scheme, by way of responses that name them in three manners."""
    answered = _computed_once(_select(italian(spark, sf_dir), ITALIAN_RESPONSE_COLUMNS))
    return flatten_features(parse_responses(answered), DEFAULT_FEATURES)


def italian_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four annotators' files under the names they use, written as CSV and read as one table."""
    rows = italian(spark, sf_dir).alias("p")
    paths = {}
    for name, k in ANNOTATORS:
        paths[name] = scratch_path(spark, f"annotations-{name}")
        own = rows.crossJoin(F.broadcast(spark.createDataFrame([(k,)], "k int")).alias("a"))
        write_table(_select(own, ITALIAN_ANNOTATION_COLUMNS), paths[name], fmt="csv", sep=";")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ITALIAN_ANNOTATION_COLUMNS])
    return read_annotations(spark, paths, schema)


def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotators' files with different columns, or the same in another order, read as one long table."""
    rows = annotations(spark, sf_dir).cache()
    paths, schemas = {}, {}
    for k, (name, _) in enumerate(ANNOTATORS):
        columns = [c for c in ANNOTATION_COLUMNS if c not in ("annotator", *LACKING.get(name, ()))]
        columns = columns[:1] + columns[1:][:: -1 if k % 2 else 1]
        paths[name] = scratch_path(spark, f"annotations-{name}")
        write_table(rows.where(F.col("annotator") == name).select(columns), paths[name], fmt="csv", sep=";")
        schemas[name] = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows.unpersist()
    return read_annotations(spark, paths, schemas)


def log_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The raw log as CSV files: the seventh events lack their last fields, the ninth ones have fields to spare."""
    raw = raw_log(spark, sf_dir)
    event = F.col("EVENT_ID")
    parts = {
        "whole": raw.where(~event.isin("7", "9")),
        "short": raw.where(event == "7").select(*raw.columns[:10]),
        "wide": raw.where(event == "9").withColumns({"EXTRA1": F.lit("x"), "EXTRA2": F.lit("y")}),
    }
    paths = {name: scratch_path(spark, f"log-{name}") for name in parts}
    for name, part in parts.items():
        write_table(part, paths[name], fmt="csv", sep=";")
    return list(paths.values())


def dialogue_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in blocks of events, each answered by the model."""
    docs = assemble_conversations(dialogues(spark, sf_dir), block_events=BLOCK_EVENTS)
    return annotate_with_lexicon(conversation_json(docs), {f.name: MODEL_LEXICON[f.name] for f in BLOCK_FEATURES})
