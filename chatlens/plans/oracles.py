"""The registered queries as DuckDB SQL, written independently of the operators.

Only the expressions that derive the chat tables from the test tables, and the fixed regexes and
vocabularies, are shared with the Spark side.
"""

from chatlens.functions import patterns as P
from chatlens.functions.features import CLOSED, CLOSED_LIST, DEFAULT_FEATURES, DEFAULT_TOPIC_RULES
from chatlens.plans import adapters as A
from chatlens.plans.catalog import LISTED_IDS, PROMPT, SAMPLE_SIZE
from chatlens.schema import CHAT_COLUMNS, RAW_CHAT_COLUMNS

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def as_json(array: str) -> str:
    """A list as JSON text; null for null."""
    return f"CASE WHEN {array} IS NOT NULL THEN CAST(to_json({array}) AS VARCHAR) END"


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


HUMAN_AGENT = "(USERTYPE='AGENT' AND USERNICK <> 'Live Chat')"
HUMAN = f"(USERTYPE='CLIENT' OR {HUMAN_AGENT})"
SYSTEM = "(USERTYPE='EXTERNAL' OR USERNICK = 'Live Chat')"
GOOD = "(INTERACTION_ID IS NOT NULL AND USER_ID IS NOT NULL AND try_cast(DATE_TIME AS date) IS NOT NULL)"
FILLED = ("PERSON_ID", "USERNICK", "USERTYPE", "PROTOCOLTYPE", "CLIENTVERSION")
CHAT_EXPRESSIONS = {
    "DATE_TIME": "try_cast(DATE_TIME AS timestamp)",
    "DATE": "try_cast(DATE_TIME AS date)",
    "TIME": "substring(DATE_TIME,12,8)",
    "TIMESHIFT": "try_cast(TIMESHIFT AS int)",
    "EVENT_ID": "try_cast(EVENT_ID AS int)",
    **{c: f"first_value({c}) OVER w" for c in FILLED},
}
FIXED_TONE = "CASE WHEN client_tone IN ('nan','NaN') THEN client_tone_variant ELSE client_tone END"


def _list(column: str, noise: str) -> str:
    return f"string_split(regexp_replace({column}, {lit(noise)}, '', 'g'), ',')"


VIEWS = {
    "raw0": f"SELECT {_columns(A.RAW_COLUMNS)} FROM (SELECT {_columns(A.TURN_COLUMNS)} FROM events e"
    f" LEFT JOIN conversations c ON e.event_id={A.KEY}) c",
    "raw": "SELECT * FROM raw0 UNION ALL SELECT * FROM raw0 WHERE EVENT_ID='3'",
    "good": f"SELECT DISTINCT * FROM raw WHERE {GOOD}",
    "chat": "SELECT "
    + ", ".join(f"{CHAT_EXPRESSIONS.get(c, c)} AS {c}" for c in CHAT_COLUMNS)
    + " FROM good WINDOW w AS (PARTITION BY USER_ID ORDER BY try_cast(EVENT_ID AS int) NULLS FIRST, INTERACTION_ID, DATE_TIME)",
    "messages": f"SELECT {_columns(A.DOCUMENT_COLUMNS)} FROM documents"
    f" UNION ALL SELECT {_columns(A.PAGE_COLUMNS)} FROM pages"
    f" UNION ALL SELECT {_columns(A.MESSAGE_COLUMNS)} FROM conversations c",
    "predictions": f"SELECT {_columns(A.PREDICTION_COLUMNS)} FROM picks",
    "parsed": f"SELECT * EXCLUDE (client_tone_variant) REPLACE ({FIXED_TONE} AS client_tone,"
    f" {_list('client_emotions', '[[:space:]' + chr(39) + '\\[\\]]')} AS client_emotions,"
    f" {_list('operator_emotions', '[[:space:]' + chr(39) + '\\[\\]]')} AS operator_emotions,"
    f" {_list('topics', '[' + chr(39) + '\\[\\]]')} AS topics) FROM predictions",
    "annotations": f"SELECT {_columns(A.ANNOTATION_COLUMNS)} FROM predictions p CROSS JOIN (VALUES "
    + ", ".join(f"('{a}', {k})" for a, k in A.ANNOTATORS)
    + ") a(annotator, k)",
    "responses": f"SELECT {_columns(A.RESPONSE_COLUMNS)} FROM predictions",
}
NEEDS = {
    "raw": ("raw0",),
    "good": ("raw0", "raw"),
    "chat": ("raw0", "raw", "good"),
    "dialogue_docs": ("dialogues",),
    "picks": ("dialogues", "dialogue_docs"),
    "predictions": ("dialogues", "dialogue_docs", "picks"),
    "parsed": ("dialogues", "dialogue_docs", "picks", "predictions"),
    "annotations": ("dialogues", "dialogue_docs", "picks", "predictions"),
    "responses": ("dialogues", "dialogue_docs", "picks", "predictions"),
}


def _register(base: str, extra: dict[str, str] | None = None, **selects: str) -> None:
    names = (*NEEDS.get(base, ()), base)
    views = {**{n: VIEWS[n] for n in names}, **(extra or {})}
    prefix = "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in views.items())
    for name, select in selects.items():
        ORACLES[name] = f"{prefix}\n{select}"


# Cleaning

CHAT_AS_TEXT = (
    "* REPLACE (strftime(DATE_TIME, '%Y-%m-%d %H:%M:%S') AS DATE_TIME, CAST(DATE AS VARCHAR) AS DATE,"
    " CAST(TIMESHIFT AS BIGINT) AS TIMESHIFT, CAST(EVENT_ID AS BIGINT) AS EVENT_ID)"
)


def _profile(columns, texts) -> str:
    tests = {
        c: f"{c} IS NULL OR {c} = '' OR contains({c}, 'None') OR contains({c}, 'NULL')"
        if c in texts
        else f"{c} IS NULL"
        for c in columns
    }
    return ", ".join(f"count(*) FILTER (WHERE {t}) AS {c}" for c, t in tests.items())


CLEAN_TEXTS = set(CHAT_COLUMNS) - {"DATE_TIME", "DATE", "TIMESHIFT", "EVENT_ID"}
ALL_RAW = ", ".join(RAW_CHAT_COLUMNS)
_register(
    "raw",
    null_profile=f"SELECT {_profile(RAW_CHAT_COLUMNS, RAW_CHAT_COLUMNS)} FROM raw",
    find_error_rows="SELECT * FROM raw WHERE INTERACTION_ID IS NULL OR USER_ID IS NULL OR try_cast(DATE_TIME AS date) IS NULL",
    remove_error_rows="SELECT * FROM raw EXCEPT SELECT * FROM raw WHERE INTERACTION_ID IS NULL OR USER_ID IS NULL OR try_cast(DATE_TIME AS date) IS NULL",
    normalise_time="SELECT * REPLACE (strftime(try_cast(DATE_TIME AS timestamp), '%Y-%m-%d %H:%M:%S') AS DATE_TIME),"
    " CAST(try_cast(DATE_TIME AS date) AS VARCHAR) AS DATE, substring(DATE_TIME,12,8) AS TIME FROM raw",
    cast_event_columns="SELECT * REPLACE (try_cast(TIMESHIFT AS BIGINT) AS TIMESHIFT, try_cast(EVENT_ID AS BIGINT) AS EVENT_ID) FROM raw",
)
_register(
    "raw",
    rename_positional="SELECT INTERACTION_ID AS a, EVENT_ID AS b FROM raw",
    drop_and_rename_columns='SELECT INTERACTION_ID AS conversation, EVENT_ID FROM raw',
    view_in_sql="SELECT VISIBILITY, count(*) AS n FROM raw GROUP BY VISIBILITY",
)
_register(
    "chat",
    cleaning_report="SELECT total_rows, error_rows, total_rows - error_rows - remaining_rows AS duplicate_rows,"
    " remaining_rows, human_rows, system_rows FROM"
    f" (SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT {GOOD}) AS error_rows FROM raw),"
    f" (SELECT count(*) AS remaining_rows, count(*) FILTER (WHERE {HUMAN}) AS human_rows,"
    f" count(*) FILTER (WHERE {SYSTEM}) AS system_rows FROM chat)",
    fill_user_attributes="SELECT "
    + ", ".join(f"first_value({c}) OVER w AS {c}" if c in FILLED else c for c in RAW_CHAT_COLUMNS)
    + " FROM good WINDOW w AS (PARTITION BY USER_ID ORDER BY try_cast(EVENT_ID AS int) NULLS FIRST, INTERACTION_ID, DATE_TIME)",
    fill_user_attributes_not_null="SELECT g.* REPLACE (f.m AS MSGTEXT, f.r AS REASON) FROM good g JOIN"
    " (SELECT USER_ID, arg_min(MSGTEXT, concat(lpad(EVENT_ID, 9, '0'), INTERACTION_ID)) FILTER (WHERE MSGTEXT IS NOT NULL) AS m,"
    " arg_min(REASON, concat(lpad(EVENT_ID, 9, '0'), INTERACTION_ID)) FILTER (WHERE REASON IS NOT NULL) AS r FROM good GROUP BY USER_ID) f"
    " ON f.USER_ID = g.USER_ID",
    clean_chat=f"SELECT {CHAT_AS_TEXT} FROM chat",
    null_profile_cleaned=f"SELECT {_profile(CHAT_COLUMNS, CLEAN_TEXTS)} FROM chat",
    split_human_messages=f"SELECT {CHAT_AS_TEXT} FROM chat WHERE {HUMAN}",
    split_system_messages=f"SELECT {CHAT_AS_TEXT} FROM chat WHERE {SYSTEM}",
    event_time=f"SELECT {CHAT_AS_TEXT} FROM (SELECT * REPLACE (DATE_TIME + to_seconds(TIMESHIFT) AS DATE_TIME) FROM chat)",
    sample_by_ids="SELECT INTERACTION_ID, CAST(EVENT_ID AS BIGINT) AS EVENT_ID, USERNICK, USERTYPE, MSGTEXT FROM chat"
    " WHERE INTERACTION_ID IN ('0000000000000003','0000000000000005','0000000000000008','0000000000000013')",
    sample_top_conversations=f"SELECT {CHAT_AS_TEXT} FROM chat WHERE INTERACTION_ID IN (SELECT INTERACTION_ID FROM chat"
    f" GROUP BY INTERACTION_ID ORDER BY count(*) DESC, INTERACTION_ID LIMIT {SAMPLE_SIZE})",
)

# Statistics

DURATION = "(max(TIMESHIFT)-min(TIMESHIFT))"
TOKENS = r"coalesce(len(regexp_extract_all(MSGTEXT, '\S+')), 0)"


def _histogram(values: str, column: str) -> str:
    return (
        f"SELECT b.bin, round(lo + (b.bin-1)*((40.0::DOUBLE-lo)/50), 6) AS bin_start, count(v.x) AS conversations FROM"
        f" (SELECT range AS bin FROM range(1, 51)) b CROSS JOIN (SELECT min({column})::DOUBLE AS lo FROM ({values})) m"
        f" LEFT JOIN (SELECT {column}::DOUBLE AS x, (SELECT min({column})::DOUBLE FROM ({values})) AS l FROM ({values}) WHERE {column} <= 40) v"
        f" ON b.bin = least(50, floor(50*(v.x - v.l)/(40.0::DOUBLE - v.l)) + 1) GROUP BY b.bin, lo"
    )


DURATIONS = f"SELECT INTERACTION_ID, round({DURATION}/60.0::DOUBLE, 2) AS CHAT_DURATION FROM chat GROUP BY INTERACTION_ID"
COUNTS = "SELECT INTERACTION_ID, count(*) AS CHAT_MESS FROM chat GROUP BY INTERACTION_ID"
SECONDS = f"SELECT INTERACTION_ID, {DURATION} AS s FROM chat GROUP BY INTERACTION_ID"
_register(
    "chat",
    corpus_summary="SELECT count(*) AS total_rows, count(DISTINCT INTERACTION_ID) AS conversations,"
    " (SELECT round(avg(n), 2) FROM (SELECT count(DISTINCT INTERACTION_ID) AS n FROM chat GROUP BY DATE)) AS avg_conversations_per_day,"
    f" count(DISTINCT USERTYPE) AS user_types, count(*) FILTER (WHERE {HUMAN}) AS human_messages,"
    f" count(*) FILTER (WHERE {SYSTEM}) AS system_messages, count(*) FILTER (WHERE MSGTEXT IS NULL) AS null_messages FROM chat",
    messages_by_role=f"SELECT count(*) FILTER (WHERE USERTYPE='CLIENT') AS client, count(*) FILTER (WHERE {HUMAN_AGENT}) AS human_agent,"
    " count(*) FILTER (WHERE USERTYPE='AGENT') AS agent, count(*) FILTER (WHERE USERNICK='Live Chat') AS bot,"
    " count(*) FILTER (WHERE USERTYPE='EXTERNAL') AS external FROM chat",
    messages_by_usertype="SELECT USERTYPE, count(*) AS messages FROM chat GROUP BY USERTYPE",
    null_messages="SELECT count(*) AS null_messages, count(REASON) AS null_messages_with_reason FROM chat WHERE MSGTEXT IS NULL",
    chats_without_human="SELECT count(DISTINCT INTERACTION_ID) AS chats_without_human FROM chat WHERE INTERACTION_ID NOT IN"
    f" (SELECT INTERACTION_ID FROM chat WHERE {HUMAN_AGENT})",
    off_hours_chats="SELECT count(DISTINCT INTERACTION_ID) AS off_hours_chats FROM chat WHERE hour(DATE_TIME) < 9 OR hour(DATE_TIME) > 22",
    chat_durations=DURATIONS,
    duration_summary="SELECT round(avg(s/60.0::DOUBLE), 2) AS avg_minutes, round(max(s)/60.0::DOUBLE, 2) AS max_minutes,"
    " round(min(s)/60.0::DOUBLE, 2) AS min_minutes, sum(s)::DOUBLE/(count(s)*60) AS avg_minutes_unrounded"
    f" FROM ({SECONDS})",
    duration_ranked=f"{DURATIONS} ORDER BY CHAT_DURATION DESC",
    duration_stddev=f"SELECT round(stddev_samp(CHAT_DURATION), 6) AS stddev_minutes FROM ({DURATIONS})",
    longest_conversation=f"SELECT {CHAT_AS_TEXT} FROM chat WHERE INTERACTION_ID ="
    f" (SELECT INTERACTION_ID FROM ({SECONDS}) ORDER BY s DESC, INTERACTION_ID LIMIT 1)",
    duration_histogram=_histogram(DURATIONS, "CHAT_DURATION"),
    chat_message_counts=COUNTS,
    message_count_summary=f"SELECT round(avg(CHAT_MESS), 2) AS avg_messages, max(CHAT_MESS) AS max_messages, min(CHAT_MESS) AS min_messages FROM ({COUNTS})",
    message_count_ranked=f"{COUNTS} ORDER BY CHAT_MESS DESC",
    message_count_stddev=f"SELECT round(stddev_samp(CHAT_MESS), 6) AS stddev_messages FROM ({COUNTS})",
    message_count_histogram=_histogram(COUNTS, "CHAT_MESS"),
    modal_message_count=f"SELECT CHAT_MESS, count(*) AS occurrence_count FROM ({COUNTS}) GROUP BY CHAT_MESS ORDER BY 2 DESC, 1 LIMIT 1",
    token_counts=f"SELECT INTERACTION_ID, CAST(EVENT_ID AS BIGINT) AS EVENT_ID, CAST({TOKENS} AS BIGINT) AS token_count FROM chat",
    token_summary="SELECT CAST(sum(t) AS BIGINT) AS total_tokens, round(avg(t), 2) AS avg_tokens_per_chat,"
    " CAST(sum(h) AS BIGINT) AS human_tokens, round(avg(h), 2) AS avg_human_tokens_per_chat FROM"
    f" (SELECT sum({TOKENS}) AS t, sum({TOKENS}) FILTER (WHERE {HUMAN}) AS h FROM chat GROUP BY INTERACTION_ID)",
    returning_clients='SELECT USERNICK, count(DISTINCT INTERACTION_ID) AS "NumberOfConversations" FROM chat'
    " WHERE USERTYPE='CLIENT' GROUP BY USERNICK HAVING count(DISTINCT INTERACTION_ID) > 1",
    client_return_summary="SELECT (SELECT count(*) FROM (SELECT USERNICK FROM chat WHERE USERTYPE='CLIENT' GROUP BY USERNICK"
    " HAVING count(DISTINCT INTERACTION_ID) > 1)) AS returning_clients, count(DISTINCT USERNICK) AS distinct_clients FROM chat WHERE USERTYPE='CLIENT'",
    messages_per_month="SELECT CAST(month(DATE_TIME) AS BIGINT) AS month, count(DISTINCT DATE_TIME) AS distinct_timestamps, count(*) AS messages FROM chat GROUP BY 1",
    active_hours="SELECT DISTINCT CAST(hour(DATE_TIME) AS BIGINT) AS hour FROM chat",
    timestamps_in_hour="SELECT DISTINCT CAST(hour(DATE_TIME) AS BIGINT) AS hour, strftime(DATE_TIME, '%Y-%m-%d %H:%M:%S') AS DATE_TIME FROM chat WHERE hour(DATE_TIME) = 12",
    interactions_per_hour="SELECT CAST(hour(DATE_TIME) AS BIGINT) AS hour_of_day, count(DISTINCT INTERACTION_ID) AS interaction_count FROM chat GROUP BY 1",
)

# Sensitive data. RE2 has no lookahead; the IBAN regex is spelt out by what may follow its four groups.

IBAN_BODY = r"\b[A-Za-z]{2}[0-9]{2}(?: ?[0-9]{4}){4}"
NO_DIGIT = r"(?:$|[^0-9 ]| (?:$|[^0-9]))"
WORD_END = r"(?:$|[^\w ]| (?:$|[^0-9]))"
IBAN_TAILS = (
    rf" ?[0-9][0-9]({WORD_END})",
    rf" ?[0-9]( [0-9]{NO_DIGIT})",
    rf"( [0-9] ?[0-9]{NO_DIGIT})",
    rf" ?[0-9]({WORD_END})",
    rf"( [0-9]{NO_DIGIT})",
    rf"({WORD_END})",
)
IBAN_RE2 = f"{IBAN_BODY}(?:{'|'.join(IBAN_TAILS)})"
REGEX = {
    **{p.name: p.regex for p in P.DEFAULT_PATTERNS},
    "IBAN": IBAN_RE2,
    "EMAIL": r"\b[\w\-\.]+@([\w-]+\.)+[\w-]{2,}\b",
    "LINK": r"(http|ftp|https):\/\/([\w_-]+(?:(?:\.[\w_-]+)+))([\w.,@?^=%&:\/~+#-]*[\w@?^=%&\/~+#-])",
}
LABEL = {p.name: p.label for p in P.DEFAULT_PATTERNS}


def _has(name: str, text: str = "MSGTEXT") -> str:
    return f"regexp_matches({text}, {lit(REGEX[name])})"


def _replaced(name: str, text: str = "MSGTEXT") -> str:
    label = LABEL[name] + (r"\1\2\3\4\5\6" if name == "IBAN" else "")
    return f"regexp_replace({text}, {lit(REGEX[name])}, {lit(label)}, 'g')"


def _case(order, result, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(n)} THEN {result(n)}" for n in order) + f" ELSE {default} END"


REDACTED = "MSGTEXT"
for _name in REGEX:
    REDACTED = _replaced(_name, REDACTED)
PII_LABEL = _case(P.LABEL_PRECEDENCE, lambda n: lit(LABEL[n]), "'False'")
ANY_CARD = "(" + " OR ".join(_has(n) for n in P.CARDS) + ")"
ANY_KIND = "(" + " OR ".join(_has(n) for n in REGEX if n != "LINK") + ")"
_register(
    "messages",
    pii_flags="SELECT source, message_id, " + ", ".join(f"{_has(n)} AS {n}" for n in REGEX) + " FROM messages",
    pii_filter=f"SELECT * FROM messages WHERE {_has('PHONE_NUMBER')}",
    pii_counts=f"SELECT count(*) FILTER (WHERE {ANY_KIND}) AS any_sensitive, count(*) FILTER (WHERE {ANY_CARD}) AS credit_card, "
    + ", ".join(
        f"count(*) FILTER (WHERE {_has(n)}) AS {n.lower()}" for n in REGEX if n not in P.CARDS
    )
    + " FROM messages",
    pii_replace_message=f"SELECT source, message_id, {_case(P.WHOLE_MESSAGE_PRECEDENCE, lambda n: lit(LABEL[n]), 'MSGTEXT')} AS AN_MSGTEXT FROM messages",
    pii_label=f'SELECT source, message_id, {PII_LABEL} AS "Pattern" FROM messages',
    pii_redact=f"SELECT source, message_id, {REDACTED} AS AN_MSGTEXT FROM messages",
    pii_redact_first_category=f"SELECT source, message_id, {_case(P.FIRST_KIND_PRECEDENCE, _replaced, 'MSGTEXT')} AS AN_MSGTEXT FROM messages",
    pii_label_from_redacted="SELECT source, message_id, CASE "
    + " ".join(f"WHEN contains(t, {lit(l)}) THEN {lit(c)}" for l, c in P.REDACTED_CATEGORIES)
    + f" ELSE 'False' END AS \"Pattern\" FROM (SELECT *, {REDACTED} AS t FROM messages)",
    pii_label_counts=f'SELECT {PII_LABEL} AS "Pattern", count(*) AS count FROM messages GROUP BY 1',
    pii_pairs=f'SELECT * FROM (SELECT {REDACTED} AS AN_MSGTEXT, MSGTEXT, {PII_LABEL} AS "Pattern" FROM messages) WHERE "Pattern" <> \'False\'',
)

# Conversations and responses

def _documents(source: str, *keys: str) -> str:
    """Messages of each conversation as JSON text."""
    key = ", ".join(keys)
    return (
        f"SELECT {key}, count(*) AS messages, CAST(to_json(list("
        "{'USERNICK': USERNICK, 'USERTYPE': USERTYPE, 'AN_MSGTEXT': t} ORDER BY EVENT_ID, USERNICK, USERTYPE, t)) AS VARCHAR) AS json_string"
        f" FROM (SELECT *, {REDACTED} AS t FROM {source}) GROUP BY {key}"
    )


DOCS = {"docs": _documents("chat", "INTERACTION_ID")}


def _lexicon(feature: str, lexicon=A.LEXICON) -> str:
    rules = lexicon[feature]
    return (
        "CASE "
        + " ".join(f"WHEN regexp_matches(json_string, {lit('(?i)' + r)}) THEN {lit(v)}" for v, r in rules)
        + " ELSE 'NA' END"
    )


def _read_by_model(docs: str, *keys: str) -> str:
    """What the model reads in each document."""
    found = ", ".join(f"{_lexicon(f, A.MODEL_LEXICON)} AS {f}" for f in A.MODEL_LEXICON)
    return f"SELECT {', '.join(keys)}, {found} FROM {docs}"


VIEWS["dialogues"] = (
    f"SELECT {_columns(A.DIALOGUE_COLUMNS)}, {A.MESSAGE_COLUMNS['MSGTEXT']} AS MSGTEXT FROM conversations c"
)
VIEWS["dialogue_docs"] = _documents("dialogues", "INTERACTION_ID")
VIEWS["picks"] = _read_by_model("dialogue_docs", "CAST(INTERACTION_ID AS BIGINT) AS conv_id")
LEXICON_JSON = (
    "concat('{', "
    + ", ',', ".join(f"""'"{f}":"', {_lexicon(f)}, '"'""" for f in A.LEXICON)
    + ", '}')"
)
_register(
    "chat",
    DOCS,
    assemble_conversations="SELECT * FROM docs",
    conversation_json="SELECT INTERACTION_ID, json_string FROM docs",
    render_prompt=f"SELECT INTERACTION_ID, concat({lit(PROMPT.replace('{class_list}', 'Bonus, Account'))}, json_string) AS prompt FROM docs",
    annotate=f"SELECT INTERACTION_ID, {LEXICON_JSON} AS response FROM docs",
    annotate_with_lexicon=f"SELECT INTERACTION_ID, {LEXICON_JSON} AS response FROM docs",
    annotate_parse_flatten="SELECT INTERACTION_ID, true AS success, "
    + ", ".join(
        (f"""concat('["', {_lexicon(f.name)}, '"]')""" if f.is_list else _lexicon(f.name))
        + f" AS {f.name}"
        for f in A.FEATURES
    )
    + ", NULL::VARCHAR AS other_keys FROM docs",
)
# Which kind of response a row has follows from its number; repeated keys and NaN are made plain JSON.
NUMBERED = {
    "numbered": "SELECT INTERACTION_ID, response, n, CASE WHEN n % 8 BETWEEN 3 AND 6 THEN CAST(t AS JSON) END AS j FROM (SELECT *,"
    """ replace(replace(response, 'NaN', '"NaN"'), ',"resolution"', ',"again"') AS t, CAST(INTERACTION_ID AS BIGINT) AS n FROM responses)"""
}
EMOTIONS = "CAST(j->'$.emotions' AS VARCHAR[])"
_register(
    "responses",
    NUMBERED,
    parse_responses="SELECT INTERACTION_ID, response, coalesce(n % 8 BETWEEN 3 AND 6, false) AS success FROM numbered",
    flatten_features="SELECT INTERACTION_ID, response, n % 8 BETWEEN 3 AND 6 AS success,"
    " CASE n % 8 WHEN 5 THEN j->>'$.again' ELSE j->>'$.resolution' END AS resolution, NULL::VARCHAR AS satisfaction,"
    " j->>'$.tone.client' AS client_tone, NULL::VARCHAR AS operator_tone, NULL::VARCHAR AS language_level,"
    f" {as_json(EMOTIONS)} AS client_emotions, NULL::VARCHAR AS operator_emotions, NULL::VARCHAR AS topics, NULL::VARCHAR AS summary,"
    """ CASE n % 8 WHEN 4 THEN '{"extra":1}' WHEN 6 THEN '{"tone.mood":"NaN"}' END AS other_keys FROM numbered""",
    flatten_struct=f"SELECT INTERACTION_ID, coalesce(j->>'$.again', j->>'$.resolution') AS resolution, j->>'$.tone.client' AS tone_client,"
    f" {as_json(EMOTIONS)} AS emotions, j->>'$.extra' AS extra FROM numbered",
)

# Agreement


def _main_emotion(column: str) -> str:
    return f"nullif(regexp_extract({column}, 'Emozione primaria: (.+?);', 1), '')"


def _tone(column: str) -> str:
    return f"CASE WHEN {column} IN ('Formal','Informal') THEN 'Neutral' ELSE {column} END"


PEOPLE = (
    f"SELECT * REPLACE ({_main_emotion('client_emotions')} AS client_emotions, {_main_emotion('operator_emotions')} AS operator_emotions,"
    f" {_tone('client_tone')} AS client_tone, {_tone('operator_tone')} AS operator_tone) FROM annotations"
)
# Item between the first two quotes.
FIRST_ITEM = "nullif(string_split({0}, chr(39))[2], '')"
MODEL = (
    f"SELECT * REPLACE ({FIRST_ITEM.format('client_emotions')} AS client_emotions,"
    f" {FIRST_ITEM.format('operator_emotions')} AS operator_emotions) FROM predictions"
)
COMPARED = {
    "people": PEOPLE,
    "model": MODEL,
    "compared": "SELECT h.annotator, m.INTERACTION_ID, "
    + ", ".join(f"coalesce(m.{f} <> h.{f}, false) AS {f}, m.{f} IS DISTINCT FROM h.{f} AS strict_{f}" for f in A.COMPARED)
    + " FROM model m JOIN people h ON m.INTERACTION_ID = h.INTERACTION_ID",
}
DIFFS = ", ".join(f"count(*) FILTER (WHERE {f}) AS diff_{f}" for f in A.COMPARED)
_register(
    "annotations",
    COMPARED,
    mismatch_counts=f"SELECT annotator, {DIFFS} FROM compared GROUP BY annotator",
    mismatch_counts_strict="SELECT annotator, "
    + ", ".join(f"count(*) FILTER (WHERE strict_{f}) AS diff_{f}" for f in A.COMPARED)
    + " FROM compared GROUP BY annotator",
    mismatch_with_average="SELECT annotator, "
    + ", ".join(f"diff_{f}::DOUBLE AS diff_{f}" for f in A.COMPARED)
    + f" FROM (SELECT annotator, {DIFFS} FROM compared GROUP BY annotator) UNION ALL SELECT 'average', "
    + ", ".join(f"avg(diff_{f})" for f in A.COMPARED)
    + f" FROM (SELECT annotator, {DIFFS} FROM compared GROUP BY annotator)",
    mismatch_fields="SELECT annotator, INTERACTION_ID, "
    + ", ".join(f"CASE WHEN {f} THEN annotator END AS {f}" for f in A.COMPARED)
    + " FROM compared",
    disagreement_sets="SELECT INTERACTION_ID, "
    + ", ".join(
        f"coalesce(CAST(to_json(list(annotator ORDER BY annotator) FILTER (WHERE {f})) AS VARCHAR), '[]') AS {f}"
        for f in A.COMPARED
    )
    + " FROM compared GROUP BY INTERACTION_ID",
    normalise_annotations="SELECT * FROM people",
)

# Insights

_register(
    "predictions",
    primary_emotion=f"SELECT INTERACTION_ID, {FIRST_ITEM.format('client_emotions')} AS client_emotions, {FIRST_ITEM.format('operator_emotions')} AS operator_emotions FROM predictions",
    align_columns='SELECT INTERACTION_ID, client_tone AS "Tono_cliente", operator_tone AS "Tono_operatore" FROM predictions',
    coalesce_variant_columns=f"SELECT INTERACTION_ID, {FIXED_TONE} AS client_tone FROM predictions",
    failed_annotations=f"SELECT INTERACTION_ID, success FROM predictions WHERE NOT success OR INTERACTION_ID IN {LISTED_IDS}",
    failed_annotation_count=f"SELECT count(*) AS failed FROM predictions WHERE NOT success OR INTERACTION_ID IN {LISTED_IDS}",
)


def _in(feature) -> str:
    return "(" + ", ".join(lit(v) for v in feature.allowed) + ")"


CLOSED_FEATURES = [f for f in A.FEATURES if f.kind == CLOSED]
INVENTED = " UNION ALL ".join(
    f"SELECT '{f.name}' AS feature, {f.name} AS value FROM parsed WHERE {f.name} NOT IN {_in(f)}"
    for f in CLOSED_FEATURES
)
EMOTION = next(f for f in A.FEATURES if f.name == "client_emotions")


def _generated(column: str) -> str:
    return f"list_filter({column}, lambda x: x NOT IN {_in(EMOTION)})"


def _classes(rules, other: str) -> str:
    return (
        "CASE "
        + " ".join(f"WHEN regexp_matches(topic, {lit('(?i)' + r)}) THEN {lit(n.lower())}" for n, r in rules)
        + f" ELSE {lit(other.lower())} END"
    )


TOPICS = "SELECT trim(unnest(topics)) AS topic FROM parsed"
CLASSIFIED = f"SELECT topic, count(*) AS n, {_classes(A.TOPIC_RULES, A.OTHER_TOPIC)} AS topic_class FROM ({TOPICS}) GROUP BY topic"
GENERATED_ITEMS = f"SELECT unnest({_generated('client_emotions')}) AS item FROM parsed"
ALL_NA = " AND ".join(f"{c} = 'NA'" for c in A.SCALARS)
_register(
    "parsed",
    parse_list_text="SELECT INTERACTION_ID, " + as_json("client_emotions") + " AS client_emotions, " + as_json("topics") + " AS topics FROM parsed",
    out_of_vocabulary_counts="SELECT "
    + ", ".join(f"count(*) FILTER (WHERE {f.name} NOT IN {_in(f)}) AS {f.name}" for f in CLOSED_FEATURES)
    + " FROM parsed",
    out_of_vocabulary_values=f"SELECT feature, value, count(*) AS rows FROM ({INVENTED}) GROUP BY feature, value",
    out_of_vocabulary_value_counts=f'SELECT feature, count(DISTINCT value) AS "values" FROM ({INVENTED}) GROUP BY feature',
    generated_list_items=f"SELECT INTERACTION_ID, {as_json(_generated('client_emotions'))} AS generated_client_emotions,"
    f" {as_json(_generated('operator_emotions'))} AS generated_operator_emotions FROM parsed",
    multi_valued_rows=f"SELECT INTERACTION_ID, {as_json('client_emotions')} AS client_emotions FROM parsed WHERE len(client_emotions) > 1",
    generated_item_counts=f"SELECT item, count(*) AS count FROM ({GENERATED_ITEMS}) GROUP BY item",
    generated_item_totals=f'SELECT count(*) AS total, count(DISTINCT item) AS "distinct" FROM ({GENERATED_ITEMS})',
    summary_length_stats="SELECT round(avg(length(summary)), 2) AS avg_length, max(length(summary)) AS max_length FROM parsed",
    list_size_stats="SELECT round(avg(len(client_emotions)), 2) AS avg_client_emotions, round(avg(len(operator_emotions)), 2) AS avg_operator_emotions, round(avg(len(topics)), 2) AS avg_topics FROM parsed",
    distinct_topic_sets="SELECT count(DISTINCT topics) AS distinct_topic_sets FROM parsed",
    topic_counts=f'SELECT count(*) AS total, count(DISTINCT topic) AS "distinct" FROM ({TOPICS})',
    classify_topics=CLASSIFIED,
    classify_topics_default=f"SELECT topic, count(*) AS n, {_classes(DEFAULT_TOPIC_RULES, 'Altro')} AS topic_class FROM ({TOPICS}) GROUP BY topic",
    topic_class_counts=f"SELECT topic_class, count(*) AS count FROM ({CLASSIFIED}) GROUP BY topic_class",
    topic_class_weights=f"SELECT topic_class, CAST(sum(n) AS BIGINT) AS count FROM ({CLASSIFIED}) GROUP BY topic_class",
    all_na_rows=f"SELECT INTERACTION_ID FROM parsed WHERE {ALL_NA}",
    all_na_count=f"SELECT count(*) AS all_na FROM parsed WHERE {ALL_NA}",
)

# Blocks of events, responses whose keys nobody declared

PART = f"CAST(floor((EVENT_ID-1)/{A.BLOCK_EVENTS}) AS INT) AS PART"
BLOCKS = {
    "numbered_parts": f"SELECT *, {PART} FROM dialogues",
    "parts": _documents("numbered_parts", "INTERACTION_ID", "PART"),
    "part_picks": _read_by_model("parts", "INTERACTION_ID", "PART"),
}


def _first_available(feature: str) -> str:
    return f"coalesce(arg_min({feature}, PART) FILTER (WHERE {feature} <> 'NA'), 'NA') AS {feature}"


def _united(feature: str) -> str:
    """A list's values in the order of the parts in which they first come."""
    return (
        f"(SELECT CAST(to_json(list(v ORDER BY p)) AS VARCHAR) FROM (SELECT {feature} AS v, min(PART) AS p FROM part_picks q"
        f" WHERE q.INTERACTION_ID = m.INTERACTION_ID GROUP BY {feature})) AS {feature}"
    )


_register(
    "dialogues",
    BLOCKS,
    merge_parts="SELECT INTERACTION_ID, true AS success, resolution, language_level, "
    + ", ".join(_united(f.name) for f in A.BLOCK_FEATURES if f.is_list)
    + ", summary FROM (SELECT INTERACTION_ID, "
    + ", ".join(_first_available(f.name) for f in A.BLOCK_FEATURES if not f.is_list)
    + " FROM part_picks GROUP BY INTERACTION_ID) m",
)
_register(
    "responses",
    NUMBERED,
    flatten_discovered=f"SELECT INTERACTION_ID, {as_json(EMOTIONS)} AS emotions, j->>'$.extra' AS extra,"
    " coalesce(j->>'$.again', j->>'$.resolution') AS resolution, j->>'$.tone.client' AS tone_client,"
    " j->>'$.tone.mood' AS tone_mood FROM numbered",
)

# The default scheme: rows as the responses were made from, without the detour by way of JSON.

ITALIAN = {
    "italian": f"SELECT {_columns(A.ITALIAN_COLUMNS)} FROM picks",
    "italian_rows": "SELECT INTERACTION_ID, conv_id, resolution AS Risoluzione_richiesta, satisfaction AS Soddisfazione_cliente,"
    " [emotion, second_emotion] AS Emozioni_cliente, [operator_emotion] AS Emozioni_operatore, client_tone AS Tono_cliente,"
    " operator_tone AS Tono_operatore, language_level AS Livello_linguistico_cliente, [topic] AS Argomento_conversazione,"
    " summary AS Riassunto_conversazione FROM italian",
    "italian_people": "SELECT annotator, INTERACTION_ID, Risoluzione_richiesta_cliente AS Risoluzione_richiesta,"
    " Percezione_soddisfazione_cliente AS Soddisfazione_cliente,"
    f" {_main_emotion('Emozione_prevalente_cliente')} AS Emozioni_cliente, {_main_emotion('Emozione_prevalente_operatore')} AS Emozioni_operatore,"
    " CASE WHEN Tono_conversazione_cliente IN ('Formale','Informale') THEN 'Neutrale' ELSE Tono_conversazione_cliente END AS Tono_cliente,"
    " CASE WHEN Tono_conversazione_operatore IN ('Formale','Informale') THEN 'Neutrale' ELSE Tono_conversazione_operatore END AS Tono_operatore,"
    f" Livello_linguistico_cliente FROM (SELECT a.annotator, {_columns(A.ITALIAN_ANNOTATION_COLUMNS)} FROM italian p CROSS JOIN (VALUES "
    + ", ".join(f"('{a}', {k})" for a, k in A.ANNOTATORS)
    + ") a(annotator, k))",
}
ITALIAN_SINGLE = [f for f in DEFAULT_FEATURES if f.kind == CLOSED]
ITALIAN_LISTS = [f for f in DEFAULT_FEATURES if f.is_list]
ITALIAN_COMPARED = [f.name for f in DEFAULT_FEATURES if f.kind in (CLOSED, CLOSED_LIST)]
ITALIAN_EMOTION = next(f for f in DEFAULT_FEATURES if f.name == "Emozioni_cliente")
ITALIAN["italian_compared"] = (
    "SELECT h.annotator, m.INTERACTION_ID, "
    + ", ".join(
        f"coalesce({f'm.{f}[1]' if f.startswith('Emozioni') else f'm.{f}'} <> h.{f}, false) AS {f}" for f in ITALIAN_COMPARED
    )
    + " FROM italian_rows m JOIN italian_people h ON m.INTERACTION_ID = h.INTERACTION_ID"
)
ITALIAN_DIFFS = ", ".join(f"count(*) FILTER (WHERE {f}) AS diff_{f}" for f in ITALIAN_COMPARED)
ITALIAN_COUNTS = f"SELECT annotator, {ITALIAN_DIFFS} FROM italian_compared GROUP BY annotator"
ITALIAN_LISTED = ", ".join(as_json(f.name) + f" AS {f.name}" for f in ITALIAN_LISTS)
_register(
    "picks",
    ITALIAN,
    italian_features=f"SELECT * EXCLUDE (conv_id) REPLACE ({ITALIAN_LISTED}), true AS success,"
    """ CASE WHEN conv_id%3=2 THEN concat('{"Nota":', conv_id, '}') END AS other_keys FROM italian_rows""",
    italian_out_of_vocabulary="SELECT feature, value, count(*) AS rows FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f.name}' AS feature, {f.name} AS value FROM italian_rows WHERE {f.name} NOT IN {_in(f)}" for f in ITALIAN_SINGLE
    )
    + ") GROUP BY feature, value",
    italian_generated_items=f"SELECT item, count(*) AS count FROM (SELECT unnest(Emozioni_cliente) AS item FROM italian_rows)"
    f" WHERE item NOT IN {_in(ITALIAN_EMOTION)} GROUP BY item",
    italian_topics=f"SELECT topic, count(*) AS n, {_classes(DEFAULT_TOPIC_RULES, 'Altro')} AS topic_class FROM italian GROUP BY topic",
    italian_list_sizes='SELECT round(avg(len(Emozioni_cliente)), 2) AS "avg_Emozioni_cliente",'
    ' round(avg(len(Argomento_conversazione)), 2) AS "avg_Argomento_conversazione" FROM italian_rows',
    italian_mismatch="SELECT annotator, "
    + ", ".join(f"diff_{f}::DOUBLE AS diff_{f}" for f in ITALIAN_COMPARED)
    + f" FROM ({ITALIAN_COUNTS}) UNION ALL SELECT 'average', "
    + ", ".join(f"avg(diff_{f})" for f in ITALIAN_COMPARED)
    + f" FROM ({ITALIAN_COUNTS})",
    italian_disagreement="SELECT INTERACTION_ID, "
    + ", ".join(
        f"coalesce(CAST(to_json(list(annotator ORDER BY annotator) FILTER (WHERE {f})) AS VARCHAR), '[]') AS {f}"
        for f in ITALIAN_COMPARED
    )
    + " FROM italian_compared GROUP BY INTERACTION_ID",
)

# Reading and writing

_register(
    "raw",
    read_chat_log="SELECT "
    + ", ".join(
        c if k < 10 else f"CASE WHEN EVENT_ID='7' THEN NULL ELSE {c} END AS {c}" for k, c in enumerate(RAW_CHAT_COLUMNS)
    )
    + ", EVENT_ID IN ('7','9') AS malformed FROM raw",
)
_register(
    "annotations",
    read_annotations="SELECT annotator, INTERACTION_ID, "
    + ", ".join(
        f"CASE WHEN annotator IN ({', '.join(lit(a) for a, cs in A.LACKING.items() if c in cs) or 'NULL'}) THEN NULL ELSE {c} END AS {c}"
        for c in A.ANNOTATION_COLUMNS
        if c not in ("annotator", "INTERACTION_ID")
    )
    + " FROM annotations",
)
_register("chat", write_table=f"SELECT {CHAT_AS_TEXT} FROM chat", write_table_sorted=f"SELECT {CHAT_AS_TEXT} FROM chat")
