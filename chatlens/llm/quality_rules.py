"""Quality rules: a table of thresholds compiled into Spark projections over built-in functions only.

Per text: words (runs of anything but ASCII white space), their code points, symbols, lines that repeat an earlier one,
words inside three-word windows that occur twice or more, stop words (as listed, in lower case). No shuffle, no user
function; a row is judged from itself alone, so key skew cannot matter.

Defined cases: a null text is empty; an empty text has no words, so every ratio is 0 and ``base_failed`` is true; repeated
rows are judged each; an empty table gives an empty result; other columns of the table are ignored.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.shared import texts_of

SYMBOLS = "[#*$%&|<>]"

STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du en est et la le les pour que qui sur un une "
    "auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "con del el las los no para por se su y"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a text whose denominator is 0 has ratio 0."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The thresholds of the registered query.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.05, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeat_word_ratio", "n_repeat_words", "n_words", None, 0.5),
)

METRICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
)


def metrics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and :data:`METRICS` (long), a row per row of ``docs``."""
    text = F.col("text")
    not_empty = lambda x: x != F.lit("")
    lined = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = texts_of(docs, id_column, text_column).select(
        "doc_id",
        F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), not_empty).alias("words"),
        lined.alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
    )
    # The columns used several times stand in a projection of their own, so none is worked out twice.
    words, keys = F.col("words"), F.col("keys")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    counted = split.select(
        "doc_id",
        "n_symbols",
        F.size(words).alias("n_words"),
        F.length(F.array_join(words, "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).alias("n_stop_words"),
        F.when(F.size(words) >= 3, windows)
        .otherwise(F.array().cast("array<bigint>"))
        .alias("keys"),
    )
    # Only texts that repeat a window sort their windows.
    keyed = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p")))
    repeats = F.size(F.array_distinct(keys)) < F.size(keys)
    ordered = counted.withColumn(
        "sorted", F.when(repeats, F.sort_array(keyed)).otherwise(F.slice(keyed, 1, 0))
    ).drop("keys")
    pairs = F.col("sorted")
    twice = F.filter(
        pairs,
        lambda x, i: (x["k"] == F.get(pairs, i + 1)["k"])
        | ((i > 0) & (x["k"] == F.get(pairs, F.greatest(i - 1, F.lit(0)))["k"])),
    )
    placed = ordered.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop(
        "sorted"
    )
    at = F.col("at")
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return placed.withColumn("n_repeat_words", covered).select(
        "doc_id", *[F.col(m).cast("long").alias(m) for m in METRICS]
    )


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """One boolean column per rule: whether the row of metrics keeps it."""
    out = {}
    for rule in rules:
        ratio = F.when(
            F.col(rule.denominator) > 0, F.col(rule.numerator) / F.col(rule.denominator)
        ).otherwise(F.lit(0.0))
        kept = F.lit(True)
        if rule.low is not None:
            kept = kept & (ratio >= rule.low)
        if rule.high is not None:
            kept = kept & (ratio <= rule.high)
        out[rule.name] = kept
    return out


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Metrics, ``base_failed``, ``kept`` and the names of the ``failed_rules``, a row per row of ``docs``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated windows.
    """
    kept = compile_rules(rules)
    failed_base = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent
    )
    passes = ~failed_base
    for column in kept.values():
        passes = passes & column
    failed = F.concat_ws(",", *[F.when(~c, F.lit(name)) for name, c in kept.items()])
    return metrics(docs, id_column, text_column).select(
        "doc_id",
        *METRICS,
        failed_base.alias("base_failed"),
        passes.alias("kept"),
        failed.alias("failed_rules"),
    )


def _sql_rules(rules: tuple[Rule, ...]) -> str:
    parts = []
    for r in rules:
        ratio = f"(CASE WHEN {r.denominator} > 0 THEN {r.numerator} / {r.denominator} ELSE 0 END)"
        parts += [f"{ratio} >= {r.low}"] if r.low is not None else []
        parts += [f"{ratio} <= {r.high}"] if r.high is not None else []
    return " AND ".join(parts)


#: DuckDB: the same numbers, windows counted by grouping rows in place of sorting inside a row.
SQL = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM split WHERE len(w) >= 3),
counted AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM counted WHERE n > 1) GROUP BY doc_id),
metrics AS (
  SELECT doc_id, len(w) AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) AS n_stop_words
  FROM split LEFT JOIN covered USING (doc_id)),
based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM metrics)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {_sql_rules(RULES)} AS kept
FROM based
"""
