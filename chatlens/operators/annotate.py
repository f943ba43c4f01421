"""Responses of an annotator to conversations, and the features in them."""

import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.features import NOT_AVAILABLE, Feature
from chatlens.operators.conversations import matches


class Annotator(Protocol):
    """Turns a list of prompts into as many responses; runs in the Python workers."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def annotate(
    docs: DataFrame,
    make_annotator: Callable[[], Annotator],
    text: str = "json_string",
    column: str = "response",
    batch_size: int = 16,
    partitions: int | None = None,
) -> DataFrame:
    """Add one response per row; only the text goes to Python.

    ``make_annotator`` is shipped to the workers and called once per partition, so it may open
    connections or load models. It is asked ``batch_size`` prompts at a time. If a batch fails, its rows are
    tried one by one, and a row that fails gets the text ``Error: Type; args``. ``partitions`` spreads the
    rows over that many tasks: slow annotators want more, and smaller, partitions than a plan made by bytes
    gives. Write the result to a table before using it twice, as a lost executor means that its prompts are
    asked again.
    """
    if partitions is not None:
        docs = docs.repartition(partitions)

    def attempt(ask: Annotator, prompts: list[str]) -> list[str]:
        try:
            answers = ask(prompts)
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return answers
        except Exception as error:
            if len(prompts) > 1:
                return [answer for p in prompts for answer in attempt(ask, [p])]
            return [f"Error: {type(error).__name__}; {error.args!r}"]

    def respond(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = make_annotator()
        for batch in batches:
            prompts = batch.tolist()
            starts = range(0, len(prompts), batch_size)
            answers = [a for i in starts for a in attempt(ask, prompts[i : i + batch_size])]
            yield pd.Series(answers, dtype=object)

    # Answers may differ from one call to the next, so no plan may ask twice where one was meant.
    response = F.pandas_udf(respond, T.StringType()).asNondeterministic()
    return docs.withColumn(column, response(F.col(text)))


Lexicon = dict[str, tuple[tuple[str, str], ...]]


def lexicon_response(text: Column, lexicon: Lexicon) -> Column:
    """JSON response of a word-list annotator that stays inside the JVM.

    ``lexicon`` gives, per feature, values with regexes in order of precedence; a feature none of whose
    regexes occurs is not available.
    """

    def pick(rules: Sequence[tuple[str, str]]) -> Column:
        chain = F.when(F.lit(False), NOT_AVAILABLE)
        for value, regex in rules:
            chain = chain.when(matches(text, regex), value)
        return chain.otherwise(NOT_AVAILABLE)

    return F.to_json(F.struct(*[pick(rules).alias(name) for name, rules in lexicon.items()]))


def annotate_with_lexicon(
    docs: DataFrame, lexicon: Lexicon, text: str = "json_string", column: str = "response"
) -> DataFrame:
    """Add the response of the word-list annotator."""
    return docs.withColumn(column, lexicon_response(F.col(text), lexicon))


class LexiconAnnotator:
    """The word-list annotator as a Python annotator, with the same answers."""

    def __init__(self, lexicon: Lexicon):
        self.rules = {
            name: [(value, re.compile(regex, re.IGNORECASE | re.ASCII)) for value, regex in rules]
            for name, rules in lexicon.items()
        }

    def __call__(self, prompts: list[str]) -> list[str]:
        return [
            json.dumps(
                {
                    name: next((v for v, r in rules if r.search(prompt)), "NA")
                    for name, rules in self.rules.items()
                },
                ensure_ascii=False,
                separators=(",", ":"),
            )
            for prompt in prompts
        ]


def _plain_json(texts: pd.Series) -> pd.Series:
    """JSON objects that Python reads, written so that every parser reads them; null for anything else."""

    def plain(text: str | None) -> str | None:
        try:
            value = json.loads(text, parse_constant=str)
        except (TypeError, ValueError, RecursionError):
            return None
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None

    return texts.map(plain).astype(object)


def parse_responses(
    df: DataFrame, text: str = "response", column: str = "parsed", success: str = "success"
) -> DataFrame:
    """Add the parsed response and whether it is a JSON object; anything else parses to null.

    Of a repeated key the last value counts, and NaN, Infinity and -Infinity, which JSON does not know, are
    read as these texts. Spark's parser refuses both, so objects it refuses are rewritten in Python first; all
    others stay in the JVM. The parser stops at the end of the first value and passes over what follows. The
    text is therefore parsed inside an object and inside an array: whatever could close the one early cannot
    close the other.
    """
    source = F.col(text)
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), source, F.lit("}")))
    in_array = F.try_parse_json(F.concat(F.lit("["), source, F.lit("]")))
    is_object = F.coalesce(source.rlike(r"^[ \t\r\n]*\{"), F.lit(False))
    strict = F.when(
        is_object,
        F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant")),
    )
    refused = F.when(is_object & F.col(column).isNull(), source)
    return (
        df.withColumn(column, strict)
        .withColumn("__plain", F.pandas_udf(_plain_json, T.StringType())(refused))
        .withColumn(column, F.coalesce(F.col(column), F.try_parse_json("__plain")))
        .drop("__plain")
        .withColumn(success, F.col(column).isNotNull())
    )


def _path(name: str, nested: bool) -> str:
    keys = name.split(".") if nested else [name]
    return "$" + "".join(f'["{key}"]' for key in keys)


def _other_keys(declared: frozenset[str]):
    """The keys of responses that no feature declares, as JSON text; nested ones under their path."""

    def leaves(value: dict, path: str) -> Iterator[tuple[str, object]]:
        for key, item in value.items():
            name = f"{path}.{key}" if path else key
            if name in declared:
                continue
            if isinstance(item, dict) and item:
                yield from leaves(item, name)
            else:
                yield name, item

    def other(text: str | None) -> str | None:
        found = dict(leaves(json.loads(text), "")) if text else {}
        return json.dumps(found, ensure_ascii=False, separators=(",", ":")) if found else None

    @F.pandas_udf(T.StringType())
    def others(texts: pd.Series) -> pd.Series:
        return texts.map(other).astype(object)

    return others


def flatten_features(
    df: DataFrame,
    features: Sequence[Feature],
    column: str = "parsed",
    drop: Sequence[str] = ("chats", "json_string", "prompt"),
    other: str | None = "other_keys",
) -> DataFrame:
    """One column per feature from the parsed response: arrays for lists, text for the others.

    A feature is looked for under its name, then under its aliases, where dots lead into nested
    objects. A list feature that comes as a single text becomes a list of one. Whatever else a response
    holds is kept in ``other`` as JSON text, nested keys under their dotted path; null if there is nothing.
    """
    names = [n for f in features for n in (f.name, *f.aliases)]

    def read(feature: Feature) -> Column:
        candidates = []
        for name in (feature.name, *feature.aliases):
            paths = {_path(name, nested) for nested in (False, True)}
            for path in sorted(paths):
                value = F.try_variant_get(column, path, "string")
                if feature.is_list:
                    candidates.append(F.try_variant_get(column, path, "array<string>"))
                    # An array read as text is its JSON; only a plain text makes a list of one.
                    is_text = ~F.startswith(F.ltrim(value), F.lit("["))
                    candidates.append(F.when(is_text, F.array(value)))
                else:
                    candidates.append(value)
        return F.coalesce(*candidates)

    extra = []
    if other is not None:
        # Only responses with a key that is no feature go to Python.
        keys = F.map_keys(F.try_variant_get(column, "$", "map<string, variant>"))
        undeclared = F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0
        text = F.when(undeclared, F.to_json(F.col(column)))
        extra = [_other_keys(frozenset(names))(text).alias(other)]
    return df.select(
        *[c for c in df.columns if c not in (*drop, column)],
        *[read(f).alias(f.name) for f in features],
        *extra,
    )


def merge_parts(
    parts: DataFrame, features: Sequence[Feature], key: str = "INTERACTION_ID", part: str = "PART"
) -> DataFrame:
    """One row of features per conversation from rows per part.

    Of a single value the first that is available counts, in the order of parts; lists are united in this
    order, each item once. ``success`` tells whether any part was read; other columns are dropped.
    """
    position = F.col(part)
    columns = []
    for f in features:
        value = F.col(f.name)
        usable = value.isNotNull() if f.is_list else value.isNotNull() & (value != NOT_AVAILABLE)
        if f.is_list:
            held = F.array_sort(
                F.collect_list(F.when(usable, F.struct(position.alias("p"), value.alias("v"))))
            )
            united = F.array_distinct(F.flatten(F.transform(held, lambda x: x["v"])))
            columns.append(F.when(F.count(F.when(usable, 1)) > 0, united).alias(f.name))
        else:
            first = F.min_by(value, F.when(usable, position))
            columns.append(F.coalesce(first, F.max(value)).alias(f.name))
    return parts.groupBy(key).agg(F.bool_or("success").alias("success"), *columns)


def flatten_struct(df: DataFrame, column: str, sep: str = "_") -> DataFrame:
    """Replace a struct column by its leaves, named by their path; arrays stay, the rest becomes text."""

    def leaves(field: T.StructField, value: Column, name: str) -> list[Column]:
        if isinstance(field.dataType, T.StructType):
            return [
                leaf
                for f in field.dataType.fields
                for leaf in leaves(f, value.getField(f.name), f"{name}{sep}{f.name}" if name else f.name)
            ]
        if isinstance(field.dataType, T.ArrayType):
            return [value.alias(name)]
        return [value.cast("string").alias(name)]

    field = df.schema[column]
    return df.select(
        *[c for c in df.columns if c != column], *leaves(field, F.col(column), "")
    )


def response_schema(df: DataFrame, column: str = "parsed") -> DataFrame:
    """One row: the schema that covers all parsed responses, as text for ``from_json``."""
    return df.agg(F.schema_of_variant_agg(column).alias("schema"))


def flatten_discovered(
    df: DataFrame, column: str = "parsed", drop: Sequence[str] = ("chats", "json_string", "prompt"), sep: str = "_"
) -> DataFrame:
    """One column per leaf of the responses, with no feature declared: the schema is what all of them hold together.

    It is found in a pass of its own (a partial aggregate) and is all that the driver sees. Leaves are named
    by their path; lists stay lists, the rest becomes text. Without any object there are no columns to add.
    """
    found = response_schema(df, column).first()["schema"] or ""
    rest = df.drop(*drop)
    if not found.startswith("OBJECT<"):
        return rest.drop(column)
    # What a variant calls an object a column calls a struct; keys that are all null have no kind.
    kind = found.replace("OBJECT<", "STRUCT<").replace(": VOID", ": STRING")
    return flatten_struct(rest.withColumn(column, F.try_variant_get(column, "$", kind)), column, sep)
