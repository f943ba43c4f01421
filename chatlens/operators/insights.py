"""Quality of the extracted features and what they say."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions import listtext
from chatlens.functions.features import (
    CLOSED,
    DEFAULT_OTHER_TOPIC,
    DEFAULT_TOPIC_RULES,
    MISSING_TOKENS,
    NOT_AVAILABLE,
    Feature,
)
from chatlens.operators.conversations import matches


def parse_list_text(
    df: DataFrame, columns: Sequence[str], keep_blanks: Sequence[str] = ()
) -> DataFrame:
    """List text to arrays; columns that are arrays already stay as they are."""
    arrays = {c for c, kind in df.dtypes if kind.startswith("array")}
    return df.withColumns(
        {
            c: listtext.parse_list_text(F.col(c), keep_blanks=c in keep_blanks)
            for c in columns
            if c not in arrays
        }
    )


def coalesce_variant_columns(
    df: DataFrame,
    variants: Mapping[str, str],
    missing: Sequence[str] = MISSING_TOKENS,
) -> DataFrame:
    """Where a column's value is missing take that of its twin under another name; drop the twin.

    A list is missing if it holds nothing but missing values.
    """
    kinds = dict(df.dtypes)
    tokens = tuple(missing)

    def given(name: str) -> Column:
        col = F.col(name)
        if kinds[name].startswith("array"):
            return F.when(F.exists(col, lambda x: ~x.isin(*tokens)), col)
        return listtext.null_if_in(col, tokens)

    return df.withColumns(
        {name: F.coalesce(given(name), F.col(twin)) for name, twin in variants.items()}
    ).drop(*variants.values())


def failed_annotations(df: DataFrame, listed_ids: Sequence[str] = ()) -> DataFrame:
    """Rows whose response could not be read, and those of the listed conversations."""
    failed = ~F.col("success")
    if listed_ids:
        failed = failed | F.col("INTERACTION_ID").isin(*listed_ids)
    return df.filter(failed)


def failed_annotation_count(df: DataFrame, listed_ids: Sequence[str] = ()) -> DataFrame:
    """One row: how many there are."""
    return failed_annotations(df, listed_ids).agg(F.count("*").alias("failed"))


def _closed(features: Sequence[Feature]) -> list[Feature]:
    return [f for f in features if f.kind == CLOSED]


def _invented(feature: Feature) -> Column:
    return ~F.col(feature.name).isin(*feature.allowed)


def out_of_vocabulary_counts(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """One row: per closed feature, rows with a value outside its vocabulary; null is not one."""
    return df.agg(*[F.count_if(_invented(f)).alias(f.name) for f in _closed(features)])


def out_of_vocabulary_values(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """The invented values of the closed features, with the number of rows that have them."""
    invented = F.array_compact(
        F.array(
            *[
                F.when(
                    _invented(f),
                    F.struct(F.lit(f.name).alias("feature"), F.col(f.name).alias("value")),
                )
                for f in _closed(features)
            ]
        )
    )
    return (
        df.select(F.explode(invented).alias("v"))
        .groupBy("v.feature", "v.value")
        .agg(F.count("*").alias("rows"))
    )


def out_of_vocabulary_value_counts(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Per closed feature with invented values, how many different ones there are."""
    values = out_of_vocabulary_values(df, features)
    return values.groupBy("feature").agg(F.count("*").alias("values"))


def generated_list_items(
    df: DataFrame, features: Sequence[Feature], prefix: str = "generated_"
) -> DataFrame:
    """Per closed list, the items outside its vocabulary as a new array, repeats included."""

    def outside(feature: Feature) -> Column:
        return F.filter(feature.name, lambda x: ~F.coalesce(x, F.lit("")).isin(*feature.allowed))

    return df.withColumns({prefix + f.name: outside(f) for f in features if f.vocabulary and f.is_list})


def multi_valued_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose list has more than one item."""
    return df.filter(F.size(column) > 1)


def generated_item_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each item of an array column occurs."""
    return (
        df.select(F.explode(column).alias("item"))
        .groupBy("item")
        .agg(F.count("*").alias("count"))
    )


def generated_item_totals(df: DataFrame, column: str) -> DataFrame:
    """One row: items in all, and different items."""
    return generated_item_counts(df, column).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("distinct")
    )


def summary_length_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: average and largest length of a text column, in characters."""
    length = F.length(column)
    return df.agg(
        F.round(F.avg(length), 2).alias("avg_length"), F.max(length).alias("max_length")
    )


def list_size_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: average size of each list column; rows without list do not count."""
    size = {c: F.when(F.col(c).isNotNull(), F.size(c)) for c in columns}
    return df.agg(*[F.round(F.avg(s), 2).alias(f"avg_{c}") for c, s in size.items()])


def distinct_topic_sets(df: DataFrame, column: str) -> DataFrame:
    """One row: different topic lists."""
    return df.agg(F.count_distinct(column).alias("distinct_topic_sets"))


def _topics(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("topic")).select(F.trim("topic").alias("topic"))


def topic_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: topics in all, and different topics, without the blanks around them."""
    counted = _topics(df, column).groupBy("topic").agg(F.count("*").alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")
    )


def classify_topics(
    df: DataFrame,
    column: str,
    rules: Sequence[tuple[str, str]] = DEFAULT_TOPIC_RULES,
    other: str = DEFAULT_OTHER_TOPIC,
) -> DataFrame:
    """Each different topic with how often it occurs and its class, in lower case.

    Topics are reduced to the different ones before any regex is tried.
    """
    topics = _topics(df, column).groupBy("topic").agg(F.count("*").alias("n"))
    topic_class = F.when(F.lit(False), F.lit(other))
    for name, regex in rules:
        topic_class = topic_class.when(matches(F.col("topic"), regex), name)
    return topics.withColumn("topic_class", F.lower(topic_class.otherwise(other)))


def topic_class_counts(classified: DataFrame, weight: str = "unique") -> DataFrame:
    """Topics per class: different ones, or every occurrence with ``weight="all"``."""
    n = {"unique": F.count("*"), "all": F.sum("n")}[weight]
    return classified.groupBy("topic_class").agg(n.alias("count"))


def all_na_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every one of the columns is NA."""
    return df.filter(F.forall(F.array(*columns), lambda x: x == NOT_AVAILABLE))


def all_na_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many there are."""
    return all_na_rows(df, columns).agg(F.count("*").alias("all_na"))
