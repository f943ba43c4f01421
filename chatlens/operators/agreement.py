"""Agreement between the annotator and people, on one long table of human annotations.

Predictions hold one row per conversation; the human table has one row per annotator and conversation.
They are joined once, whatever the number of annotators.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.features import (
    ANNOTATOR_EXTRA_COLUMNS,
    ANNOTATOR_TONES,
    PRIMARY_EMOTION_PATTERN,
)
from chatlens.functions.listtext import first_quoted_item

KEY = "INTERACTION_ID"


def normalise_annotations(
    annotations: DataFrame,
    emotions: Sequence[str] = (),
    tones: Sequence[str] = (),
    emotion_pattern: str = PRIMARY_EMOTION_PATTERN,
    tone_map: Mapping[str, str] = ANNOTATOR_TONES,
    drop: Sequence[str] = ANNOTATOR_EXTRA_COLUMNS,
) -> DataFrame:
    """Reduce emotions to the main one, null if none is marked, and map tones onto the scheme."""

    def main_emotion(name: str) -> Column:
        return F.nullif(F.regexp_extract(name, emotion_pattern, 1), F.lit(""))

    def mapped_tone(name: str) -> Column:
        chain = F.when(F.lit(False), F.col(name))
        for old, new in tone_map.items():
            chain = chain.when(F.col(name) == old, new)
        return chain.otherwise(F.col(name))

    return annotations.drop(*drop).withColumns(
        {**{c: main_emotion(c) for c in emotions}, **{c: mapped_tone(c) for c in tones}}
    )


def primary_emotion(predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reduce emotion lists, as arrays or as list text, to their first item."""
    arrays = {c for c, kind in predictions.dtypes if kind.startswith("array")}
    return predictions.withColumns(
        {
            c: F.get(F.col(c), F.lit(0)) if c in arrays else first_quoted_item(F.col(c))
            for c in columns
        }
    )


def align_columns(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Give columns under other names their canonical one."""
    return df.withColumnsRenamed(dict(aliases))


def _differs(feature: str, null_is_match: bool) -> Column:
    predicted, human = F.col(f"p.{feature}"), F.col(f"h.{feature}")
    if null_is_match:
        return F.coalesce(predicted != human, F.lit(False))
    return ~predicted.eqNullSafe(human)


def _compared(
    predictions: DataFrame,
    annotations: DataFrame,
    features: Sequence[str],
    null_is_match: bool,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Annotator, conversation and, per feature, whether the two differ."""
    joined = predictions.select(KEY, *features).alias("p").join(
        annotations.select("annotator", KEY, *features, *keep).alias("h"),
        F.col(f"p.{KEY}") == F.col(f"h.{KEY}"),
    )
    return joined.select(
        "h.annotator",
        F.col(f"p.{KEY}").alias(KEY),
        *[_differs(f, null_is_match).alias(f) for f in features],
        *keep,
    )


def _counted(annotations: DataFrame, features: Sequence[str]) -> DataFrame:
    """Equal annotations as one row with their number, so that a conversation that fills the table is
    small before it meets the join."""
    return annotations.groupBy("annotator", KEY, *features).agg(F.count("*").alias("copies"))


def mismatch_counts(
    predictions: DataFrame,
    annotations: DataFrame,
    features: Sequence[str],
    null_is_match: bool = True,
) -> DataFrame:
    """Per annotator, how many conversations differ in each feature."""
    people = _counted(annotations, features)
    compared = _compared(predictions, people, features, null_is_match, keep=("copies",))
    return compared.groupBy("annotator").agg(
        *[
            F.sum(F.when(F.col(f), F.col("copies")).otherwise(0)).alias(f"diff_{f}")
            for f in features
        ]
    )


def mismatch_with_average(counts: DataFrame, label: str = "average") -> DataFrame:
    """The mismatch counts and, as one more row, their averages over the annotators."""
    averaged = counts.rollup("annotator").agg(
        F.grouping("annotator").alias("is_total"),
        *[F.avg(c).alias(c) for c in counts.columns if c != "annotator"],
    )
    return averaged.withColumn(
        "annotator", F.when(F.col("is_total") == 1, label).otherwise(F.col("annotator"))
    ).drop("is_total")


def mismatch_fields(
    predictions: DataFrame,
    annotations: DataFrame,
    features: Sequence[str],
    null_is_match: bool = True,
) -> DataFrame:
    """Per annotator and conversation, the annotator's name under each feature that differs."""
    compared = _compared(predictions, annotations, features, null_is_match)
    return compared.select(
        "annotator", KEY, *[F.when(F.col(f), F.col("annotator")).alias(f) for f in features]
    )


def disagreement_sets(
    predictions: DataFrame,
    annotations: DataFrame,
    features: Sequence[str],
    null_is_match: bool = True,
) -> DataFrame:
    """Per conversation and feature, the sorted names of the annotators who differ.

    Sets, so that a list never outgrows the number of annotators.
    """
    people = _counted(annotations, features)
    return (
        mismatch_fields(predictions, people, features, null_is_match)
        .groupBy(KEY)
        .agg(*[F.array_sort(F.collect_set(f)).alias(f) for f in features])
    )
