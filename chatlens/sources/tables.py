"""Reading and writing chat tables.

Output is always a directory of part files: a single-file export would push the whole table through
one task. ``write_table`` sizes the parts with a rebalance (adaptive, splits hot partition values) or,
when a sort is asked for, with a range repartition on the sort columns.
"""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.schema import RAW_CHAT, TIMESTAMP_FORMAT


def read_chat_log(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ";",
    schema: T.StructType = RAW_CHAT,
    fmt: str = "csv",
    multi_line: bool = False,
    corrupt_column: str | None = None,
) -> DataFrame:
    """Read a chat log with a declared schema; rows that do not fit it come back with nulls.

    ``multi_line`` allows line breaks inside quoted messages, but makes every CSV file one task; keep
    it off for a few big files, or use parquet. ``corrupt_column`` adds the whole line of rows with too few or
    too many fields, null for the others; without it, surplus fields leave no trace.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(*paths)
    if fmt != "csv":
        raise ValueError(f"unsupported format: {fmt}")
    if corrupt_column is not None:
        schema = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("columnNameOfCorruptRecord", corrupt_column or "_corrupt_record")
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .csv(paths)
    )


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Impose column names by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def read_annotations(
    spark: SparkSession,
    paths: Mapping[str, str],
    schema: T.StructType | Mapping[str, T.StructType],
    sep: str = ";",
) -> DataFrame:
    """One CSV per annotator, as one long table with an ``annotator`` column.

    Files may have different columns, or the same in another order: then ``schema`` gives each annotator's.
    What a file lacks is null.
    """
    schemas = schema if isinstance(schema, Mapping) else dict.fromkeys(paths, schema)
    frames = [
        read_chat_log(spark, path, sep=sep, schema=schemas[name]).withColumn("annotator", F.lit(name))
        for name, path in paths.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def register_views(views: Mapping[str, DataFrame]) -> None:
    """Expose frames to SQL under the given names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    sep: str = ",",
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
) -> None:
    """Overwrite ``path``; ``sort_by`` gives files in global order.

    Sort columns should end in one that separates the rows of a hot key (EVENT_ID within a
    conversation), so that the range partitions stay even.
    """
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*partition_by, *sort_by)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("sep", sep).option(
            "timestampFormat", TIMESTAMP_FORMAT
        ).csv(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
