"""Tables that several jobs of one operator read: written once to the shared folder, so a lost executor costs nothing."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.sources.scratch import scratch_path


#: Rows of a narrow table that one task writes.
TASK_ROWS = 250_000
#: Spark's switch that removes a query's shuffle files when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries begun in here leave no shuffle files (from Spark 4.1 on)."""
    if not spark.conf.isModifiable(CLEANUP):
        yield
        return
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder; cuts the lineage.

    The shuffle files of writing it are gone afterwards, so those of a chain of tables do not add up.
    If ``rows`` tells about how many narrow rows there are, the last tasks are joined to so many as these need.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    path = scratch_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Two columns ``doc_id`` (long) and ``text`` (string, null read as empty), whatever else the table holds."""
    return docs.select(
        F.col(f"`{id_column}`").cast(T.LongType()).alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast(T.StringType()), F.lit("")).alias("text"),
    )
