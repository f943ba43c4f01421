"""Session settings the operators are written for."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Cuts partitions to size at run time and splits the partitions of hot join keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot USER_ID is split even if the split costs one more shuffle further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole conversations cross to Python, so few rows per batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "chatlens", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with :data:`SETTINGS`; keyword settings use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
