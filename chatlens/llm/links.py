"""Connected components of a table of links, by alternating stars; every step is a written table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.shared import stage


def _with_least(pairs: DataFrame, name: str, rows: int) -> DataFrame:
    """(u, v) rows with ``m``, the least of u and all its v. Both sides are written tables: a hot u is split in the join."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(stage(least, f"{name}-least", rows), "u")


def components(links: DataFrame, name: str) -> DataFrame:
    """``node`` and ``root`` (its component's least node) of every node in ``links`` (columns ``a``, ``b``, long).

    No step makes more rows than twice the links, so their number sets the number of tasks.
    """
    ordered = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = stage(ordered.distinct(), f"{name}-edges")
    state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    rows = 2 * state[0]
    while True:
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, name, rows).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, f"{name}-large", rows)
        # Small star: neighbours below a node, and the node, go to the least of them.
        below = _with_least(large, name, rows)
        small = below.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = below.select("u", F.col("m").alias("v"))
        edges = stage(small.unionAll(own).distinct(), f"{name}-small", rows)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
