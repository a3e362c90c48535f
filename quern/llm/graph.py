"""Connected components by alternating star contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, even_join


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Link neighbours to the least node around: those above u (large star), or those below it and u itself (small star)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("degree"))
    low = low.withColumn("low", F.least("low", "u"))
    x = even_join(both, low, "u", "degree", 2 * rows, F.concat(F.lit("~"), F.col("u"), F.lit("~"), F.col("v")))
    if large:
        x = x.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        x = x.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return x.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 64, rows: int | None = None) -> DataFrame:
    """(node, label) for each node of ``edges`` (u, v: strings); the label is the least node of its component. ``rows``: how many edges there are at most, if known.

    Each round at least halves the logarithm of what is left; it ends when a round changes nothing.
    """
    x = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    x = scratch.save(x, f"{name}_0", rows=rows)
    before, rows = None, x.count()
    for i in range(1, most_rounds + 1):
        # A large star makes no more edges than there were, a small one at most one more for each node.
        x = scratch.save(_star(x, True, rows), f"{name}_{i}a", rows=rows)
        x = scratch.save(_star(x, False, rows), f"{name}_{i}b", rows=2 * rows)
        now = tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, rows = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return x.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(x.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
