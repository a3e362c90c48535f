"""Roll-ups of measurements: best and median times, ratios to a baseline, budgets, platform comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_times(runs: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    return runs.groupBy(*keys).agg(F.min(seconds).alias("best"), F.median(seconds).alias("median"), F.count(F.lit(1)).alias("rounds"))


def against_baseline(results: DataFrame, keys: list[str], variant: str, baseline: str, value: str, out: str, inverse: bool = False) -> DataFrame:
    """``out``: a value over its baseline variant's with equal keys (or the other way round), by a join to the baseline rows."""
    base = results.where(F.col(variant) == baseline).groupBy(*keys).agg(F.min(value).alias("_base"))
    x = results.join(base, keys, "left")
    ratio = F.col("_base") / F.nullif(F.col(value), F.lit(0)) if inverse else F.col(value) / F.nullif(F.col("_base"), F.lit(0))
    return x.withColumn(out, ratio).drop("_base")


def streaming_budget(steps: DataFrame, fps: float) -> DataFrame:
    """Steps (step, side, ms, bytes) with budget, headroom, most frames a second and whether they fit; and a total for each side."""
    detail = steps.select("step", "side", "ms", "bytes")
    total = detail.groupBy("side").agg(F.sum("ms").alias("ms"), F.sum("bytes").alias("bytes")).withColumn("step", F.lit("total"))
    x = detail.unionByName(total.select("step", "side", "ms", "bytes"))
    budget = F.lit(1000.0 / fps)
    return x.select("step", "side", "ms", (budget).alias("budget_ms"), ((budget - F.col("ms")) / budget * 100).alias("headroom_pct"), (F.col("bytes") * fps).alias("bytes_per_s"), (F.lit(1000.0) / F.nullif(F.col("ms"), F.lit(0.0))).alias("max_fps"), (F.col("ms") <= budget).alias("fits"))


def lookup(steps: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """Steps with their measured figures, if there are any."""
    return steps.join(measured, keys, "left")


def compare_platforms(results: DataFrame, left: str, right: str) -> DataFrame:
    """Case by case: whether two platforms made the same bytes; cases of one of them alone are told."""
    a = results.where(F.col("platform") == left).select("case", F.col("sha256").alias("left_sha256"))
    b = results.where(F.col("platform") == right).select("case", F.col("sha256").alias("right_sha256"))
    verdict = F.when(F.col("left_sha256").isNull(), "right only").when(F.col("right_sha256").isNull(), "left only").when(F.col("left_sha256") == F.col("right_sha256"), "same").otherwise("different")
    return a.join(b, "case", "full").withColumn("verdict", verdict)
