"""Roll-up queries over timings made of lineitem and orders, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import metrics as M
from quern.plans.tables import RUNS_SQL, read, runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {RUNS_SQL} {sql}"
        return f

    return keep


_BEST = "best AS (SELECT platform, variant, min(seconds) AS best, median(seconds) AS median, count(*) AS rounds FROM runs GROUP BY ALL)"
_BYTES = "b AS (SELECT platform, variant, min(bytes) AS bytes FROM runs GROUP BY ALL)"


@query(f", {_BEST} SELECT * FROM best")
def best_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_times(runs(spark, sf_dir), ["platform", "variant"])


@query(f", {_BYTES} SELECT b.platform, b.variant, b.bytes, round(b.bytes / a.bytes * 100, 4) AS pct_of_raw FROM b JOIN b a ON a.platform = b.platform AND a.variant = 'n1'")
def percent_of_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = runs(spark, sf_dir).groupBy("platform", "variant").agg(F.min("bytes").alias("bytes"))
    return M.against_baseline(x, ["platform"], "variant", "n1", "bytes", "pct_of_raw").withColumn("pct_of_raw", F.round(F.col("pct_of_raw") * 100, 4))


@query(", m AS (SELECT platform, variant, median(bytes) AS seconds FROM runs GROUP BY ALL) SELECT m.platform, m.variant, m.seconds, round(a.seconds / m.seconds, 6) AS speedup FROM m JOIN m a ON a.platform = m.platform AND a.variant = 'n1'")
def speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = runs(spark, sf_dir).groupBy("platform", "variant").agg(F.median("bytes").alias("seconds"))
    return M.against_baseline(x, ["platform"], "variant", "n1", "seconds", "speedup", inverse=True).withColumn("speedup", F.round("speedup", 6))


@query(""", s AS (SELECT o_orderpriority AS step, o_orderstatus AS side, min(o_totalprice) / 1000 AS ms, count(*) AS bytes FROM orders GROUP BY ALL),
a AS (SELECT * FROM s UNION ALL SELECT 'total', side, sum(ms), sum(bytes) FROM s GROUP BY side)
SELECT step, side, round(ms, 6) AS ms, round(1000.0 / 60, 6) AS budget_ms, round((1000.0 / 60 - ms) / (1000.0 / 60) * 100, 4) AS headroom_pct, (bytes * 60)::DOUBLE AS bytes_per_s, round(1000.0 / ms, 4) AS max_fps, ms <= 1000.0 / 60 AS fits FROM a""")
def streaming_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("step"), F.col("o_orderstatus").alias("side"))
    x = M.streaming_budget(o.agg((F.min("o_totalprice") / 1000).alias("ms"), F.count(F.lit(1)).alias("bytes")), 60.0)
    return x.select("step", "side", F.round("ms", 6).alias("ms"), F.round("budget_ms", 6).alias("budget_ms"), F.round("headroom_pct", 4).alias("headroom_pct"), "bytes_per_s", F.round("max_fps", 4).alias("max_fps"), "fits")


@query(f", {_BEST}, l AS (SELECT l_shipmode AS variant, 0 AS x FROM (SELECT 'n' || l_linenumber AS l_shipmode FROM lineitem) GROUP BY ALL) SELECT l.variant, best.platform, best.best, best.rounds FROM l LEFT JOIN best ON l.variant = best.variant")
def measured_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = M.best_times(runs(spark, sf_dir), ["platform", "variant"]).drop("median")
    return M.lookup(runs(spark, sf_dir).select("variant").distinct(), best, ["variant"])


@query(""", p AS (SELECT l_shipdate::DATE::VARCHAR AS c, l_returnflag AS f, sha256(max(l_linestatus)) AS s FROM lineitem GROUP BY ALL),
a AS (SELECT c, s FROM p WHERE f = 'A'), b AS (SELECT c, s FROM p WHERE f = 'N')
SELECT coalesce(a.c, b.c) AS "case", a.s AS left_sha256, b.s AS right_sha256, CASE WHEN a.s IS NULL THEN 'right only' WHEN b.s IS NULL THEN 'left only' WHEN a.s = b.s THEN 'same' ELSE 'different' END AS verdict FROM a FULL JOIN b ON a.c = b.c""")
def platform_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("case"), F.col("l_returnflag").alias("platform")).agg(F.sha2(F.max("l_linestatus"), 256).alias("sha256"))
    return M.compare_platforms(x, "A", "N")
