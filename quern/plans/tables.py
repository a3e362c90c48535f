"""Tables that queries run on, derived from the driver's tables: a member log, pixel frames and measurements. SQL twins are for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DIR = "concat('d', cast({u} % 7 as string), '/e', cast({u} % 5 as string))"
_NAME = (
    "case when event_id % 97 = 0 then concat('d', cast(user_id % 7 as string)) when event_id % 31 = 0 then " + _DIR.format(u="user_id") + " "
    "when event_id % 53 = 0 then concat('/abs/', cast(user_id as string)) when event_id % 59 = 0 then concat('d1/../', cast(user_id as string)) "
    "else concat(" + _DIR.format(u="user_id") + ", '/', case when event_id % 3 = 0 then upper(event_type) else event_type end, '-', cast(user_id as string), case when event_id % 4 = 0 then '.ZIP' else '.log' end) end"
)
_TYPE = "case when event_id % 97 = 0 then '2' when event_id % 31 = 0 then '5' when event_id % 13 = 0 then '1' when event_id % 17 = 0 then '3' when event_id % 19 = 0 then '6' else '0' end"
_LINK = "case when event_id % 97 = 0 or event_id % 13 = 0 then concat(" + _DIR.format(u="(user_id + 1)") + ", '/', event_type, '-', cast(user_id + 1 as string), '.log') end"
_COLUMNS = [("archive", "concat('a', cast(event_id % 5 as string))"), ("ordinal", "{div}"), ("name", _NAME), ("typeflag", _TYPE), ("linkname", _LINK), ("size", "event_id % 1000"), ("mode", "cast(event_id * 37 % 4096 as int)")]

MEMBERS_SQL = "members AS (SELECT " + ", ".join(f"{e.replace('as string', 'as varchar').replace('{div}', 'event_id // 5')} AS {n}" for n, e in _COLUMNS) + ", epoch_us(ts) * 1000 AS mtime_ns FROM events)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as members of five archives, in each of which ordinals start anew."""
    x = read(spark, sf_dir, "events")
    return x.select(*[F.expr(e.replace("{div}", "event_id div 5")).alias(n) for n, e in _COLUMNS], (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") * 1000).alias("mtime_ns"))


#: Frames of 11 x 2 RGB pixels out of whole embeddings, filled up with zeros; every 10th vector is a 2 x 11 frame.
FRAMES_SQL = """frames AS (
  SELECT label AS clip, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame_idx, CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 11 END AS width,
    CASE WHEN vec_id % 10 = 0 THEN 11 ELSE 2 END AS height, list_transform(list_resize(embedding, 66, 0), lambda x: (floor(x::DOUBLE * {scale}) % 256 + 256)::INT % 256) AS pixels FROM embeddings
)"""


def frames(spark: SparkSession, sf_dir: str, scale: int = 512) -> DataFrame:
    """``scale``: how far values are spread; a small one makes equal neighbours. Frames are numbered by their keys alone, pixels come by a join."""
    x = read(spark, sf_dir, "embeddings")
    number = F.expr("cast(row_number() over (partition by label order by vec_id) - 1 as int)")
    keys = x.select("vec_id", F.col("label").alias("clip"), number.alias("frame_idx"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(65)), lambda i: F.coalesce(F.get("embedding", i).cast("double"), F.lit(0.0)))
    return keys.join(x.select("vec_id", "embedding"), "vec_id").select(
        "clip", "frame_idx",
        F.expr("case when vec_id % 10 = 0 then 2 else 11 end").alias("width"), F.expr("case when vec_id % 10 = 0 then 11 else 2 end").alias("height"),
        F.transform(filled, lambda v: F.pmod(F.floor(v * scale), F.lit(256)).cast("int")).alias("pixels"),
    )


RUNS_SQL = "runs AS (SELECT l_returnflag AS platform, 'n' || l_linenumber AS variant, l_quantity AS seconds, l_extendedprice AS bytes FROM lineitem)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as repeated timings: platform, variant n1 .. n7, seconds, bytes."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(F.col("l_returnflag").alias("platform"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("variant"), F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("bytes"))
