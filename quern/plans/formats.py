"""Queries over formats: image headers, container headers, first bytes, chunks; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import codecs
from quern.plans.tables import read
from quern.sources import rgb1, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as images: packed to bytes, then parsed again."""
    k = F.col("c_custkey")
    fields = {
        "width": k % 5 + 1, "height": k % 3 + 1, "lat_e7": (k * 7919) % 1_800_000_001 - 900_000_000, "lng_e7": (k * 104729) % 3_600_000_001 - 1_800_000_000, "height_mm": k * 13 - 5000,
        "title": F.col("c_name"), "country": F.col("c_mktsegment"), "creator_email": F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com")), "right": F.lit("CcBy"), "created_unix_ms": k * 86_400_123 - 10**10,
    }
    pixels = F.unhex(F.repeat(F.lit("0A0B0C"), ((k % 5 + 1) * (k % 3 + 1)).cast("int")))
    return read(spark, sf_dir, "customer").select("c_custkey", rgb1.pack(fields, pixels).alias("content"))


@query("""SELECT c_custkey, c_custkey % 5 + 1 AS width, c_custkey % 3 + 1 AS height, printf('%.7f', ((c_custkey * 7919) % 1800000001 - 900000000) / 1e7) AS latitude, printf('%.7f', ((c_custkey * 104729) % 3600000001 - 1800000000) / 1e7) AS longitude,
printf('%.3f', (c_custkey * 13 - 5000) / 1e3) AS height_m, 1::BIGINT AS geo_datum_code, c_name AS title, c_mktsegment AS country, lower(replace(c_name, '#', '')) || '@example.com' AS creator_email, 'CcBy' AS "right",
c_custkey * 86400123 - 10000000000 AS created_unix_ms, 480::BIGINT AS timezone_offset_minutes, (c_custkey % 5 + 1) * (c_custkey % 3 + 1) * 3 AS payload_bytes FROM customer""")
def rgb1_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image headers packed into bytes, parsed back and reported."""
    x = _images(spark, sf_dir).select("c_custkey", *rgb1.header(F.col("content")), rgb1.payload(F.col("content")).alias("payload"))
    return rgb1.info(x, "c_custkey")


@query(r"""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'dimensions' WHEN p_retailprice * 1000000 > 900000000 * 1.5 THEN 'geo' WHEN length(p_name) > 64 OR length(p_name) = 0 THEN 'title'
WHEN NOT regexp_full_match(p_type || '@' || p_brand, '[^@ ]+@[^ ]*\.[^ ]*') THEN 'creator_email' WHEN NOT regexp_full_match(substr(p_brand, 1, 4), '[A-Za-z]{1,4}') THEN 'right' END AS problem FROM part""")
def rgb1_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "part")
    lat = F.when(F.col("p_retailprice") * 1000000 > 900000000 * 1.5, F.lit(900_000_001)).otherwise(F.lit(0))
    why = rgb1.problem(F.col("p_size") % 7, F.lit(1), lat, F.lit(0), F.col("p_name"), F.lit("x"), F.concat("p_type", F.lit("@"), "p_brand"), F.substring("p_brand", 1, 4), F.lit(1))
    return x.select("p_partkey", why.alias("problem"))


@query("SELECT c_custkey, coalesce(CASE WHEN abs(c_acctbal / 50) <= 90 THEN round(c_acctbal / 50 * 10000000)::BIGINT END, 900000001) AS lat_e7 FROM customer")
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(rgb1.scaled(F.col("c_acctbal") / 50, 10_000_000, -90, 90), F.lit(900_000_001)).alias("lat_e7"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 NOT IN (1, 2) THEN 'kdf' WHEN o_orderkey % 29 NOT BETWEEN 10 AND 22 THEN 'logN' WHEN o_orderkey % 35 NOT BETWEEN 1 AND 32 OR o_orderkey % 19 NOT BETWEEN 1 AND 16 THEN 'r/p'
WHEN 128 * (o_orderkey % 35) * (1::BIGINT << (o_orderkey % 29)::INT) > 1073741824 THEN 'memory' WHEN o_orderkey * 16 NOT BETWEEN 1024 AND 67108864 THEN 'chunk' END AS problem FROM orders""")
def container_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of an encrypted container's header."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", container_problem(k % 4, k % 29, k % 35, k % 19, k * 16).alias("problem"))


def container_problem(kdf, log_n, r, p, chunk_size):
    ok = [(kdf.isin(1, 2), "kdf"), (log_n.between(10, 22), "logN"), (r.between(1, 32) & p.between(1, 16), "r/p"), (F.lit(128) * r * F.pow(F.lit(2.0), log_n) <= 1 << 30, "memory"), (chunk_size.between(1024, 1 << 26), "chunk")]
    out = F.lit(None).cast("string")
    for fine, what in reversed(ok):
        out = F.when(~fine, F.lit(what)).otherwise(out)
    return out


_SHOWN = [m for m in codecs.MAGICS if m[0] != "uuencode"]


@query("SELECT doc_id, CASE doc_id % " + str(len(_SHOWN) + 1) + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(_SHOWN)) + " ELSE 'unknown' END AS format FROM documents")
def outer_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind first bytes of different formats, told apart by these."""
    head = F.lit("00")
    for i, (_, m) in enumerate(_SHOWN):
        head = F.when(F.col("doc_id") % (len(_SHOWN) + 1) == i, F.lit(m.hex())).otherwise(head)
    return read(spark, sf_dir, "documents").select("doc_id", sinks.outer_format(F.concat(F.unhex(head), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("format"))


@query("SELECT page_id::VARCHAR AS path, c::INT AS chunk_idx, sha256(substr(url, (c * 16 + 1)::BIGINT, 16)) AS sha256 FROM pages, range(8) r(c) WHERE c < greatest(1, ceil(length(url) / 16.0))")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("url", "UTF-8").alias("content"))
    return sinks.chunks(files, 16).select("path", "chunk_idx", F.sha2("bytes", 256).alias("sha256"))


@query("SELECT o_orderkey, o_orderkey AS octal, o_orderkey * 2654435761 % 4294967296 AS unsigned, CASE WHEN o_orderkey * 2654435761 % 4294967296 >= 2147483648 THEN o_orderkey * 2654435761 % 4294967296 - 4294967296 ELSE o_orderkey * 2654435761 % 4294967296 END AS signed FROM orders")
def binary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octal, unsigned and two's complement fields, made and read back."""
    k = F.col("o_orderkey")
    word = rgb1.big_endian(k * 2654435761 % 4294967296, 4)
    u = rgb1.unsigned(word).cast("long")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.conv(F.lpad(F.conv(k.cast("string"), 10, 8), 11, "0"), 8, 10).cast("long").alias("octal"), u.alias("unsigned"), F.when(u >= 2**31, u - 2**32).otherwise(u).alias("signed"))
