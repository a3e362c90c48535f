"""Raster queries over frames made of embeddings, each with its SQL twin. Arrays are compared as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import raster as R
from quern.operators import raster as O
from quern.plans.tables import FRAMES_SQL, frames

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, scale: int = 512):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {FRAMES_SQL.format(scale=scale)} {sql}"
        return f

    return keep


def text(a: Column) -> Column:
    return F.array_join(a, ",")


def _m(e: str) -> str:
    return f"((({e}) % 256 + 256) % 256)"


def _s(e: str) -> str:
    return f"({_m(f'({e}) + 128')} - 128)"


def _each(a: str, e: str) -> str:
    return f"list_transform(range(0, len({a})), lambda i: ({e})::INT)"


_OUT = "SELECT clip, frame_idx, array_to_string({}, ',') AS pixels FROM {}"
_PX = "list_transform(range(0, len(pixels) // 3), lambda p: {})"
_R, _G, _B = "pixels[p * 3 + 1]", "pixels[p * 3 + 2]", "pixels[p * 3 + 3]"
_CO = _m(f"{_R} - {_B}")
_T = _m(f"{_B} + ({_s(_CO)} >> 1)")
_CG = _m(f"{_G} - {_T}")
_YCOCG = "flatten(" + _PX.format(f"[{_m(f'{_T} + ({_s(_CG)} >> 1)')}, {_CO}, {_CG}]") + ")"


@query(_OUT.format(_YCOCG, "frames"))
def ycocg_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip", "frame_idx", text(R.ycocg_forward(F.col("pixels"))).alias("pixels"))


@query(_OUT.format("pixels", "frames"))
def ycocg_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip", "frame_idx", text(R.ycocg_inverse(R.ycocg_forward(F.col("pixels")))).alias("pixels"))


_LEFT = "CASE WHEN i % (width * 3) >= 3 THEN pixels[i - 2] WHEN i >= width * 3 THEN pixels[i + 1 - width * 3] ELSE 0 END"
_UP = f"CASE WHEN i >= width * 3 THEN pixels[i + 1 - width * 3] ELSE {_LEFT} END"
_UPLEFT = f"CASE WHEN i % (width * 3) >= 3 AND i >= width * 3 THEN pixels[i - 2 - width * 3] WHEN i >= width * 3 THEN {_LEFT} ELSE {_UP} END"


@query(_OUT.format(_each("pixels", _m(f"pixels[i + 1] - ({_LEFT})")), "frames"))
def sub_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip", "frame_idx", text(R.predict(F.col("pixels"), F.col("width"), median=False)).alias("pixels"))


_HI, _LO = f"greatest({_LEFT}, {_UP})", f"least({_LEFT}, {_UP})"
_MED = f"CASE WHEN ({_UPLEFT}) >= {_HI} THEN {_LO} WHEN ({_UPLEFT}) <= {_LO} THEN {_HI} ELSE ({_LEFT}) + ({_UP}) - ({_UPLEFT}) END"


@query(_OUT.format(_each("pixels", _m(f"pixels[i + 1] - ({_MED})")), "frames"))
def med_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip", "frame_idx", text(R.predict(F.col("pixels"), F.col("width"))).alias("pixels"))


@query(_OUT.format("pixels", "frames"))
def med_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = O.undo_predict(frames(spark, sf_dir).withColumn("pixels", R.predict(F.col("pixels"), F.col("width"))))
    return x.select("clip", "frame_idx", text(F.col("pixels")).alias("pixels"))


@query(_OUT.format(_each("pixels", "pixels[(i % (len(pixels) // 3)) * 3 + i // (len(pixels) // 3) + 1]"), "frames"))
def planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip", "frame_idx", text(R.to_planar(F.col("pixels"))).alias("pixels"))


@query(_OUT.format("pixels", "frames"))
def planar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip", "frame_idx", text(R.from_planar(R.to_planar(F.col("pixels")))).alias("pixels"))


_PREV = ", x AS (SELECT f.*, CASE WHEN p.width = f.width AND p.height = f.height THEN p.pixels END AS previous FROM frames f LEFT JOIN frames p ON f.clip = p.clip AND f.frame_idx = p.frame_idx + 1) "


@query(_PREV + _OUT.format(f"CASE WHEN previous IS NULL THEN pixels ELSE {_each('pixels', _m('pixels[i + 1] - previous[i + 1]'))} END", "x"))
def frame_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.transform(frames(spark, sf_dir), ["delta"]).select("clip", "frame_idx", text(F.col("pixels")).alias("pixels"))


@query(_PREV + _OUT.format(f"CASE WHEN previous IS NULL THEN pixels ELSE {_each('pixels', 'xor(pixels[i + 1], previous[i + 1])')} END", "x"))
def frame_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.transform(frames(spark, sf_dir), ["xor"]).select("clip", "frame_idx", text(F.col("pixels")).alias("pixels"))


def _eq(d: str) -> str:
    return f"pixels[p * 3 + 1:p * 3 + 3] = pixels[(p - {d}) * 3 + 1:(p - {d}) * 3 + 3]"


_FLAG = f"CASE WHEN p % width > 0 AND {_eq('1')} THEN 1 WHEN p >= width AND {_eq('width')} THEN 2 ELSE 0 END"
_SIM = f"CASE WHEN p % width > 0 AND {_eq('1')} THEN 1 WHEN p >= width AND {_eq('width')} THEN 2 WHEN p % width > 0 AND p >= width AND {_eq('(width + 1)')} THEN 3 WHEN p >= width AND p % width < width - 1 AND {_eq('(width - 1)')} THEN 4 ELSE 0 END"


def _codes(e: str) -> str:
    c = _PX.format(e)
    zeroed = _each("pixels", "CASE WHEN c[i // 3 + 1] > 0 THEN 0 ELSE pixels[i + 1] END")
    return f", x AS (SELECT *, {c} AS c FROM frames) SELECT clip, frame_idx, array_to_string(c, ',') AS codes, array_to_string({zeroed}, ',') AS pixels, len(list_filter(c, lambda v: v > 0)) AS hits FROM x"


@query(_codes(_FLAG), scale=8)
def flag_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = O.transform(frames(spark, sf_dir, 8), ["flag"], "frame")
    return x.select("clip", "frame_idx", text(F.col("codes")).alias("codes"), text(F.col("pixels")).alias("pixels"), O.hits(F.col("codes")).alias("hits"))


@query(_codes(_SIM), scale=8)
def dirsim_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = O.transform(frames(spark, sf_dir, 8), ["dirsim"])
    return x.select("clip", "frame_idx", text(F.col("codes")).alias("codes"), text(F.col("pixels")).alias("pixels"), O.hits(F.col("codes")).alias("hits"))


_COLOUR = f"{_R} * 65536 + {_G} * 256 + {_B}"


@query(f""", x AS (SELECT *, {_PX.format(_COLOUR)} AS c FROM frames), y AS (SELECT *, list_sort(list_distinct(c)) AS colours FROM x)
SELECT clip, frame_idx, array_to_string(colours, ',') AS colours, len(colours)::INT AS n_colours, greatest(1, ceil(log2(len(colours))))::INT AS bits,
  array_to_string(list_transform(c, lambda v: (list_position(colours, v) - 1)::INT), ',') AS pointers FROM y""", scale=8)
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = O.transform(frames(spark, sf_dir, 8), ["palette"], "frame")
    return x.select("clip", "frame_idx", text(F.col("colours")).alias("colours"), F.size("colours").alias("n_colours"), R.pointer_bits(F.col("colours")).alias("bits"), text(F.col("pixels")).alias("pointers"))


@query(_OUT.format("pixels", "frames"), scale=8)
def palette_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = O.transform(frames(spark, sf_dir, 8), ["palette"], "frame")
    return x.select("clip", "frame_idx", text(R.palette_decode(F.col("pixels"), F.col("colours"))).alias("pixels"))


@query("""SELECT clip, frame_idx, b AS band, CASE WHEN b < ceil(height / 2.0) * 0 + (height // ((height + 1) // 2)) THEN (height + 1) // 2 ELSE height - b * ((height + 1) // 2) END AS height,
  array_to_string(pixels[b * ((height + 1) // 2) * width * 3 + 1:(b + 1) * ((height + 1) // 2) * width * 3], ',') AS pixels FROM frames, range(2) r(b)""")
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.bands(frames(spark, sf_dir), 2).select("clip", "frame_idx", "band", F.col("height").cast("int").alias("height"), text(F.col("pixels")).alias("pixels"))


@query("SELECT clip, frame_idx, (860 + width * height * 3)::BIGINT AS stored_bytes FROM frames")
def strip_geo_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stored_bytes(frames(spark, sf_dir), strip_geo=True).select("clip", "frame_idx", "stored_bytes")
