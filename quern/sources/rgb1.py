"""RGB1 images: an 876-byte header and rows of RGB bytes, parsed, checked and made by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Offset and size of each field of the header.
FIELDS = {
    "magic": (0, 4), "width": (4, 4), "height": (8, 4), "flags": (12, 4), "lat_e7": (16, 4), "lng_e7": (20, 4), "height_mm": (24, 4), "datum": (28, 4),
    "title": (32, 64), "country": (96, 512), "creator_email": (608, 254), "right": (862, 4), "created_unix_ms": (866, 8), "tz_offset_min": (874, 2),
}
HEADER_SIZE = 876
TEXT = ("title", "country", "creator_email", "right")
SIGNED = ("lat_e7", "lng_e7", "height_mm", "created_unix_ms", "tz_offset_min")


def _field(content: Column, name: str) -> Column:
    at, size = FIELDS[name]
    return F.substring(content, at + 1, size)


def unsigned(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")


def _number(content: Column, name: str) -> Column:
    size, v = FIELDS[name][1], unsigned(_field(content, name))
    if name in SIGNED:
        half, whole = 1 << (8 * size - 1), 1 << (8 * size)
        v = F.when(v >= F.lit(str(half)).cast("decimal(20,0)"), v - F.lit(str(whole)).cast("decimal(20,0)")).otherwise(v)
    return v.cast("long")


def _ascii(content: Column, name: str) -> Column:
    """Text up to the first zero byte or the field's end."""
    return F.decode(F.unhex(F.regexp_replace(F.hex(_field(content, name)), "^((?:..)*?)00.*$", "$1")), "ISO-8859-1")


def header(content: Column) -> list[Column]:
    """All fields but the magic as columns."""
    return [(_ascii if n in TEXT else _number)(content, n).alias(n) for n in FIELDS if n != "magic"]


def payload(content: Column) -> Column:
    return F.substring(content, HEADER_SIZE + 1, 2147483647)


def _printable(c: Column, most: int) -> Column:
    return c.rlike(rf"^[\x20-\x7e]{{1,{most}}}$") & ~c.contains("\n")


def problem(width: Column, height: Column, lat_e7: Column, lng_e7: Column, title: Column, country: Column, email: Column, right: Column, flags: Column, payload_bytes: Column | None = None) -> Column:
    """What is wrong with an image's fields, or null. Only the first @ of an address counts."""
    checks = [
        (flags.bitwiseAND(F.lit(1)) == 0, "flags"),
        ((width <= 0) | (height <= 0), "dimensions"),
        ((F.abs(lat_e7) > 900_000_000) | (F.abs(lng_e7) > 1_800_000_000), "geo"),
        (~_printable(title, 64), "title"),
        (~_printable(country, 512), "country"),
        (~_printable(email, 254) | ~email.rlike(r"^[^@ ]+@[^ ]*\.[^ ]*$"), "creator_email"),
        (~right.rlike(r"^[A-Za-z]{1,4}$"), "right"),
    ]
    if payload_bytes is not None:
        checks.append((payload_bytes != width * height * 3, "payload"))
    out = F.lit(None).cast("string")
    for wrong, what in reversed(checks):
        out = F.when(wrong | wrong.isNull(), F.lit(what)).otherwise(out)
    return out


def scaled(value: Column, scale: int, least: float, most: float) -> Column:
    """Fixed point, half away from zero; null outside the range."""
    return F.when((value >= least) & (value <= most), F.round(value * scale).cast("long"))


def big_endian(v: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.substring(F.lpad(F.hex(v.cast("long")), 16, "0"), 17 - 2 * size, 2 * size), 2 * size, "0"))


def _padded(c: Column, size: int) -> Column:
    return F.unhex(F.rpad(F.hex(F.encode(c, "UTF-8")), 2 * size, "0"))


def pack(fields: dict[str, Column], pixels: Column) -> Column:
    """A file's bytes; flags and datum default to 1, the time zone to 480 minutes."""
    fields = {"flags": F.lit(1), "datum": F.lit(1), "tz_offset_min": F.lit(480)} | fields
    parts = [F.encode(F.lit("RGB1"), "UTF-8")]
    parts += [_padded(fields[n], size) if n in TEXT else big_endian(fields[n], size) for n, (_, size) in FIELDS.items() if n != "magic"]
    return F.concat(*parts, pixels)


def info(images: DataFrame, *keys: str) -> DataFrame:
    """What an info report shows, beside the columns ``keys``; images: width .. tz_offset_min, payload."""
    return images.select(
        *keys,
        "width", "height", F.format_string("%.7f", F.col("lat_e7") / 1e7).alias("latitude"), F.format_string("%.7f", F.col("lng_e7") / 1e7).alias("longitude"), F.format_string("%.3f", F.col("height_mm") / 1e3).alias("height_m"),
        F.col("datum").alias("geo_datum_code"), "title", "country", "creator_email", "right", "created_unix_ms", F.col("tz_offset_min").alias("timezone_offset_minutes"), F.length("payload").cast("long").alias("payload_bytes"),
    )


def read_rgb1(spark: SparkSession, path: str) -> DataFrame:
    """Images below a path in name order: path, header fields, payload, problem (null if the file is sound)."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    c = F.col("content")
    out = x.select("path", (F.hex(F.substring(c, 1, 4)) == F.lit("52474231")).alias("_magic"), F.length(c).alias("_n"), *header(c), payload(c).alias("payload"))
    why = problem(*[F.col(n) for n in ("width", "height", "lat_e7", "lng_e7", "title", "country", "creator_email", "right", "flags")], F.length("payload").cast("long"))
    why = F.when(F.col("_n") < HEADER_SIZE, "short").when(~F.col("_magic"), "magic").otherwise(why)
    return out.withColumn("problem", why).drop("_magic", "_n")


def frames(images: DataFrame, order: str = "path") -> DataFrame:
    """Images as frames of one clip: frame_idx by name, pixels as an array."""
    from pyspark.sql import Window

    folder = F.regexp_extract(order, r"^(.*)/[^/]*$", 1)
    x = images.withColumn("clip", folder).withColumn("frame_idx", F.row_number().over(Window.partitionBy("clip").orderBy(order)) - 1)
    values = F.transform(F.sequence(F.lit(1), F.length("payload")), lambda i: F.conv(F.hex(F.substring(F.col("payload"), i, F.lit(1))), 16, 10).cast("int"))
    return x.select("clip", "frame_idx", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), values.alias("pixels"))
