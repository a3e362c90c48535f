"""Reversible pixel transforms as expressions over one array a frame (row-major, interleaved RGB, 0-255).

A frame (or a band of rows) is one row with an array, so neighbours are array elements: no window, no shuffle, no explode.
All arithmetic is modulo 256.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte(c: Column) -> Column:
    return F.pmod(c, F.lit(256)).cast("int")


def signed(c: Column) -> Column:
    """A byte read as two's complement."""
    return F.pmod(c + 128, F.lit(256)) - 128


def indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def each(a: Column, f) -> Column:
    """f(index) for each element of an array."""
    return F.transform(indices(F.size(a)), f)


def _triples(a: Column, f) -> Column:
    pixels = F.transform(indices(F.floor(F.size(a) / 3)), lambda i: f(F.get(a, i * 3), F.get(a, i * 3 + 1), F.get(a, i * 3 + 2)))
    return F.flatten(pixels)


def ycocg_forward(a: Column) -> Column:
    def f(r: Column, g: Column, b: Column) -> Column:
        co = byte(r - b)
        t = byte(b + F.shiftright(signed(co), 1))
        cg = byte(g - t)
        return F.array(byte(t + F.shiftright(signed(cg), 1)), co, cg)

    return _triples(a, f)


def ycocg_inverse(a: Column) -> Column:
    def f(y: Column, co: Column, cg: Column) -> Column:
        t = byte(y - F.shiftright(signed(cg), 1))
        b = byte(t - F.shiftright(signed(co), 1))
        return F.array(byte(b + co), byte(cg + t), b)

    return _triples(a, f)


def predict(a: Column, width: Column, channels: int = 3, median: bool = True) -> Column:
    """Residuals against the left neighbour, or the median edge detector of left, above and upper left.

    At the left border the value above stands for the left one, in the first row the left one for the others; the first pixel is
    predicted as 0.
    """
    row = width * channels

    def f(i: Column) -> Column:
        x, y = i % row, F.floor(i / row)
        above = F.get(a, (i - row).cast("int"))
        left = F.when(x >= channels, F.get(a, (i - channels).cast("int"))).when(y > 0, above).otherwise(F.lit(0))
        if not median:
            return byte(F.get(a, i) - left)
        up = F.when(y > 0, above).otherwise(left)
        corner = F.when((x >= channels) & (y > 0), F.get(a, (i - row - channels).cast("int"))).otherwise(F.when(y > 0, left).otherwise(up))
        high, low = F.greatest(left, up), F.least(left, up)
        return byte(F.get(a, i) - F.when(corner >= high, low).when(corner <= low, high).otherwise(left + up - corner))

    return each(a, f)


def to_planar(a: Column, channels: int = 3) -> Column:
    n = F.floor(F.size(a) / channels)
    return each(a, lambda j: F.get(a, ((j % n) * channels + F.floor(j / n)).cast("int")))


def from_planar(a: Column, channels: int = 3) -> Column:
    n = F.floor(F.size(a) / channels)
    return each(a, lambda j: F.get(a, ((j % channels) * n + F.floor(j / channels)).cast("int")))


def delta(a: Column, before: Column) -> Column:
    return F.zip_with(a, before, lambda x, y: byte(x - y))


def undo_delta(a: Column, before: Column) -> Column:
    return F.zip_with(a, before, lambda x, y: byte(x + y))


def xor(a: Column, before: Column) -> Column:
    return F.zip_with(a, before, lambda x, y: x.bitwiseXOR(y))


def pixel(a: Column, p: Column) -> Column:
    return F.struct(F.get(a, (p * 3).cast("int")).alias("r"), F.get(a, (p * 3 + 1).cast("int")).alias("g"), F.get(a, (p * 3 + 2).cast("int")).alias("b"))


def neighbour_codes(a: Column, width: Column, far: bool = True) -> Column:
    """Which neighbour a pixel equals, the first that does: 1 left, 2 above, and if ``far`` 3 upper left, 4 upper right; else 0."""
    n = F.floor(F.size(a) / 3)

    def f(p: Column) -> Column:
        x, y = p % width, F.floor(p / width)
        own = pixel(a, p)
        c = F.when((x > 0) & (own == pixel(a, p - 1)), 1).when((y > 0) & (own == pixel(a, p - width)), 2)
        if far:
            c = c.when((x > 0) & (y > 0) & (own == pixel(a, p - width - 1)), 3).when((y > 0) & (x < width - 1) & (own == pixel(a, p - width + 1)), 4)
        return c.otherwise(0)

    return F.transform(indices(n), f)


def zero_matched(a: Column, codes: Column) -> Column:
    """Pixels that equal a neighbour, set to 0."""
    return each(a, lambda i: F.when(F.get(codes, F.floor(i / 3).cast("int")) > 0, F.lit(0)).otherwise(F.get(a, i)))


def palette(a: Column) -> Column:
    """Sorted distinct colours, as 24-bit numbers."""
    n = F.floor(F.size(a) / 3)
    return F.array_sort(F.array_distinct(F.transform(indices(n), lambda p: F.get(a, p * 3) * 65536 + F.get(a, p * 3 + 1) * 256 + F.get(a, p * 3 + 2))))


def palette_index(a: Column, colours: Column) -> Column:
    n = F.floor(F.size(a) / 3)
    return F.transform(indices(n), lambda p: (F.array_position(colours, F.get(a, p * 3) * 65536 + F.get(a, p * 3 + 1) * 256 + F.get(a, p * 3 + 2)) - 1).cast("int"))


def palette_decode(index: Column, colours: Column) -> Column:
    return F.flatten(F.transform(index, lambda k: F.array(F.floor(F.get(colours, k) / 65536).cast("int"), (F.floor(F.get(colours, k) / 256) % 256).cast("int"), (F.get(colours, k) % 256).cast("int"))))


def pointer_bits(colours: Column) -> Column:
    """Bits of a pointer into a palette: 1 at least."""
    n = F.size(colours)
    return F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))
