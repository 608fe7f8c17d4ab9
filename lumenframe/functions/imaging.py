"""Pixel arithmetic as Column functions: scalars per stored value, and row-major arrays per small image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- grey levels --------------------------------------------------------------------------------------------


def rescale(stored: Column, slope: Column | float, intercept: Column | float) -> Column:
    """Modality transform intercept + slope · v."""
    return stored * slope + intercept


def voi_linear(x: Column, center: float, width: float) -> Column:
    """LINEAR window of the standard, to 0..1; a width of 1 is a threshold."""
    if width <= 1:
        return F.when(x <= center - 0.5, 0.0).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - (center - 0.5)) / (width - 1) + 0.5))


def voi_linear_exact(x: Column, center: float, width: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - center) / width + 0.5))


def voi_sigmoid(x: Column, center: float, width: float) -> Column:
    return 1 / (1 + F.exp(-4 * (x - center) / width))


def default_window(least: Column, most: Column) -> Column:
    """``struct<center,width>`` that covers an image."""
    return F.struct(((least + most) / 2).alias("center"), (most - least).alias("width"))


def to_byte(level: Column) -> Column:
    """0..1 to 0..255, rounded half up and clamped."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(level * 255 + 0.5))).cast("int")


def lut(stored: Column, first: int, table: list[int]) -> Column:
    """Look-up with the index clamped to the table."""
    at = F.least(F.greatest(stored - first, F.lit(0)), F.lit(len(table) - 1)).cast("int")
    return F.get(F.array(*[F.lit(v) for v in table]), at)


def invert(stored: Column, most: Column | int | None) -> Column:
    """MONOCHROME1 to 2 and back: max - v, or -v - 1 of signed values."""
    return -stored - 1 if most is None else most - stored


# -- colour -------------------------------------------------------------------------------------------------


def _clamp8(x: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("int")


def rgb_to_ybr(r: Column, g: Column, b: Column) -> Column:
    """``struct<y,cb,cr>``, BT.601 full range of 8 bits."""
    return F.struct(
        _clamp8(0.299 * r + 0.587 * g + 0.114 * b).alias("y"),
        _clamp8(-0.168736 * r - 0.331264 * g + 0.5 * b + 128).alias("cb"),
        _clamp8(0.5 * r - 0.418688 * g - 0.081312 * b + 128).alias("cr"),
    )


def ybr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    return F.struct(
        _clamp8(y + 1.402 * (cr - 128)).alias("r"),
        _clamp8(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)).alias("g"),
        _clamp8(y + 1.772 * (cb - 128)).alias("b"),
    )


def halve_chroma(row: Column) -> Column:
    """YBR_FULL_422: each pair of chroma values becomes its mean, the last of an odd row stands alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(row) + 1) / 2).cast("int") - 1)
    second = lambda i: F.coalesce(F.get(row, i * 2 + 1), F.get(row, i * 2))
    return F.transform(pairs, lambda i: F.floor((F.get(row, i * 2) + second(i)) / 2 + 0.5).cast("int"))


def palette(index: Column, red: list[int], green: list[int], blue: list[int], first: int = 0) -> Column:
    return F.struct(lut(index, first, red).alias("r"), lut(index, first, green).alias("g"), lut(index, first, blue).alias("b"))


# -- geometry of row-major arrays ---------------------------------------------------------------------------


def crop(pixels: Column, columns: int, x: int, y: int, width: int, height: int) -> Column:
    """A rectangle; width or height of 0 or less count from the far edge of an image with ``columns`` columns."""
    rows = F.floor(F.size(pixels) / columns).cast("int")
    w = width if width > 0 else columns - x + width
    h = F.lit(height) if height > 0 else rows - y + height
    return F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.slice(pixels, (i + y) * columns + x + 1, F.lit(w))))


def black_out(pixels: Column, columns: int, x: int, y: int, width: int, height: int, black: Column) -> Column:
    """A rectangle set to black."""
    inside = lambda i: (i % columns).between(x, x + width - 1) & F.floor(i / columns).between(y, y + height - 1)
    return F.transform(pixels, lambda p, i: F.when(inside(i), black).otherwise(p))


def _moved(pixels: Column, source: object) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(pixels) - 1), lambda i: F.get(pixels, source(i).cast("int")))  # type: ignore[operator]


def flip_horizontal(pixels: Column, columns: int) -> Column:
    return _moved(pixels, lambda i: F.floor(i / columns) * columns + (columns - 1 - i % columns))


def flip_vertical(pixels: Column, columns: int) -> Column:
    rows = F.size(pixels) / columns
    return _moved(pixels, lambda i: (rows - 1 - F.floor(i / columns)) * columns + i % columns)


def rotate_90(pixels: Column, columns: int) -> Column:
    """Clockwise; the result has as many columns as the image had rows."""
    rows = F.size(pixels) / columns
    return _moved(pixels, lambda i: (rows - 1 - i % rows) * columns + F.floor(i / rows))


def rotate_180(pixels: Column) -> Column:
    return F.reverse(pixels)


def rotate_270(pixels: Column, columns: int) -> Column:
    rows = F.size(pixels) / columns
    return _moved(pixels, lambda i: (i % rows) * columns + (columns - 1 - F.floor(i / rows)))


def overlay_bit(word: Column, bit: int) -> Column:
    return F.shiftright(word, bit).bitwiseAND(F.lit(1)) == 1


def clamp_rect(x: Column, y: Column, width: Column, height: Column, columns: int, rows: int) -> Column:
    """``struct<x,y,width,height>`` of a rectangle cut to the image."""
    left, top = F.least(F.greatest(x, F.lit(0)), F.lit(columns)), F.least(F.greatest(y, F.lit(0)), F.lit(rows))
    right, bottom = F.least(F.greatest(x + width, F.lit(0)), F.lit(columns)), F.least(F.greatest(y + height, F.lit(0)), F.lit(rows))
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"))


def expand_rect(x: Column, y: Column, width: Column, height: Column, amount: int) -> Column:
    """``struct<x,y,width,height>`` of a rectangle grown on all four sides, not beyond 0 and 65535."""
    most = F.lit(65_535)
    left, top = F.greatest(x - amount, F.lit(0)), F.greatest(y - amount, F.lit(0))
    return F.struct(left.alias("x"), top.alias("y"), F.least(F.least(width + (x - left), most) + amount, most).alias("width"), F.least(F.least(height + (y - top), most) + amount, most).alias("height"))


def statistics(values: Column) -> Column:
    """Struct of mean and standard deviation of an array of numbers, null of an empty one; one pass each for sum and squares."""
    n = F.nullif(F.size(values), F.lit(0))
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("xx")), lambda s, e: F.struct((s["x"] + e).alias("x"), (s["xx"] + e * e).alias("xx")))
    mean = sums["x"] / n
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(sums["xx"] / n - mean * mean, F.lit(0.0))).alias("sd"))
