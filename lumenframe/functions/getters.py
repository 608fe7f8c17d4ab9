"""Values of elements by type, as Column functions over the columns ``vr``, ``values_json`` and ``inline_binary``.

A getter gives null where the value representation is not of its type, where a value cannot be read, and, of those for one value, where there
are none or several.  Getters for many give an empty array for an element without values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S

# Fixed values of the standard: the representations that each getter reads.
STRING, INT, BIG, FLOAT = ["AE", "CS", "LO", "LT", "SH", "ST", "UC", "UI", "UR", "UT"], ["IS", "SL", "SS", "UL", "US"], ["SV", "UV"], ["DS", "FD", "FL"]


def _texts() -> Column:
    return F.coalesce(F.from_json(F.col("values_json"), "array<string>"), F.array().cast("array<string>"))


def _of(kinds: list[str], found: Column) -> Column:
    return F.when(F.col("vr").isin(kinds), found)


def _all(texts: Column, read: Callable[[Column], Column]) -> Column:
    """Every value read, null if one of them cannot be; nulls among the values are dropped."""
    held = F.filter(texts, lambda t: t.isNotNull())
    found = F.transform(held, read)
    return F.when(~F.exists(found, lambda v: v.isNull()), found)


def one(found: Column) -> Column:
    """The only value of an array."""
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def strings() -> Column:
    return _of(STRING, F.transform(_texts(), lambda t: F.coalesce(t, F.lit(""))))


def string() -> Column:
    return one(strings())


def ints() -> Column:
    return _of(INT, _all(_texts(), lambda t: F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint"))))


def int_() -> Column:
    return one(ints())


def big_ints() -> Column:
    """64-bit values; unsigned ones need more than a bigint has."""
    return _of(BIG, _all(_texts(), lambda t: F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("decimal(20,0)"))))


def big_int() -> Column:
    return one(big_ints())


def floats() -> Column:
    return _of(FLOAT, _all(_texts(), lambda t: t.try_cast("double")))


def float_() -> Column:
    return one(floats())


def age() -> Column:
    return _of(["AS"], S.age(one(_texts())))


def date() -> Column:
    return _of(["DA"], S.date_parts(one(_texts())))


def time() -> Column:
    return _of(["TM"], S.time_parts(one(_texts())))


def date_time() -> Column:
    return _of(["DT"], S.datetime_parts(one(_texts())))


def person_names() -> Column:
    """Array of the groups of each name, with their components."""
    kind = "array<struct<Alphabetic:string,Ideographic:string,Phonetic:string>>"
    groups = F.coalesce(F.from_json(F.col("values_json"), kind), F.from_json(F.lit("[]"), kind))
    found = F.transform(groups, lambda p: F.struct(S.name_components(p["Alphabetic"]).alias("alphabetic"), S.name_components(p["Ideographic"]).alias("ideographic"), S.name_components(p["Phonetic"]).alias("phonetic")))
    return _of(["PN"], found)


def person_name() -> Column:
    return one(person_names())


def attribute_tags() -> Column:
    """Tags as numbers."""
    return _of(["AT"], _all(_texts(), lambda t: F.when(t.rlike("^[0-9A-Fa-f]{8}$"), F.conv(t, 16, 10).cast("bigint"))))


def attribute_tag() -> Column:
    return one(attribute_tags())


def bytes_() -> Column:
    return _of(["OB", "OD", "OF", "OL", "OV", "OW", "UN"], F.col("inline_binary"))


def lut_descriptor() -> Column:
    """``struct<entries,first,bits>`` of three numbers; 0 entries mean 65536."""
    found = ints()
    entries = F.get(found, F.lit(0))
    return F.when(F.size(found) == 3, F.struct(F.when(entries == 0, 65_536).otherwise(entries).alias("entries"), F.get(found, F.lit(1)).alias("first"), F.get(found, F.lit(2)).alias("bits")))
