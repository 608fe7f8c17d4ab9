"""Scalar Column functions over DICOM values; all run in the JVM inside whole-stage code.

Every function gives null for null and for text that its value representation does not allow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- tags ---------------------------------------------------------------------------------------------------


def tag_int(tag_hex: Column) -> Column:
    """Eight hexadecimal digits to (group << 16) | element."""
    return F.when(tag_hex.rlike("^[0-9A-Fa-f]{8}$"), F.conv(tag_hex, 16, 10).cast("bigint"))


def tag_hex(tag: Column) -> Column:
    return F.lpad(F.hex(tag.cast("bigint")), 8, "0")


def tag_group(tag: Column) -> Column:
    return F.shiftright(tag.cast("bigint"), 16)


def tag_element(tag: Column) -> Column:
    return tag.cast("bigint").bitwiseAND(F.lit(0xFFFF))


def tag_text(tag: Column) -> Column:
    """(GGGG,EEEE)"""
    digits = tag_hex(tag)
    return F.concat(F.lit("("), F.substring(digits, 1, 4), F.lit(","), F.substring(digits, 5, 4), F.lit(")"))


def is_private(tag: Column) -> Column:
    return tag_group(tag).bitwiseAND(F.lit(1)) == 1


def is_private_creator(tag: Column) -> Column:
    return is_private(tag) & tag_element(tag).between(0x10, 0xFF)


def private_creator_tag(tag: Column) -> Column:
    """Tag of the creator element that reserves a private element's block, null for public ones."""
    block = F.shiftright(tag_element(tag), 8)
    return F.when(is_private(tag) & block.between(0x10, 0xFF), F.shiftleft(tag_group(tag), 16).bitwiseOR(block))


# -- paths --------------------------------------------------------------------------------------------------


def path_text(path: Column, tag: Column | None = None) -> Column:
    """``array<struct<tag,item>>`` as TAG/[i]/TAG."""
    steps = F.transform(path, lambda p: F.concat(p["tag"], F.lit("/["), p["item"].cast("string"), F.lit("]")))
    return F.array_join(steps if tag is None else F.concat(steps, F.array(tag)), "/")


def path_steps(text: Column) -> Column:
    """Steps of TAG/[i]/TAG as ``array<struct<tag,item>>``; a trailing tag is no step; null for other texts."""
    fine = text.rlike(r"^(?:[0-9A-Fa-f]{8}/\[[0-9]+\](?:/|$))*(?:[0-9A-Fa-f]{8})?$")
    pairs = F.regexp_extract_all(text, F.lit(r"([0-9A-Fa-f]{8}/\[[0-9]+\])"), F.lit(1))
    return F.when(fine, F.transform(pairs, lambda s: F.struct(F.upper(F.substring(s, 1, 8)).alias("tag"), F.regexp_extract(s, r"\[([0-9]+)\]", 1).cast("int").alias("item"))))


# -- strings ------------------------------------------------------------------------------------------------


def strip_padding(text: Column, vr: str) -> Column:
    """The padding of a value representation removed."""
    if vr == "UI":
        return F.rtrim(text, F.lit("\x00"))
    if vr == "CS":
        return F.trim(F.rtrim(text, F.lit("\x00")))
    if vr in ("AE", "UR", "LO", "SH", "UC", "DS", "IS"):
        return F.trim(text)
    return F.rtrim(text, F.lit(" \x00"))


def values(text: Column, vr: str) -> Column:
    """The values of a multi-valued string; text representations have one."""
    if vr in ("LT", "ST", "UT", "UR"):
        return F.array(strip_padding(text, vr))
    return F.transform(F.split(text, r"\\"), lambda s: strip_padding(s, vr))


def pad_even(text: Column, vr: str) -> Column:
    """Even length, padded with NUL for UI and a space otherwise."""
    filler = "\x00" if vr == "UI" else " "
    return F.when(F.octet_length(text) % 2 == 1, F.concat(text, F.lit(filler))).otherwise(text)


def ascii_only(text: Column) -> Column:
    """Every byte above 0x7F becomes a question mark."""
    return F.regexp_replace(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), r"[^\x00-\x7F]", "?")


def inline_binary(data: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(data), r"\s", "")


def byte_preview(data: Column, most: int = 16) -> Column:
    """The first bytes as [00 01 …]."""
    digits = F.regexp_replace(F.lower(F.hex(F.substring(data, 1, most))), "(..)(?=.)", "$1 ")
    return F.concat(F.lit("["), F.upper(digits), F.when(F.octet_length(data) > most, F.lit(" …")).otherwise(""), F.lit("]"))


# -- ages, dates, times -------------------------------------------------------------------------------------

AGE = "^([0-9]{3})([DWMY])$"


def age(text: Column) -> Column:
    """``struct<number,unit>`` of nnnD, nnnW, nnnM or nnnY."""
    clean = strip_padding(text, "AS")
    return F.when(clean.rlike(AGE), F.struct(F.regexp_extract(clean, AGE, 1).cast("int").alias("number"), F.regexp_extract(clean, AGE, 2).alias("unit")))


def age_words(text: Column) -> Column:
    """1 year, 2 years"""
    words = F.create_map(*[F.lit(x) for x in ("D", "day", "W", "week", "M", "month", "Y", "year")])
    parsed = age(text)
    return F.concat(parsed["number"].cast("string"), F.lit(" "), F.try_element_at(words, parsed["unit"]), F.when(parsed["number"] == 1, "").otherwise("s"))


def age_text(number: Column, unit: Column) -> Column:
    return F.when(number.between(0, 999) & unit.isin("D", "W", "M", "Y"), F.concat(F.lpad(number.cast("string"), 3, "0"), unit))


DATE = "^([0-9]{4})([0-9]{2})([0-9]{2})$"


def date_parts(text: Column) -> Column:
    """``struct<year,month,day>`` of YYYYMMDD, without a check against the calendar."""
    clean = strip_padding(text, "DA")
    part = lambda i: F.regexp_extract(clean, DATE, i).cast("int")
    return F.when(clean.rlike(DATE), F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day")))


def date_iso(text: Column) -> Column:
    clean = strip_padding(text, "DA")
    return F.when(clean.rlike(DATE), F.regexp_replace(clean, DATE, "$1-$2-$3"))


def date_value(text: Column) -> Column:
    """A calendar date, null if there is no such day."""
    return date_iso(text).try_cast("date")


def date_text(year: Column, month: Column, day: Column) -> Column:
    fine = year.between(0, 9999) & month.between(1, 12) & day.between(1, 31)
    return F.when(fine, F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


TIME = r"^([0-9]{2})(?:([0-9]{2})(?:([0-9]{2}(?:\.[0-9]{1,6})?))?)?$"


def _some(text: Column, pattern: str, group: int, kind: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast(kind)


def time_parts(text: Column) -> Column:
    """``struct<hour,minute,second>`` of HH[MM[SS[.F]]]; a leap second is allowed."""
    clean = strip_padding(text, "TM")
    hour, minute, second = _some(clean, TIME, 1, "int"), _some(clean, TIME, 2, "int"), _some(clean, TIME, 3, "double")
    fine = clean.rlike(TIME) & (hour <= 23) & F.coalesce(minute <= 59, F.lit(True)) & F.coalesce(second < 61, F.lit(True))
    return F.when(fine, F.struct(hour.alias("hour"), minute.alias("minute"), second.alias("second")))


def time_iso(text: Column) -> Column:
    """HH[:MM[:SS[.F]]] with the precision of the value; trailing zeros of the fraction are dropped."""
    clean = strip_padding(text, "TM")
    part = lambda i: F.nullif(F.regexp_extract(clean, TIME, i), F.lit(""))
    second = F.when(part(3).contains("."), F.regexp_replace(part(3), r"\.?0*$", "")).otherwise(part(3))
    return F.when(clean.rlike(TIME), F.concat_ws(":", part(1), part(2), second))


def second_text(second: Column) -> Column:
    """Seconds as SS[.F]: two digits, then up to six of the fraction without trailing zeros."""
    micros = F.round(second * 1_000_000).cast("bigint")
    fraction = F.regexp_replace(F.lpad((micros % 1_000_000).cast("string"), 6, "0"), "0+$", "")
    whole = F.lpad(F.floor(micros / 1_000_000).cast("string"), 2, "0")
    return F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def time_text(hour: Column, minute: Column | None = None, second: Column | None = None) -> Column:
    """HH[MM[SS[.F]]]; null for impossible parts."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minute = F.lit(None).cast("int") if minute is None else minute
    second = F.lit(None).cast("double") if second is None else second
    fine = hour.between(0, 23) & F.coalesce(minute.between(0, 59), F.lit(True)) & F.coalesce((second >= 0) & (second <= 60), F.lit(True))
    return F.when(fine, F.concat(two(hour), F.coalesce(two(minute), F.lit("")), F.when(minute.isNotNull(), F.coalesce(second_text(second), F.lit(""))).otherwise("")))


DATETIME = r"^([0-9]{4})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2}(?:\.[0-9]{1,6})?))?)?)?)?)?([+-][0-9]{4})?$"


def datetime_parts(text: Column) -> Column:
    """``struct<year,month,day,hour,minute,second,offset_minutes>`` of YYYY[MM[DD[HH[MM[SS[.F]]]]]][&ZZXX]; offsets -1200 to +1400."""
    clean = strip_padding(text, "DT")
    number = lambda i: _some(clean, DATETIME, i, "int")
    zone = _some(clean, DATETIME, 7, "string")
    size = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")
    offset = F.when(F.substring(zone, 1, 1) == "-", -size).otherwise(size)
    fine = clean.rlike(DATETIME) & F.coalesce((F.substring(zone, 4, 2).cast("int") < 60) & offset.between(-720, 840), F.lit(True))
    names = ["year", "month", "day", "hour", "minute"]
    return F.when(fine, F.struct(*[number(i + 1).alias(n) for i, n in enumerate(names)], _some(clean, DATETIME, 6, "double").alias("second"), offset.alias("offset_minutes")))


def datetime_iso(text: Column) -> Column:
    """ISO 8601 with the precision of the value."""
    clean = strip_padding(text, "DT")
    ok = datetime_parts(text).isNotNull()
    part = lambda i: F.nullif(F.regexp_extract(clean, DATETIME, i), F.lit(""))
    second = F.when(part(6).contains("."), F.regexp_replace(part(6), r"\.?0*$", "")).otherwise(part(6))
    zone = part(7)
    clock = F.nullif(F.concat_ws(":", part(4), part(5), second), F.lit(""))
    return F.when(ok, F.concat(F.concat_ws("T", F.concat_ws("-", part(1), part(2), part(3)), clock), F.coalesce(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)), F.lit(""))))


# -- names, numbers, identifiers ----------------------------------------------------------------------------

NAME_PARTS = ["last_name", "first_name", "middle_name", "prefix", "suffix"]
NAME_GROUPS = ["alphabetic", "ideographic", "phonetic"]


def name_components(group: Column) -> Column:
    """``struct<last_name,first_name,middle_name,prefix,suffix>`` of a^b^c^d^e; empty parts are empty texts."""
    parts = F.split(group, r"\^")
    part = lambda i: F.coalesce(F.rtrim(F.get(parts, F.lit(i))), F.lit(""))
    return F.when(F.size(parts) <= 5, F.struct(*[part(i).alias(n) for i, n in enumerate(NAME_PARTS)]))


def person_name(text: Column) -> Column:
    """``struct<alphabetic,ideographic,phonetic>`` of groups parted by =; absent groups are null."""
    groups = F.split(F.rtrim(text), "=")
    group = lambda i: F.nullif(F.get(groups, F.lit(i)), F.lit(""))
    return F.when(F.size(groups) <= 3, F.struct(*[F.when(group(i).isNotNull(), name_components(group(i))).alias(n) for i, n in enumerate(NAME_GROUPS)]))


def name_text(components: Column) -> Column:
    """The parts joined by ^ without trailing separators; null if a part is too long or holds a separator."""
    parts = [F.coalesce(components[n], F.lit("")) for n in NAME_PARTS]
    fine = F.lit(True)
    for p in parts:
        fine = fine & (F.length(p) <= 64) & ~p.rlike(r"[\^=\\]")
    return F.when(fine, F.regexp_replace(F.concat_ws("^", *parts), r"\^+$", ""))


def integers(text: Column) -> Column:
    """IS values as 32-bit integers; empty ones are dropped, a value that is none makes the whole null."""
    found = F.filter(values(text, "IS"), lambda s: s != "")
    numbers = F.transform(found, lambda s: F.when(s.rlike("^[+-]?[0-9]{1,12}$"), s.try_cast("int")))
    return F.when(~F.exists(numbers, lambda n: n.isNull()), numbers)


def decimals(text: Column) -> Column:
    """DS values as doubles; empty ones are dropped, a value that is none makes the whole null."""
    found = F.filter(values(text, "DS"), lambda s: s != "")
    numbers = F.transform(found, lambda s: F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double")))
    return F.when(~F.exists(numbers, lambda n: n.isNull()), numbers)


UID = r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*$"


def is_uid(text: Column) -> Column:
    return F.length(text).between(1, 64) & text.rlike(UID)


def uid_from(*keys: Column, prefix: str = "2.25") -> Column:
    """A valid UID made from a hash of the keys, the same for the same keys."""
    digits = F.conv(F.substring(F.sha2(F.to_json(F.struct(*keys)), 256), 1, 15), 16, 10)
    more = F.conv(F.substring(F.sha2(F.to_json(F.struct(*keys)), 256), 16, 15), 16, 10)
    return F.concat(F.lit(prefix + ".1"), F.lpad(digits, 19, "0"), F.lpad(more, 19, "0"))


# Fixed values of the standard: most bytes of a value, what they must be a multiple of, and most characters of each string.
LENGTHS = {
    "AE": (16, 1, None), "AS": (4, 1, None), "AT": (0xFFFC, 4, None), "CS": (0xFFFE, 1, 16), "DA": (8, 1, None), "DS": (0xFFFE, 1, 16), "DT": (26, 1, None), "FD": (0xFFF8, 8, None), "FL": (0xFFFC, 4, None),
    "IS": (0xFFFE, 1, 12), "LO": (0xFFFE, 1, 64), "LT": (0xFFFE, 1, 10_240), "OB": (0xFFFFFFFE, 2, None), "OD": (0xFFFFFFF8, 8, None), "OF": (0xFFFFFFFC, 4, None), "OL": (0xFFFFFFFC, 4, None),
    "OV": (0xFFFFFFF8, 8, None), "OW": (0xFFFFFFFE, 2, None), "PN": (0xFFFE, 1, 324), "SH": (0xFFFE, 1, 16), "SL": (0xFFFC, 4, None), "SQ": (0, 1, None), "SS": (0xFFFE, 2, None), "ST": (0xFFFE, 1, 1_024),
    "SV": (0xFFFFFFF8, 8, None), "TM": (14, 1, None), "UC": (0xFFFFFFFE, 1, None), "UI": (0xFFFE, 1, 64), "UL": (0xFFFC, 4, None), "UN": (0xFFFFFFFE, 1, None), "UR": (0xFFFFFFFE, 1, None), "US": (0xFFFE, 2, None),
    "UT": (0xFFFFFFFE, 1, None), "UV": (0xFFF8, 8, None),
}


def length_fits(vr: Column, n_bytes: Column, n_characters: Column) -> Column:
    """Whether the bytes of a value and the characters of its longest string are allowed; null for an unknown representation."""
    limits = F.create_map(*[x for k, (most, step, chars) in LENGTHS.items() for x in (F.lit(k), F.struct(F.lit(most).cast("bigint").alias("most"), F.lit(step).alias("step"), F.lit(chars).cast("int").alias("chars")))])
    limit = F.try_element_at(limits, vr)
    return F.when(limit.isNotNull(), (n_bytes <= limit["most"]) & (n_bytes % limit["step"] == 0) & (limit["chars"].isNull() | n_characters.isNull() | (n_characters <= limit["chars"])))


def multiplicity_fits(n: Column, least: Column | int, most: Column | int | None) -> Column:
    """Whether n values are allowed; no upper bound where ``most`` is None."""
    fits = n >= least
    return fits if most is None else fits & (n <= most)


def multiplicity_text(least: Column, most: Column) -> Column:
    """1, 1-3 or 1-n"""
    return F.when(most.isNull(), F.concat(least.cast("string"), F.lit("-n"))).when(least == most, least.cast("string")).otherwise(F.concat_ws("-", least.cast("string"), most.cast("string")))


def bits_swapped(data: Column, width: int) -> Column:
    """Byte order of every ``width`` bytes reversed, on the hexadecimal digits."""
    pattern = "".join("(..)" for _ in range(width))
    return F.unhex(F.regexp_replace(F.hex(data), pattern, "".join(f"${i}" for i in range(width, 0, -1))))
