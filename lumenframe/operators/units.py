"""Quantities in different units, brought to one unit.

Conversions are edges of a graph, each an affine function y = a·x + b.  Shortest compositions between all pairs are
worked out once on the driver (the graph is a constant), every cycle is checked to compose to the identity,
and the data are equi-joined on source unit and target unit.

Defined results: a null or non-finite value, an unknown unit or a unit of another dimension give a null result; a
unit code that is unknown gives way to the meaning, then to a unit in brackets at the end of the label, then to a unit named
in the free text.
"""

from __future__ import annotations

import re
from collections import deque
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Physical definitions, (source, target, factor, offset).
CONVERSIONS = [
    ("V", "mV", 1e3, 0.0), ("mV", "uV", 1e3, 0.0), ("uV", "nV", 1e3, 0.0), ("V", "uV", 1e6, 0.0), ("kV", "V", 1e3, 0.0),
    ("kPa", "Pa", 1e3, 0.0), ("mbar", "Pa", 1e2, 0.0), ("bar", "mbar", 1e3, 0.0), ("kPa", "mbar", 10.0, 0.0),
    ("mm[Hg]", "Pa", 133.322387415, 0.0), ("cm[H2O]", "Pa", 98.0665, 0.0), ("cm[H2O]", "mm[Hg]", 98.0665 / 133.322387415, 0.0),
    ("[psi]", "Pa", 6894.757293168, 0.0),
    ("L/s", "mL/s", 1e3, 0.0), ("L/min", "L/s", 1 / 60, 0.0), ("L/min", "mL/s", 1e3 / 60, 0.0), ("mL/min", "mL/s", 1 / 60, 0.0), ("L/h", "L/min", 1 / 60, 0.0),
    ("Cel", "K", 1.0, 273.15), ("[degF]", "Cel", 5 / 9, -160 / 9), ("[degF]", "K", 5 / 9, 459.67 * 5 / 9),
    ("s", "ms", 1e3, 0.0), ("ms", "us", 1e3, 0.0), ("Hz", "kHz", 1e-3, 0.0), ("m", "cm", 1e2, 0.0), ("cm", "mm", 10.0, 0.0), ("A", "mA", 1e3, 0.0), ("mA", "uA", 1e3, 0.0),
]

# Spellings of units, compared without case once µ and μ are written u.
SPELLINGS = {
    "V": ["v", "volt", "volts"], "mV": ["mv", "millivolt", "millivolts", "milli-volt"], "uV": ["uv", "microvolt", "microvolts"], "nV": ["nv", "nanovolt", "nanovolts"], "kV": ["kv", "kilovolt"],
    "Pa": ["pa", "pascal", "pascals"], "kPa": ["kpa", "kilopascal", "kilopascals"], "mbar": ["mbar", "millibar", "hpa", "hectopascal"], "bar": ["bar"], "[psi]": ["psi", "[psi]"],
    "mm[Hg]": ["mm[hg]", "mmhg", "mm hg", "torr", "millimeter of mercury", "millimetre of mercury", "millimeters of mercury"], "cm[H2O]": ["cm[h2o]", "cmh2o", "cm h2o", "centimeter of water"],
    "mL/s": ["ml/s", "ml/sec", "cc/s", "millilitres per second", "milliliters per second"], "L/s": ["l/s", "l/sec", "litres per second", "liters per second"],
    "L/min": ["l/min", "lpm", "litres per minute", "liters per minute"], "mL/min": ["ml/min"], "L/h": ["l/h"],
    "Cel": ["cel", "°c", "degc", "celsius"], "[degF]": ["[degf]", "°f", "degf", "fahrenheit"], "K": ["k", "kelvin"],
    "s": ["s", "sec", "second", "seconds"], "ms": ["ms", "millisecond", "milliseconds"], "us": ["us", "microsecond"], "Hz": ["hz", "hertz"], "kHz": ["khz"],
    "m": ["m"], "cm": ["cm"], "mm": ["mm"], "A": ["a"], "mA": ["ma"], "uA": ["ua"],
}


def compositions(conversions: list[tuple[str, str, float, float]] = CONVERSIONS, tolerance: float = 1e-9) -> dict[tuple[str, str], tuple[float, float]]:
    """Shortest composition for every connected pair; raises ValueError where two ways disagree."""
    graph: dict[str, dict[str, tuple[float, float]]] = {}
    for source, target, a, b in conversions:
        graph.setdefault(source, {})[target] = (a, b)
        graph.setdefault(target, {})[source] = (1 / a, -b / a)
    pairs: dict[tuple[str, str], tuple[float, float]] = {}
    for start in graph:
        pairs[start, start] = (1.0, 0.0)
        queue = deque([start])
        while queue:
            unit = queue.popleft()
            a, b = pairs[start, unit]
            for following, (c, d) in graph[unit].items():
                way = (c * a, c * b + d)
                if (start, following) not in pairs:
                    pairs[start, following] = way
                    queue.append(following)
                known = pairs[start, following]
                if abs(way[0] - known[0]) > tolerance * abs(known[0]) or abs(way[1] - known[1]) > tolerance * max(1.0, abs(known[1])):
                    raise ValueError(f"conversions from {start} to {following} disagree: {way} and {known}")
    return pairs


@cache
def dimensions() -> dict[str, str]:
    """Unit to the first unit, in order of the alphabet, that it can be converted to: the name of its dimension."""
    found: dict[str, str] = {}
    for source, target in sorted(compositions()):
        found.setdefault(source, target)
    return found


def conversion_table(spark: SparkSession) -> DataFrame:
    """(source_unit, target_unit, factor, shift): constant, a few hundred rows."""
    return spark.createDataFrame([(s, t, a, b) for (s, t), (a, b) in compositions().items()], "source_unit string, target_unit string, factor double, shift double")


def _spelt() -> dict[str, str]:
    return {spelling: unit for unit, spellings in SPELLINGS.items() for spelling in spellings}


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.translate(text, "µμ", "uu")))


def unit_of(text: Column) -> Column:
    """Canonical unit of a code or phrase, null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in _spelt().items() for x in pair])
    return F.try_element_at(table, _plain(text))


def dimension_of(unit: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in dimensions().items() for x in pair]), unit)


def unit_in_label(label: Column) -> Column:
    """Canonical unit that a label ends with in brackets, null if unknown; the unit's own spelling may hold brackets."""
    inside = F.regexp_extract(label, r"[\[(]\s*([^()]*?)\s*[\])]\s*$", 1)
    return F.coalesce(unit_of(inside), unit_of(F.regexp_extract(label, r"[\[(]\s*([^\[\]()]*?)\s*[\])]\s*$", 1)))


def _text_pattern() -> str:
    units = "|".join(re.escape(s).replace(r"\ ", " ?") for s in sorted(_spelt(), key=lambda s: (-len(s), s)))
    return rf"([-+]?[0-9]+(?:[.,][0-9]+)?(?:e[-+]?[0-9]+)?)\s*({units})(?=/(?:lsb|bit|step|count)\b| per (?:bit|lsb|step|count)\b|[^a-z0-9/\[]|$)"


def quantities_in_text(text: Column) -> Column:
    """All (value, unit) of a free text, numbers that a known unit follows, in order; a comma counts as the decimal point."""
    pattern = _text_pattern()
    plain = _plain(text)
    numbers, units = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2))
    return F.zip_with(numbers, units, lambda n, u: F.struct(F.regexp_replace(n, ",", ".").try_cast("double").alias("value"), unit_of(u).alias("unit")))


def unit_in_text(text: Column) -> Column:
    """The one known unit that a free text names apart from numbers, null if none or several; single letters and ordinals are no units."""
    units = "|".join(re.escape(s).replace(r"\ ", " ?") for s in sorted(_spelt(), key=lambda s: (-len(s), s)) if len(s) > 1 and s != "second")
    found = F.array_distinct(F.transform(F.regexp_extract_all(_plain(text), F.lit(rf"(?<![a-z0-9/\[.,°-])({units})(?![a-z0-9\[-])(?!/(?!(?:lsb|bit|step|count)\b))"), F.lit(1)), unit_of))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def channel_values(channels: DataFrame, target: str | None = None) -> DataFrame:
    """Add ``found_value`` and ``found_unit`` of the sensitivity: from its own columns, else from label and derivation text.

    The unit comes from the code, else from the meaning, the label, the text.  Value and unit are completed separately: a value
    without known unit takes the text's unit only if the text gives no other value, and a bare unit takes no value from a text
    in which another unit is named.  Of several quantities of a text the last counts; those of another dimension than the unit in the
    column ``target``, as a sampling rate, are none.
    """
    own_unit = F.coalesce(unit_of(F.col("sensitivity_units_code")), unit_of(F.col("sensitivity_units_meaning")))
    fits = lambda unit: F.lit(True) if target is None else F.coalesce(dimension_of(unit) == dimension_of(F.col(target)), F.col(target).isNull())
    told = F.filter(quantities_in_text(F.col("derivation_description")), lambda q: fits(q["unit"]))
    named = unit_in_text(F.col("derivation_description"))
    label = unit_in_label(F.col("label")) if "label" in channels.columns else F.lit(None).cast("string")
    df = channels.withColumns({"_own_unit": F.coalesce(own_unit, F.when(fits(label), label)), "_told": F.element_at(F.when(F.size(told) > 0, told), -1), "_named": F.when(fits(named), named)})
    whole = F.col("sensitivity").isNotNull() & ~F.isnan("sensitivity")
    from_text = ~whole & F.col("_told.value").isNotNull() & (F.col("_own_unit").isNull() | (F.col("_own_unit") == F.col("_told.unit")))
    same = F.abs(F.col("_told.value") - F.col("sensitivity")) <= 1e-9 * F.abs("sensitivity")
    text_unit = F.when(F.col("_told.value").isNull(), F.col("_named")).when(same, F.col("_told.unit"))
    df = df.withColumns(
        {
            "found_value": F.when(whole, F.col("sensitivity")).when(from_text, F.col("_told.value")),
            "found_unit": F.when(whole, F.coalesce("_own_unit", text_unit)).when(from_text, F.col("_told.unit")),
        }
    )
    return df.drop("_own_unit", "_told", "_named")


def to_nominal_units(channels: DataFrame, nominals: DataFrame) -> DataFrame:
    """Channel columns plus ``common_value`` (sensitivity × correction factor) in ``nominal_unit``, and ``nominal``.

    ``nominals`` is the clean reference of a few dozen rows: one per device model and channel source.
    """
    reference = nominals.groupBy("device_model", "source_code_value").agg(F.min(F.struct("nominal", "nominal_unit")).alias("_n"))
    df = channels.join(reference, ["device_model", "source_code_value"], "left")
    df = df.withColumns({"nominal": F.col("_n.nominal"), "nominal_unit": F.col("_n.nominal_unit"), "_target": unit_of(F.col("_n.nominal_unit"))}).drop("_n")
    df = channel_values(df, "_target")
    ways = conversion_table(channels.sparkSession).withColumnsRenamed({"source_unit": "found_unit", "target_unit": "_target"})
    df = df.join(F.broadcast(ways), ["found_unit", "_target"], "left")
    raw = F.col("found_value") * F.coalesce("sensitivity_correction_factor", F.lit(1.0))
    return df.withColumn("common_value", raw * F.col("factor") + F.col("shift")).select(*channels.columns, "found_value", "found_unit", "common_value", "nominal", "nominal_unit")


def off_nominal(converted: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Channels whose value differs from the nominal by more than the tolerance."""
    differs = F.abs(F.col("common_value") - F.col("nominal")) > tolerance * F.abs("nominal")
    return converted.where(differs & F.col("channel_id").isNotNull()).select("channel_id").distinct()
