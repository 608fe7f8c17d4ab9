"""Mixed timestamp notations and time zones, normalised to UTC instants.

A value is read into wall-clock microseconds plus, where it states one, an offset or a zone.
What the value says counts first, then the separate offset column, then the zone of the
station.  Stations without a registered zone get the offset history (of all that this system knows,
not one offset) under which the fewest of their local stamps contradict the time of arrival.

Defined results: null, blank, unreadable and incomplete values (no hour and minute), impossible
dates and wall-clock times that a zone has twice or never give a null instant.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

# Abbreviations of zones with one meaning in the archive, minutes east of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "AWST": 480, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

# English month names of RFC 2822 dates.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

CLOCK = r"([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?"
ZONE = r"\s*(Z|z|[+-][0-9]{2}:?[0-9]{2}|[A-Z]{2,5})?(?:\[([A-Za-z0-9_+/-]+)\])?"
ISO = rf"^([0-9]{{4}})[-/]([0-9]{{2}})[-/]([0-9]{{2}})[T ]{CLOCK}{ZONE}$"
LOCAL = rf"^([0-9]{{2}})[./]([0-9]{{2}})[./]([0-9]{{4}})[T ]{CLOCK}(?:\s*([AaPp])[Mm])?$"
MAIL = rf"^(?:[A-Za-z]{{3}}, ?)?([0-9]{{1,2}}) ([A-Z][a-z]{{2}}) ([0-9]{{4}}) {CLOCK}\s*([+-][0-9]{{4}}|[A-Z]{{2,5}})?$"
COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})(?:([0-9]{2})(?:\.([0-9]{1,9}))?)?([+-][0-9]{4})?$"
DATE = r"^([0-9]{4})([.-]?)([0-9]{2})\2([0-9]{2})$"
TIME = r"^([0-9]{2}):?([0-9]{2})(?::?([0-9]{2})(?:\.([0-9]{1,9}))?)?$"
EPOCH = r"^([0-9]{1,19})(?:\.([0-9]{1,9}))?$"


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator of one row.

    Catalyst merges adjacent projections; where an expression is used several times by the next one, the
    merged code grows beyond what can be compiled.  A generator is not merged, so each stage runs once a row.
    """
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _spread(text: Column, pattern: str, groups: str) -> Column:
    """The groups of a match as ``year|month|day|hour|minute|second|fraction|zone|named zone|half``, null without a match."""
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, groups))


def _wall(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column, us: Column) -> Column:
    """Microseconds since 1970 on the wall, null for impossible parts."""
    date = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    seconds = F.unix_date(date).cast("bigint") * 86_400 + h * 3600 + mi * 60 + s
    return F.when(h.between(0, 23) & mi.between(0, 59) & s.between(0, 59), seconds * 1_000_000 + us)


def offset_minutes(text: Column) -> Column:
    """±HHMM or ±HH:MM to minutes, null beyond -1200..+1400."""
    pattern = r"^([+-])([0-9]{2}):?([0-9]{2})$"
    clean = F.trim(text)
    hours, rest = _part(clean, pattern, 2).try_cast("int"), _part(clean, pattern, 3).try_cast("int")
    signed = F.when(clean.startswith("-"), -1).otherwise(1) * (hours * 60 + rest)
    return F.when((rest < 60) & signed.between(-720, 840), signed)


def _stated(zone: Column) -> Column:
    """Minutes of a zone written in the value: Z, an offset or an abbreviation."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.coalesce(offset_minutes(zone), F.try_element_at(table, F.upper(zone)))


def parse(stamps: DataFrame) -> DataFrame:
    """Add ``epoch_us``, ``wall_us`` (local microseconds), ``said_minutes``, ``said_zone`` and ``unreadable_zone``.

    Needs origin, da, tm, dt and date_order; everything is evaluated in the JVM.  A value in dt wins over da and tm.
    """
    blank = lambda c: F.nullif(F.trim(F.translate(F.col(c), "\x00", "")), F.lit(""))
    df = stamps.withColumns({"_dt": blank("dt"), "_da": blank("da"), "_tm": blank("tm")})
    dt = F.col("_dt")
    archive = F.coalesce(F.col("origin") == "archive", F.lit(False))
    count = _part(dt, EPOCH, 1)
    length = F.length(count)

    def scaled(power: int) -> Column:
        digits = F.substring(F.rpad(F.regexp_extract(dt, EPOCH, 2), power, "0"), 1, power)
        return F.concat(count, digits).try_cast("bigint")

    epoch = F.when(archive, F.when(length <= 11, scaled(6)).when(length <= 14, scaled(3)).otherwise(count.try_cast("bigint")))
    us_order = F.coalesce(F.col("date_order") == "MDY", F.lit(False))
    parts = F.coalesce(
        _spread(dt, ISO, "$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
        F.when(~(archive & dt.rlike(EPOCH)), _spread(dt, COMPACT, "$1|$2|$3|$4|$5|$6|$7|$8||")),
        _spread(dt, MAIL, "$3|$2|$1|$4|$5|$6|$7|$8||"),
        F.when(us_order, _spread(dt, LOCAL, "$3|$1|$2|$4|$5|$6|$7|||$8")).otherwise(_spread(dt, LOCAL, "$3|$2|$1|$4|$5|$6|$7|||$8")),
        F.when(dt.isNull(), F.concat(_spread(F.col("_da"), DATE, "$1|$3|$4|"), _spread(F.col("_tm"), TIME, "$1|$2|$3|$4|||"))),
    )
    df = stage(df, {"epoch_us": epoch, "_parts": parts})
    df = stage(df, {"_p": F.split("_parts", "[|]")})
    part = lambda i: F.nullif(F.get("_p", F.lit(i)), F.lit(""))
    month_of = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, str(i))])
    fields = {f"_{i}": part(i) for i in range(10)} | {"_half": F.upper(part(9)), "_hour": part(3).try_cast("int")}
    df = stage(df, fields)
    hour, half = F.col("_hour"), F.col("_half")
    df = stage(
        df,
        {
            "_m": F.coalesce(F.try_element_at(month_of, F.col("_1")), F.col("_1")),
            "_h": F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0)),
            "_mi": F.col("_4").try_cast("int"),
            "_s": F.coalesce(F.col("_5").try_cast("int"), F.lit(0)),
            "_us": F.coalesce(F.substring(F.rpad("_6", 6, "0"), 1, 6).try_cast("int"), F.lit(0)),
            "said_minutes": _stated(F.col("_7")),
        },
    )
    wall = _wall(F.col("_0"), F.col("_m"), F.col("_2"), F.col("_h"), F.col("_mi"), F.col("_s"), F.col("_us"))
    df = stage(df, {"wall_us": wall, "said_zone": F.col("_8"), "unreadable_zone": F.col("_7").isNotNull() & F.col("said_minutes").isNull()})
    return df.select(*stamps.columns, "epoch_us", "wall_us", "said_minutes", "said_zone", "unreadable_zone")


def known_zones(spark: SparkSession) -> DataFrame:
    """The zone names that can be converted, a fixed table of about 600 rows: those of the JVM, through Spark Connect those of Python."""
    try:
        names = [str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds()]
    except Exception:  # noqa: BLE001 - no JVM on this side
        names = sorted(zoneinfo.available_timezones())
    return spark.createDataFrame([(z,) for z in names], "zone string")


def offset_histories(stations: DataFrame) -> DataFrame:
    """(zone, foreign, low, high): one name of each distinct offset history since 2000, a registered one if it has one, and the full hours that its offsets lie between."""
    spark = stations.sparkSession
    used = stations.select(F.col("zone_id").alias("zone")).where("zone is not null").distinct().withColumn("foreign", F.lit(False))
    weeks = F.sequence(F.lit("2000-01-03T12:00:00Z").cast("timestamp"), F.lit("2037-12-31T12:00:00Z").cast("timestamp"), F.expr("interval 7 days"))
    at = known_zones(spark).select("zone", F.explode(weeks).alias("at")).select("zone", "at", ((F.unix_micros(F.from_utc_timestamp("at", F.col("zone"))) - F.unix_micros("at")) / 60_000_000).alias("offset"))
    history = at.groupBy("zone").agg(F.bit_xor(F.xxhash64("at", "offset")).alias("key"), F.floor(F.min("offset") / 60).alias("low"), F.floor(F.max("offset") / 60).alias("high"))
    named = history.join(used, "zone", "left").select("*", F.struct(F.coalesce("foreign", F.lit(True)).alias("foreign"), F.length("zone").alias("n"), "zone").alias("name"))
    return named.groupBy("key", "low", "high").agg(F.min("name").alias("v")).select("v.zone", "v.foreign", "low", "high")


def _zone_offset_us(zone: Column, utc_us: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone)) - utc_us


def with_instant(df: DataFrame, zone: str, name: str) -> DataFrame:
    """Add ``name``: UTC microseconds of ``wall_us`` in the zone; null where it occurs there twice or never.

    The offsets a day before and a day after are the only candidates around one transition.
    """
    wall, at = F.col("wall_us"), F.col(zone)
    df = stage(df, {"_early": wall - _zone_offset_us(at, wall - DAY_US), "_late": wall - _zone_offset_us(at, wall + DAY_US)})
    early, late = F.col("_early"), F.col("_late")
    df = stage(df, {"_early_fits": early + _zone_offset_us(at, early) == wall, "_late_fits": late + _zone_offset_us(at, late) == wall})
    fits, other = F.col("_early_fits"), F.col("_late_fits")
    df = stage(df, {name: F.when(early == late, F.when(fits, early)).when(fits != other, F.when(fits, early).otherwise(late))})
    return df.drop("_early", "_late", "_early_fits", "_late_fits")


def usual_delay(parsed: DataFrame) -> float:
    """Minutes within which nine of ten files arrive, from the stamps that state their own offset; 29 where there are none, and no more than that, since zones lie half an hour apart."""
    at = F.coalesce("epoch_us", F.col("wall_us") - F.col("said_minutes").cast("bigint") * 60_000_000)
    lag = F.unix_micros(F.col("received_at").cast("timestamp")) - at
    found = parsed.select(lag.alias("lag")).where(F.col("lag").between(0, DAY_US)).agg(F.percentile_approx("lag", 0.9)).first()[0]
    return min(29.0, found / 60_000_000) if found else 29.0


def zone_violations(parsed: DataFrame, candidates: DataFrame, usual_delay_minutes: float | None = None) -> DataFrame:
    """(station_id, zone, foreign, stamps, violations, lag_us) of the candidate histories of every station.

    A stamp violates a history when it would lie after its own arrival, longer before it than files usually
    take (measured, if not given), or on a wall-clock time that the zone
    never had.  Stamps that arrived months late violate every history alike.  Candidates of a station are the histories whose offsets come within
    an hour of what the middle stamp arrived at, an equi-join on that hour.
    """
    delay = usual_delay(parsed) if usual_delay_minutes is None else usual_delay_minutes
    naive = parsed.where("wall_us is not null and said_minutes is null and said_zone is null and received_at is not null and not unreadable_zone")
    naive = naive.select("station_id", "wall_us", F.unix_micros(F.col("received_at").cast("timestamp")).alias("seen_us"))
    middle = naive.groupBy("station_id").agg(F.percentile_approx(F.col("wall_us") - F.col("seen_us"), 0.5).alias("ahead"))
    hour = F.floor(F.col("ahead") / 3_600_000_000)
    near = middle.select("station_id", F.explode(F.sequence(hour - 1, hour + 2)).alias("hour"))
    spread = candidates.select("zone", "foreign", F.explode(F.sequence("low", "high")).alias("hour"))
    chosen = near.join(spread, "hour").select("station_id", "zone", "foreign").distinct()
    each = naive.join(chosen, "station_id")
    return (
        stage(with_instant(each, "zone", "at_us"), {"lag": F.col("seen_us") - F.col("at_us")})
        .groupBy("station_id", "zone", "foreign")
        .agg(
            F.count("*").alias("stamps"),
            F.count_if(~F.coalesce(F.col("lag").between(0, delay * 60_000_000), F.lit(False))).alias("violations"),
            F.percentile_approx(F.when(F.col("lag") >= 0, F.col("lag")), 0.5).alias("lag_us"),
        )
    )


def estimated_zones(violations: DataFrame) -> DataFrame:
    """The history with the fewest violations; among equals one that is registered elsewhere, the one with the shortest usual delay, then by name.

    A history that most stamps of the station violate is no estimate.
    """
    order = F.struct("violations", "foreign", F.coalesce("lag_us", F.lit(2**62)).alias("lag_us"), "zone", "stamps")
    best = violations.groupBy("station_id").agg(F.min(order).alias("best"))
    return best.where("best.violations * 2 <= best.stamps").select("station_id", F.col("best.zone").alias("estimated_zone"))


def normalise(stamps: DataFrame, stations: DataFrame) -> DataFrame:
    """All columns of ``stamps`` plus ``instant_us``, ``zone_source`` and ``zone_used``.

    ``stations`` (station_id, zone_id, date_order) is the device registry; its rows are taken one per id.
    """
    spark = stamps.sparkSession
    registry = stations.groupBy("station_id").agg(F.min("zone_id").alias("zone_id"), F.min("date_order").alias("date_order"))
    zones = known_zones(spark)
    registry = registry.join(zones.select(F.col("zone").alias("zone_id"), F.lit(True).alias("zone_known")), "zone_id", "left").select(
        "station_id", "date_order", F.when(F.col("zone_known"), F.col("zone_id")).alias("station_zone")
    )
    own = [c for c in stamps.columns if c not in ("date_order", "station_zone")]
    parsed = parse(stamps.select(*own).join(registry, "station_id", "left"))
    # Where every station is registered there is nothing to estimate.
    placed = registry.where("station_zone is not null").select("station_id")
    if stamps.where("station_id is not null").select("station_id").distinct().join(placed, "station_id", "left_anti").take(1):
        unzoned = parsed.where("station_zone is null and station_id is not null")
        estimate = estimated_zones(zone_violations(unzoned, offset_histories(stations), usual_delay(parsed)))
        parsed = parsed.join(estimate, "station_id", "left")
    else:
        parsed = parsed.withColumn("estimated_zone", F.lit(None).cast("string"))
    return _resolve(parsed, zones).select(*stamps.columns, "instant_us", "zone_source", "zone_used")


def _resolve(parsed: DataFrame, zones: DataFrame) -> DataFrame:
    named = parsed.join(F.broadcast(zones.select(F.col("zone").alias("said_zone"), F.lit(True).alias("said_known"))), "said_zone", "left")
    named = stage(named, {"_apart": offset_minutes(F.col("time_zone_offset"))})
    source = (
        F.when(F.col("epoch_us").isNotNull(), "epoch")
        .when(F.col("wall_us").isNull() | F.col("unreadable_zone"), "none")
        .when(F.col("said_minutes").isNotNull(), "value")
        .when(F.col("said_zone").isNotNull(), F.when(F.col("said_known"), "value zone").otherwise("none"))
        .when(F.col("_apart").isNotNull(), "offset")
        .when(F.col("station_zone").isNotNull(), "station")
        .when(F.col("estimated_zone").isNotNull(), "estimate")
        .otherwise("none")
    )
    named = stage(named, {"zone_source": source})
    used = F.col("zone_source")
    zone = F.when(used == "value zone", F.col("said_zone")).when(used == "station", F.col("station_zone")).when(used == "estimate", F.col("estimated_zone"))
    minutes = F.when(used == "value", F.col("said_minutes")).when(used == "offset", F.col("_apart"))
    named = with_instant(stage(named, {"zone_used": zone, "_minutes": minutes}), "zone_used", "_zoned_us")
    fixed = F.col("wall_us") - F.col("_minutes").cast("bigint") * 60_000_000
    return stage(named, {"instant_us": F.when(used == "epoch", F.col("epoch_us")).otherwise(F.coalesce(fixed, F.col("_zoned_us")))})


def same_instants(normalised: DataFrame) -> DataFrame:
    """Pairs of stamps of one file that denote the same microsecond, smaller id first."""
    points = normalised.where("instant_us is not null and file is not null and stamp_id is not null").select("file", "instant_us", "stamp_id").distinct()
    other = points.withColumnRenamed("stamp_id", "stamp_id_b")
    pairs = points.withColumnRenamed("stamp_id", "stamp_id_a").join(other, ["file", "instant_us"]).where("stamp_id_a < stamp_id_b")
    return pairs.select("stamp_id_a", "stamp_id_b").distinct()
