"""Queries of the general data problems (pN_...), over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import hierarchy, rejects, shred, timestamps, units
from lumenframe.session import table


def _stamps(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise(table(spark, d, "time_values"), table(spark, d, "stations"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.same_instants(_stamps(spark, d))


def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every stamp with its UTC instant and where its zone came from."""
    return _stamps(spark, d).select("stamp_id", "file", F.timestamp_micros("instant_us").cast("timestamp_ntz").alias("instant"), "zone_source").distinct()


def p1_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Zone histories estimated for every station as if none were registered, beside the registered one."""
    stations = table(spark, d, "stations")
    parsed = timestamps.parse(table(spark, d, "time_values").join(F.broadcast(stations.select("station_id", "date_order")), "station_id", "left"))
    estimate = timestamps.estimated_zones(timestamps.zone_violations(parsed, timestamps.offset_histories(stations)))
    return stations.select("station_id", "zone_id").join(estimate, "station_id", "left")


def _hierarchy(spark: SparkSession, d: str, paths: bool = True) -> hierarchy.Hierarchy:
    return hierarchy.build(table(spark, d, "dicomdir_records"), table(spark, d, "file_sets"), paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d, paths=False).descendants()


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Status, root, parent, depth, path and number of descendants of every record."""
    return _hierarchy(spark, d).records


def p4_status(spark: SparkSession, d: str) -> DataFrame:
    """What became of every record, and the root that it lies below; of several the smallest."""
    return _hierarchy(spark, d).records.select("record_id", "status", "root_id")


def _channels(spark: SparkSession, d: str) -> DataFrame:
    return units.to_nominal_units(table(spark, d, "channel_definitions"), table(spark, d, "channel_nominals"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.off_nominal(_channels(spark, d))


def p5_common_units(spark: SparkSession, d: str) -> DataFrame:
    """Every channel with its sensitivity in the unit of the nominal."""
    return _channels(spark, d).select("channel_id", "found_value", "found_unit", F.round("common_value", 6).alias("common_value"), "nominal", "nominal_unit").distinct()


def _nested(spark: SparkSession, d: str) -> DataFrame:
    modules = table(spark, d, "waveform_modules").select(F.lit("waveform_modules").alias("origin"), F.col("module_id").alias("parent_id"), F.col("module_json").alias("text"))
    records = table(spark, d, "dicomdir_records").select(F.lit("dicomdir_records").alias("origin"), F.col("record_id").alias("parent_id"), F.col("data_set").alias("text"))
    return modules.unionByName(records)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.nested_items(_nested(spark, d)).select("origin", "parent_id", "item_path")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Multiplex groups, keyed by module and item path."""
    fields = {"originality": "003A0004", "n_channels": "003A0005", "n_samples": "003A0010", "frequency": "003A001A", "group_label": "003A0020"}
    return shred.field_table(_nested(spark, d), "54000100", fields)


def p6_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channels with the key of their group."""
    fields = {"channel_number": "003A0202", "channel_label": "003A0203", "sensitivity": "003A0210", "correction": "003A0212", "bits_stored": "003A021A"}
    return shred.field_table(_nested(spark, d), "54000100/003A0200", fields)


def p6_sources(spark: SparkSession, d: str) -> DataFrame:
    """Channel sources with the key of their channel."""
    fields = {"code_value": "00080100", "code_scheme": "00080102", "code_meaning": "00080104"}
    return shred.field_table(_nested(spark, d), "54000100/003A0200/003A0208", fields)


def p6_levels(spark: SparkSession, d: str) -> DataFrame:
    """The shredded columns themselves, as sizes of their level sequences per leaf path."""
    return shred.shredded(_nested(spark, d)).groupBy("origin", "leaf_path").agg(F.sum(F.size("levels")).cast("bigint").alias("entries"), F.countDistinct("parent_id").alias("records"))


def p6_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """The records without rows, and why."""
    return shred.unreadable(_nested(spark, d)).select("origin", "parent_id", F.substring_index("reason", ":", 1).alias("reason"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_lines(table(spark, d, "header_lines")).where("not valid").select("line_id").distinct()


def p7_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its verdict, reason and typed fields."""
    return rejects.parse_lines(table(spark, d, "header_lines"))


# Fixed values of the standard, as in lumenframe.operators.rejects.
_VRS = "'AE','AS','AT','CS','DA','DS','DT','FD','FL','IS','LO','LT','PN','SH','SL','SS','ST','TM','UI','UL','US'"
_LONG = "'OB','OD','OF','OL','OV','OW','SQ','SV','UC','UN','UR','UT','UV'"

# The units of these tables, spelt out by hand: (spelling, unit, dimension, size in the nominal unit of the dimension).
_SPELT = """
('v', 'V', 'v', 1e6), ('volt', 'V', 'v', 1e6), ('volts', 'V', 'v', 1e6), ('mv', 'mV', 'v', 1e3), ('millivolt', 'mV', 'v', 1e3), ('milli-volt', 'mV', 'v', 1e3),
('uv', 'uV', 'v', 1e0), ('microvolt', 'uV', 'v', 1e0), ('microvolts', 'uV', 'v', 1e0), ('nv', 'nV', 'v', 1e-3), ('nanovolt', 'nV', 'v', 1e-3),
('mm[hg]', 'mm[Hg]', 'p', 1e0), ('mmhg', 'mm[Hg]', 'p', 1e0), ('mm hg', 'mm[Hg]', 'p', 1e0), ('torr', 'mm[Hg]', 'p', 1e0), ('millimeter of mercury', 'mm[Hg]', 'p', 1e0),
('kpa', 'kPa', 'p', 1e3 / 133.322387415), ('kilopascal', 'kPa', 'p', 1e3 / 133.322387415), ('pa', 'Pa', 'p', 1e0 / 133.322387415), ('pascal', 'Pa', 'p', 1e0 / 133.322387415),
('mbar', 'mbar', 'p', 1e2 / 133.322387415), ('hpa', 'mbar', 'p', 1e2 / 133.322387415), ('cm[h2o]', 'cm[H2O]', 'p', 98.0665e0 / 133.322387415), ('cmh2o', 'cm[H2O]', 'p', 98.0665e0 / 133.322387415), ('cm h2o', 'cm[H2O]', 'p', 98.0665e0 / 133.322387415),
('ml/s', 'mL/s', 'f', 1e0), ('ml/sec', 'mL/s', 'f', 1e0), ('cc/s', 'mL/s', 'f', 1e0), ('l/s', 'L/s', 'f', 1e3), ('litres per second', 'L/s', 'f', 1e3),
('l/min', 'L/min', 'f', 1e3 / 60), ('lpm', 'L/min', 'f', 1e3 / 60)
"""
_UNITS = r"millimeter of mercury|litres per second|kilopascal|milli-volt|millivolt|microvolts|microvolt|nanovolt|pascal|cm\[h2o\]|mm\[hg\]|ml/sec|cm h2o|mm hg|cmh2o|l/min|volts|mmhg|torr|mbar|volt|ml/s|cc/s|kpa|hpa|l/s|lpm|mv|uv|nv|pa|v"
_NUMBER = rf"([0-9]+(?:[.,][0-9]+)?(?:e[-+]?[0-9]+)?)\s*({_UNITS})(?:/lsb|/bit| per bit|$)"
_PLAIN = "replace(replace(lower(trim({})), 'µ', 'u'), 'μ', 'u')"
_CHANNELS = f"""
with u(spelling, unit, dim, size) as (values {_SPELT})
, c as (select *, {_PLAIN.format("derivation_description")} as t from channel_definitions)
, p as (select *, try_cast(replace(regexp_extract(t, '{_NUMBER}', 1), ',', '.') as double) as tv, (select unit from u where spelling = regexp_extract(t, '{_NUMBER}', 2)) as tu,
  coalesce((select unit from u where spelling = {_PLAIN.format("sensitivity_units_code")}), (select unit from u where spelling = {_PLAIN.format("sensitivity_units_meaning")}),
           (select unit from u where spelling = {_PLAIN.format("regexp_extract(label, '[[](.*)[]]$', 1)")})) as own from c)
, q as (select *, case when sensitivity is not null then sensitivity when own is null or own = tu then tv end as v, case when sensitivity is not null then own when tv is not null and (own is null or own = tu) then tu end as un from p)
, r as (select q.*, nominal, nominal_unit, s.size from q left join channel_nominals n using (device_model, source_code_value)
  left join (select distinct unit, dim, size from u) s on s.unit = q.un and s.dim = case n.nominal_unit when 'uV' then 'v' when 'mm[Hg]' then 'p' when 'mL/s' then 'f' end)
, x as (select *, v * coalesce(sensitivity_correction_factor, 1) * size as common from r)
"""

def _items(sequence: str, fields: dict[str, str]) -> str:
    """SQL of a table of items: nodes of the JSON tree at the depth of the sequence, and of their children the named ones."""
    tags = sequence.split("/")
    pattern = "/".join(rf"{t}/\[[0-9]+\]" for t in tags)
    columns = ", ".join(f"max(v.value::varchar) filter (upper(e.key) = '{tag}') as {name}" for name, tag in fields.items())
    parent = "nullif(regexp_replace(item_path, '/?[^/]+/\\[[0-9]+\\]$', ''), '')"
    return rf"""
with s as (select 'waveform_modules' as origin, module_id as id, module_json as t from waveform_modules union select 'dicomdir_records', record_id, data_set from dicomdir_records)
, j as (select origin, id, case when json_type(t) = 'VARCHAR' then (t->>'$') else t end as t from s where t is not null and trim(t) != '' and json_valid(t))
, n as (select origin, j.id as rid, x.id, x.parent, x.key, x.type, x.fullkey, x.atom, x.value from j, json_tree(j.t) x where json_valid(j.t))
, i as (select i.origin, i.rid, i.id, upper(rtrim(regexp_replace(i.fullkey[2:], '\."?([0-9A-Fa-f]{{8}})"?\."?Value"?\[([0-9]+)\]', '\1/[\2]/', 'g'), '/')) as item_path
  from n i join n a on a.origin = i.origin and a.rid = i.rid and a.id = i.parent and a.type = 'ARRAY' and a.key = 'Value'
  join n v on v.origin = i.origin and v.rid = i.rid and v.parent = a.parent and v.key = 'vr' and v.atom = '"SQ"' where i.type = 'OBJECT')
, k as (select * from i where regexp_full_match(item_path, '{pattern}'))
select k.origin, k.rid as parent_id, item_path, {parent} as parent_path, {columns}
from k left join n e on e.origin = k.origin and e.rid = k.rid and e.parent = k.id left join n v on v.origin = k.origin and v.rid = k.rid and v.parent = e.id and v.key = 'Value'
group by 1, 2, 3, 4
"""


_LINES = rf"""
with q as (
  select line_id, raw, regexp_full_match(coalesce(raw, '"'), '(?s)(?:[^",
]*|"(?:[^"]|"")*")(?:,(?:[^",
]*|"(?:[^"]|"")*"))*') as ok,
         regexp_extract_all(coalesce(raw, ''), '(?s)(?:^|,)((?:"(?:[^"]|"")*")|[^",]*)', 1) as c
  from header_lines
), f as (
  select line_id, raw, ok, len(c) = 6 as six, list_transform(c, lambda x: case when x like '"%' then replace(x[2:-2], '""', '"') else x end) as c from q
), g as (
  select line_id, raw, ok, six, c, c[2] as tag, c[3] as vr, c[4] as len, c[5] as pos, case when regexp_full_match(c[4], '[0-9]+') then try_cast(c[4] as hugeint) end as n from f
), h as (
  select *, case when raw is null then 'null_line' when not ok then 'quoting' when not six then 'columns' when not regexp_full_match(tag, '[0-9A-F]{{8}}') then 'tag'
    when not (vr in ({_VRS}) or vr in ({_LONG}) or (vr = '' and tag like 'FFFE%')) then 'vr'
    when n is null or not (n <= case when vr in ({_VRS}) then 65535 else 4294967294 end or (n = 4294967295 and vr in ('SQ','UN','OB','OW'))) then 'length'
    when not regexp_full_match(pos, '[0-9]+') then 'offset' end as reason from g
)
"""
_TREES = """
with recursive r as (select record_id as id, any_value(next_sibling) as ns, any_value(first_child) as fc from dicomdir_records where record_id is not null group by 1)
, e as (select a.id as src, b.id as dst, 'n' as kind from r a join r b on a.ns = b.id union all select a.id, b.id, 'c' from r a join r b on a.fc = b.id)
, reach as (select src, dst from e union select reach.src, e.dst from reach join e on reach.dst = e.src)
, loops as (select distinct src as id from reach where src = dst)
, chain as (select first_root_record as id from file_sets where first_root_record in (select id from r) union select e.dst from chain join e on e.src = chain.id and e.kind = 'n')
, below as (
  select chain.id as root, e.dst as id from chain join e on e.src = chain.id and e.kind = 'c' where chain.id not in (select id from loops) and e.dst not in (select id from loops)
  union select below.root, e.dst from below join e on e.src = below.id where e.dst not in (select id from loops))
"""

ORACLE: dict[str, str] = {
    "p4_found": f"{_TREES} select root as root_id, id as record_id from below",
    "p4_status": f"""{_TREES}
select r.id as record_id, case when r.id in (select id from loops) then 'loop' when r.id in (select id from chain) then 'root' when b.root is not null then 'below' else 'unreached' end as status,
  case when r.id in (select id from loops) then null when r.id in (select id from chain) then r.id else b.root end as root_id
from r left join (select id, min(root) as root from below group by 1) b using (id)
""",
    "p5_found": f"{_CHANNELS} select distinct channel_id from x where abs(common - nominal) > 0.01 * abs(nominal)",
    "p5_common_units": f"{_CHANNELS} select distinct channel_id, v as found_value, un as found_unit, round(common, 6) as common_value, nominal, nominal_unit from x",
    "p6_groups": _items("54000100", {"originality": "003A0004", "n_channels": "003A0005", "n_samples": "003A0010", "frequency": "003A001A", "group_label": "003A0020"}),
    "p6_channels": _items("54000100/003A0200", {"channel_number": "003A0202", "channel_label": "003A0203", "sensitivity": "003A0210", "correction": "003A0212", "bits_stored": "003A021A"}),
    "p6_sources": _items("54000100/003A0200/003A0208", {"code_value": "00080100", "code_scheme": "00080102", "code_meaning": "00080104"}),
    "p6_found": r"""
with s as (select 'waveform_modules' as origin, module_id as id, module_json as t from waveform_modules union select 'dicomdir_records', record_id, data_set from dicomdir_records)
, j as (select origin, id, case when json_type(t) = 'VARCHAR' then (t->>'$') else t end as t from s where t is not null and trim(t) != '' and json_valid(t))
, n as (select origin, j.id as rid, x.id, x.parent, x.key, x.type, x.fullkey, x.atom from j, json_tree(j.t) x where json_valid(j.t))
select distinct i.origin, i.rid as parent_id, upper(rtrim(regexp_replace(i.fullkey[2:], '\."?([0-9A-Fa-f]{8})"?\."?Value"?\[([0-9]+)\]', '\1/[\2]/', 'g'), '/')) as item_path
from n i join n a on a.origin = i.origin and a.rid = i.rid and a.id = i.parent and a.type = 'ARRAY' and a.key = 'Value'
join n v on v.origin = i.origin and v.rid = i.rid and v.parent = a.parent and v.key = 'vr' and v.atom = '"SQ"'
where i.type = 'OBJECT'
""".replace("\\\\", "\\"),
    "p6_unreadable": r"""
with s as (select 'waveform_modules' as origin, module_id as parent_id, module_json as t from waveform_modules union select 'dicomdir_records', record_id, data_set from dicomdir_records)
select origin, parent_id, case when t is null then 'null' when trim(t, chr(32) || chr(9) || chr(10) || chr(13)) = '' then 'blank' else 'not JSON' end as reason from s where t is null or trim(t, chr(32) || chr(9) || chr(10) || chr(13)) = '' or not json_valid(t)
""",
    "p7_found": f"{_LINES} select distinct line_id from h where reason is not null",
    "p7_lines": f"""{_LINES}
select line_id, reason is null as valid, reason, case when reason is null then c[1] end as file, case when reason is null then tag end as tag, case when reason is null then vr end as vr,
  case when reason is null then n::bigint end as length, case when reason is null then try_cast(pos as decimal(38, 0)) end as "offset", case when reason is null then c[6] end as keyword from h
""",
}
QUERIES = {f.__name__: f for f in (p1_found, p1_instants, p1_zone_estimates, p4_found, p4_hierarchy, p4_status, p5_found, p5_common_units, p6_found, p6_groups, p6_channels, p6_sources, p6_levels, p6_unreadable, p7_found, p7_lines)}
