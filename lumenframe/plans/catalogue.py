"""Queries of the toolkit's operators over the driver tables, with their SQL.

Embeddings (64 floats) stand for 8×8 images and for waveforms of 8 channels, line items for stored values and tags,
customers for patients, orders for studies; elements, files and modules are themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import dictionaries
from lumenframe.functions import getters as G
from lumenframe.functions import imaging as I
from lumenframe.functions import scalars as S
from lumenframe.operators import elements as E
from lumenframe.operators import listing as L
from lumenframe.session import table
from lumenframe.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

GREY = "cast(floor((e.x + 1) * 100) as int)"
PIXELS = "(select vec_id, list_transform(embedding, lambda e: cast(floor((e::double + 1) * 100) as int)) as px from embeddings)"
PATH = "array_to_string(list_concat(list_transform(path, lambda p: p.tag || '/[' || p.item || ']'), [tag]), '/')"


_N_BYTES = """coalesce(octet_length(inline_binary), case when vr = 'US' then 2 * json_array_length(values_json) end,
  case when vr = 'PN' then strlen(array_to_string(list_transform(from_json(values_json, '[{"Alphabetic":"VARCHAR","Ideographic":"VARCHAR","Phonetic":"VARCHAR"}]'), lambda p: rtrim(coalesce(p.Alphabetic, '') || '=' || coalesce(p.Ideographic, '') || '=' || coalesce(p.Phonetic, ''), '=')), '\\\\'))
       else strlen(array_to_string(list_transform(from_json(values_json, '["VARCHAR"]'), lambda x: coalesce(x, '')), '\\\\')) end, 0)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL under the function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Images of 8×8 grey levels."""
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 100).cast("int")).alias("px"))


# -- listing ------------------------------------------------------------------------------------------------


@query("""
select source as class, count(*) as n_files, sum(n_chars)::bigint as n_bytes, round(count(*) * 100.0 / sum(count(*)) over (), 6)::double as file_share, round(sum(n_chars) * 100.0 / sum(sum(n_chars)) over (), 6)::double as byte_share
from documents where n_chars > 0 and source is not null group by source
""")
def list_summary_group(spark: SparkSession, d: str) -> DataFrame:
    """Summary by class with each class's share of the files and bytes; rows without a class are skipped."""
    return L.summary(table(spark, d, "documents").where("n_chars > 0 and source is not null"), F.col("source"), F.col("n_chars"))


@query("""
select coalesce(transfer_syntax_uid, '1.2.840.10008.1.2') as class, count(*) as n_files, sum(coalesce(file_length, 0))::bigint as n_bytes,
       round(count(*) * 100.0 / sum(count(*)) over (), 6)::double as file_share,
       round(sum(coalesce(file_length, 0)) * 100.0 / sum(sum(coalesce(file_length, 0))) over (), 6)::double as byte_share
from files group by 1
""")
def list_summary_syntax(spark: SparkSession, d: str) -> DataFrame:
    """Summary by transfer syntax; a missing one means implicit VR little endian."""
    return L.summary(table(spark, d, "files"), F.coalesce("transfer_syntax_uid", F.lit("1.2.840.10008.1.2")), F.col("file_length"))


@query("""
select count(*) as n_files, coalesce(sum(file_length), 0)::bigint as n_bytes, coalesce(sum(file_length) // count(*), 0)::bigint as mean_bytes,
       arg_max(path, (file_length, path)) as largest_path, max(file_length) as largest_bytes, count(distinct study_uid) as n_studies
from files
""")
def list_totals(spark: SparkSession, d: str) -> DataFrame:
    return L.totals(table(spark, d, "files"), "file_length", "study_uid", "path")


@query("""
select path, file_length from files where lower(path) like '%.dcm' and lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1)) = 'dcm'
  and not regexp_full_match(lower(path), '/arch[12]/2022-.*')
""")
def list_select(spark: SparkSession, d: str) -> DataFrame:
    """Files by extension without the ignored globs."""
    return L.list_files(table(spark, d, "files"), "dcm", ["/arch[12]/2022-**"]).select("path", "file_length")


@query("""
select modality, transfer_syntax_uid, grouping(modality, transfer_syntax_uid)::bigint as level, count(*) as n_files, sum(file_length)::bigint as n_bytes
from files group by cube (modality, transfer_syntax_uid)
""")
def list_cube(spark: SparkSession, d: str) -> DataFrame:
    """Summary at every level of modality and transfer syntax."""
    return L.cube(table(spark, d, "files"), ["modality", "transfer_syntax_uid"], "file_length")


@query("""
with r as (
  select distinct 0 as depth, 'PATIENT' as level, o_custkey::varchar as key, '' as parent_key from orders
  union all select distinct 1, 'STUDY', o_custkey::varchar || '/' || o_orderkey, o_custkey::varchar from orders
), n as (select *, lead(key) over (partition by depth, parent_key order by key) as next_key from r)
select level, key, nullif(parent_key, '') as parent_key, next_key,
       (select min(c.key) from r c where c.parent_key = n.key and c.depth = n.depth + 1) as child_key
from n
""")
def dicomdir_index(spark: SparkSession, d: str) -> DataFrame:
    """Directory records of patients and studies with their links."""
    return L.hierarchy_records(table(spark, d, "orders"), [("PATIENT", "o_custkey"), ("STUDY", "o_orderkey")])


@query("""
with n as (
  select l_orderkey, l_linenumber, l_partkey, o_custkey, l_suppkey, row_number() over (partition by o_custkey, l_orderkey, l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as im
  from lineitem join orders on o_orderkey = l_orderkey
), p as (select o_custkey, row_number() over (order by min((l_orderkey, l_linenumber, l_partkey, l_extendedprice))) - 1 as pa from lineitem join orders on o_orderkey = l_orderkey group by 1)
, s as (select o_custkey, l_orderkey, row_number() over (partition by o_custkey order by min((l_orderkey, l_linenumber, l_partkey, l_extendedprice))) - 1 as st from lineitem join orders on o_orderkey = l_orderkey group by 1, 2)
, e as (select o_custkey, l_orderkey, l_suppkey, row_number() over (partition by o_custkey, l_orderkey order by min((l_orderkey, l_linenumber, l_partkey, l_extendedprice))) - 1 as se from lineitem join orders on o_orderkey = l_orderkey group by 1, 2, 3)
select l_orderkey, l_linenumber, l_partkey, 'PA' || lpad(pa::varchar, 6, '0') || '/ST' || lpad(st::varchar, 6, '0') || '/SE' || lpad(se::varchar, 6, '0') || '/IM' || lpad(im::varchar, 6, '0') as name
from n join p using (o_custkey) join s using (o_custkey, l_orderkey) join e using (o_custkey, l_orderkey, l_suppkey)
""")
def archive_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of exported files, numbered by first appearance."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    named = L.archive_names(joined, "o_custkey", "l_orderkey", "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return named.select("l_orderkey", "l_linenumber", "l_partkey", "name")


@query("""
with f as (select l_orderkey, l_partkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) - 1 as i, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey, i as frame_index, n as n_frames from f where i = 0 or i = n - 1 or (i >= 2 and i <= n - 3)
""")
def frame_select(spark: SparkSession, d: str) -> DataFrame:
    """First and last frame, and those from the third to the third last."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    frames = table(spark, d, "lineitem").select("l_orderkey", (F.row_number().over(order) - 1).cast("bigint").alias("frame_index"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n_frames"))
    return L.selected_frames(frames, "0,-1,2..-3")


# -- scalars ------------------------------------------------------------------------------------------------


@query("""
with t as (select element_id, values_json->>'$[0]' as v from elements where vr = 'DA')
select element_id, case when regexp_full_match(v, '[0-9]{8}') then v[1:4] || '-' || v[5:6] || '-' || v[7:8] end as iso,
       case when regexp_full_match(v, '[0-9]{8}') then v[1:4]::int end as year,
       case when regexp_full_match(v, '[0-9]{8}') then try_cast(v[1:4] || '-' || v[5:6] || '-' || v[7:8] as date) is not null else false end as on_calendar
from t
""")
def vr_da(spark: SparkSession, d: str) -> DataFrame:
    v = F.get_json_object("values_json", "$[0]")
    rows = table(spark, d, "elements").where("vr = 'DA'")
    return rows.select("element_id", S.date_iso(v).alias("iso"), S.date_parts(v)["year"].alias("year"), S.date_value(v).isNotNull().alias("on_calendar"))


@query("""
with t as (select element_id, rtrim(values_json->>'$[0]', ' ') as v from elements where vr = 'TM')
, p as (select element_id, v, regexp_full_match(v, '[0-9]{2}([0-9]{2}([0-9]{2}(\\.[0-9]{1,6})?)?)?') as ok from t)
select element_id, case when ok and v[1:2]::int <= 23 and coalesce(try_cast(nullif(v[3:4], '') as int) <= 59, true) then v[1:2]::int end as hour,
       case when ok then v[1:2] || case when len(v) >= 4 then ':' || v[3:4] else '' end ||
         case when len(v) >= 6 then ':' || case when v like '%.%' then regexp_replace(v[5:], '\\.?0*$', '') else v[5:] end else '' end end as iso
from p
""")
def vr_tm(spark: SparkSession, d: str) -> DataFrame:
    v = F.get_json_object("values_json", "$[0]")
    return table(spark, d, "elements").where("vr = 'TM'").select("element_id", S.time_parts(v)["hour"].alias("hour"), S.time_iso(v).alias("iso"))


@query("""
with t as (select element_id, rtrim(values_json->>'$[0]', ' ') as v from elements where vr = 'DT')
, p as (select element_id, v, regexp_extract(v, '[+-][0-9]{4}$') as z, regexp_replace(v, '[+-][0-9]{4}$', '') as b,
   regexp_full_match(v, '[0-9]{4}([0-9]{2}([0-9]{2}([0-9]{2}([0-9]{2}([0-9]{2}(\\.[0-9]{1,6})?)?)?)?)?)?([+-][0-9]{4})?') as ok from t)
select element_id, case when ok then b[1:4]::int end as year, case when ok then try_cast(nullif(b[9:10], '') as int) end as hour,
  case when ok and z != '' then (case when z[1] = '-' then -1 else 1 end) * (z[2:3]::int * 60 + z[4:5]::int) end as offset_minutes
from p
""")
def vr_dt(spark: SparkSession, d: str) -> DataFrame:
    parts = S.datetime_parts(F.get_json_object("values_json", "$[0]"))
    return table(spark, d, "elements").where("vr = 'DT'").select("element_id", parts["year"].alias("year"), parts["hour"].alias("hour"), parts["offset_minutes"].alias("offset_minutes"))


@query("""
with t as (select element_id, rtrim(values_json->>'$[0]', ' ') as v from elements where vr = 'AS')
select element_id, case when regexp_full_match(v, '[0-9]{3}[DWMY]') then v[1:3]::int::varchar || ' ' ||
  case v[4] when 'D' then 'day' when 'W' then 'week' when 'M' then 'month' else 'year' end || case when v[1:3]::int = 1 then '' else 's' end end as words
from t
""")
def vr_as(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").where("vr = 'AS'").select("element_id", S.age_words(F.get_json_object("values_json", "$[0]")).alias("words"))


@query("""
with t as (select element_id, string_split(rtrim(values_json->>'$[0].Alphabetic'), '^') as c from elements where vr = 'PN')
select element_id, case when len(c) <= 5 then rtrim(coalesce(c[1], '')) end as last_name, case when len(c) <= 5 then rtrim(coalesce(c[2], '')) end as first_name,
  case when len(c) <= 5 then rtrim(coalesce(c[3], '')) end as middle_name from t
""")
def vr_pn(spark: SparkSession, d: str) -> DataFrame:
    name = S.name_components(F.rtrim(F.get_json_object("values_json", "$[0].Alphabetic")))
    return table(spark, d, "elements").where("vr = 'PN'").select("element_id", *[name[c].alias(c) for c in ("last_name", "first_name", "middle_name")])


@query("""
select l_orderkey, l_linenumber, l_partkey, [l_quantity::int, l_linenumber] as ints, [round(l_discount, 2), round(l_tax, 2)] as decs from lineitem
""")
def vr_is_ds(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written as multi-valued strings and read back."""
    text = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("\\", F.col("l_quantity").cast("int"), F.lit(""), F.format_string("+%d ", "l_linenumber")).alias("i"), F.concat_ws("\\", F.format_string("%.2f", "l_discount"), F.format_string(" %.2e", F.round("l_tax", 2))).alias("f"))
    return text.select("l_orderkey", "l_linenumber", "l_partkey", S.integers(F.col("i")).alias("ints"), S.decimals(F.col("f")).alias("decs"))


@query(r"""
select element_id, len(values_json->>'$[0]') between 1 and 64 and regexp_full_match(values_json->>'$[0]', '(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*') as ok from elements where vr = 'UI'
""")
def uid_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").where("vr = 'UI'").select("element_id", S.is_uid(F.get_json_object("values_json", "$[0]")).alias("ok"))


@query("""
with h as (select distinct study_uid, sha256('{"study_uid":"' || study_uid || '"}') as h from files where study_uid is not null)
select study_uid, '2.25.1' || lpad(('0x' || h[1:15])::bigint::varchar, 19, '0') || lpad(('0x' || h[16:30])::bigint::varchar, 19, '0') as uid, true as ok from h
""")
def uid_generated(spark: SparkSession, d: str) -> DataFrame:
    """A valid UID per study, the same whenever it is made."""
    return table(spark, d, "files").where("study_uid is not null").select("study_uid").distinct().select("study_uid", S.uid_from(F.col("study_uid")).alias("uid")).withColumn("ok", S.is_uid(F.col("uid")))


@query("""
with t as (select element_id, tag, ('0x' || tag)::bigint as n from elements)
select element_id, n as number, n >> 16 as group_number, n & 65535 as element_number, (n >> 16) & 1 = 1 as private, '(' || tag[1:4] || ',' || tag[5:8] || ')' as shown from t
""")
def tag_arith(spark: SparkSession, d: str) -> DataFrame:
    n = S.tag_int(F.col("tag"))
    return table(spark, d, "elements").select("element_id", n.alias("number"), S.tag_group(n).alias("group_number"), S.tag_element(n).alias("element_number"), S.is_private(n).alias("private"), S.tag_text(n).alias("shown"))


@query(f"select element_id, {PATH} as path_text from elements")
def path_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").select("element_id", S.path_text(F.col("path"), F.col("tag")).alias("path_text"))


@query("select element_id, len(path)::int as steps, path[-1].tag as last_tag, path[-1].item as last_item from elements where len(path) > 0")
def path_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Paths written and read back."""
    nested = table(spark, d, "elements").where(F.size("path") > 0)
    steps = nested.select("element_id", S.path_steps(S.path_text(F.col("path"), F.col("tag"))).alias("s"))
    return steps.select("element_id", F.size("s").alias("steps"), F.element_at("s", -1)["tag"].alias("last_tag"), F.element_at("s", -1)["item"].alias("last_item"))


@query("""
with t as (select element_id, coalesce(json_array_length(values_json), 0)::int as n from elements where vr != 'OW')
select element_id, n, n between 1 and 2 as fits from t
""")
def vm_check(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.json_array_length("values_json"), F.lit(0))
    return table(spark, d, "elements").where("vr != 'OW'").select("element_id", n.alias("n"), S.multiplicity_fits(n, 1, 2).alias("fits"))


@query("""
select doc_id, regexp_replace(array_to_string(list_transform(string_split(text, ''), lambda c: case when ord(c) < 128 then c else repeat('?', strlen(c)) end), ''), '', '') as plain from documents
""")
def ascii_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.ascii_only(F.col("text")).alias("plain"))


@query(f"""
with v as (select element_id, vr, {_N_BYTES} as n, list_max(list_transform(from_json(values_json, '["VARCHAR"]'), lambda x: len(x))) as chars from elements where vr != 'PN')
select element_id, case vr when 'CS' then chars is null or chars <= 16 when 'LO' then chars is null or chars <= 64 when 'UI' then chars is null or chars <= 64 when 'DS' then chars is null or chars <= 16 when 'IS' then chars is null or chars <= 12
  when 'LT' then chars is null or chars <= 10240 when 'DA' then n + n % 2 <= 8 when 'TM' then n + n % 2 <= 14 when 'DT' then n + n % 2 <= 26 when 'AS' then n + n % 2 <= 4 when 'US' then true when 'OW' then true when 'UT' then true end as fits from v
""")
def length_valid(spark: SparkSession, d: str) -> DataFrame:
    """Whether values have a length that their representation allows."""
    rows = table(spark, d, "elements").where("vr != 'PN'")
    longest = F.array_max(F.transform(F.from_json("values_json", "array<string>"), F.length))
    return rows.select("element_id", S.length_fits(F.col("vr"), E.value_bytes(F.col("vr"), F.col("values_json"), F.col("inline_binary")), longest).alias("fits"))


@query("select element_id, case values_json->>'$[0]' when 'M' then 'Male' when 'F' then 'Female' when 'O' then 'Other' else values_json->>'$[0]' end as described from elements where tag = '00100040'")
def code_described(spark: SparkSession, d: str) -> DataFrame:
    """Code strings with their meaning."""
    return table(spark, d, "elements").where("tag = '00100040'").select("element_id", dictionaries.code_described("00100040", F.get_json_object("values_json", "$[0]")).alias("described"))


@query("""
select element_id, case v when '1.2.840.10008.5.1.4.1.1.2' then 'CT Image Storage' when '1.2.840.10008.5.1.4.1.1.4' then 'MR Image Storage' when '1.2.840.10008.5.1.4.1.1.1' then 'Computed Radiography Image Storage'
  when '1.2.840.10008.5.1.4.1.1.6.1' then 'Ultrasound Image Storage' when '1.2.840.10008.5.1.4.1.1.9.1.1' then '12-lead ECG Waveform Storage' when '1.2.840.10008.5.1.4.1.1.9.1.2' then 'General ECG Waveform Storage' when '1.2.840.10008.5.1.4.1.1.9.2.1' then 'Hemodynamic Waveform Storage'
  when '1.2.840.10008.5.1.4.1.1.7' then 'Secondary Capture Image Storage' when '1.2.840.10008.5.1.4.1.1.88.11' then 'Basic Text SR Storage' when '1.2.840.10008.5.1.4.1.1.12.1' then 'X-Ray Angiographic Image Storage' else v end as named
from (select element_id, values_json->>'$[0]' as v from elements where tag = '00080016')
""")
def uid_named(spark: SparkSession, d: str) -> DataFrame:
    """Storage classes by name."""
    return table(spark, d, "elements").where("tag = '00080016'").select("element_id", dictionaries.uid_named(F.get_json_object("values_json", "$[0]")).alias("named"))


@query("select p_partkey, lpad(p_size::varchar, 3, '0') || 'Y' as age, lpad((p_size % 24)::varchar, 2, '0') || lpad((p_partkey % 60)::varchar, 2, '0') as time, case when p_size % 13 between 1 and 12 then '2024' || lpad((p_size % 13)::varchar, 2, '0') || '09' end as date from part")
def values_written(spark: SparkSession, d: str) -> DataFrame:
    """Ages, times and dates in the notation of the standard; impossible ones are null."""
    rows = table(spark, d, "part")
    return rows.select("p_partkey", S.age_text(F.col("p_size"), F.lit("Y")).alias("age"), S.time_text(F.col("p_size") % 24, (F.col("p_partkey") % 60).cast("int")).alias("time"), S.date_text(F.lit(2024), F.col("p_size") % 13, F.lit(9)).alias("date"))


@query("""
with t as (select element_id, rtrim(values_json->>'$[0]', ' ') as v from elements where vr = 'DT'), p as (select element_id, v, regexp_extract(v, '[+-][0-9]{4}$') as z, regexp_replace(v, '[+-][0-9]{4}$', '') as b,
   regexp_full_match(v, '[0-9]{4}([0-9]{2}([0-9]{2}([0-9]{2}([0-9]{2}([0-9]{2}(\\.[0-9]{1,6})?)?)?)?)?)?([+-][0-9]{4})?') as ok from t)
select element_id, case when ok then b[1:4] || case when len(b) >= 6 then '-' || b[5:6] else '' end || case when len(b) >= 8 then '-' || b[7:8] else '' end || case when len(b) >= 10 then 'T' || b[9:10] else '' end
  || case when len(b) >= 12 then ':' || b[11:12] else '' end || case when len(b) >= 14 then ':' || case when b like '%.%' then regexp_replace(b[13:], '\\.?0*$', '') else b[13:] end else '' end || case when z != '' then z[1:3] || ':' || z[4:5] else '' end end as iso from p
""")
def datetime_iso(spark: SparkSession, d: str) -> DataFrame:
    """Times of day with date and offset in ISO notation, with the precision that they have."""
    return table(spark, d, "elements").where("vr = 'DT'").select("element_id", S.datetime_iso(F.get_json_object("values_json", "$[0]")).alias("iso"))


@query("select name_id, case when not regexp_matches(coalesce(last_name, '') || coalesce(first_name, '') || coalesce(middle_name, ''), '[\\^=\\\\]') then rtrim(coalesce(last_name, '') || '^' || coalesce(first_name, '') || '^' || coalesce(middle_name, ''), '^') end as written from person_names")
def name_written(spark: SparkSession, d: str) -> DataFrame:
    """Components joined to a name; those that hold a separator make none."""
    parts = F.struct("last_name", "first_name", "middle_name", F.lit("").alias("prefix"), F.lit("").alias("suffix"))
    return table(spark, d, "person_names").select("name_id", S.name_text(parts).alias("written"))


@query(f"""
with y as (select p_partkey, (p_size * 5 % 256)::double as y, (p_partkey % 256)::double as cb, (floor(p_retailprice) % 256)::double as cr from part)
select p_partkey, least(255, greatest(0, floor(y + 1.402 * (cr - 128) + 0.5)))::int as r, least(255, greatest(0, floor(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128) + 0.5)))::int as g, least(255, greatest(0, floor(y + 1.772 * (cb - 128) + 0.5)))::int as b from y
""")
def ybr_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    y, cb, cr = (F.col("p_size") * 5 % 256).cast("double"), (F.col("p_partkey") % 256).cast("double"), (F.floor("p_retailprice") % 256).cast("double")
    return table(spark, d, "part").select("p_partkey", I.ybr_to_rgb(y, cb, cr).alias("c")).select("p_partkey", "c.*")


@query("""
with r as (select p_partkey, p_size - 20 as x, p_size % 7 - 3 as y, p_size % 11 as w, p_size as h from part), c as (select p_partkey, least(greatest(x, 0), 16) as l, least(greatest(y, 0), 12) as t, least(greatest(x + w, 0), 16) as r, least(greatest(y + h, 0), 12) as b from r)
select p_partkey, l::int as x, t::int as y, (r - l)::int as width, (b - t)::int as height from c
""")
def rect_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles cut to an image of 16×12."""
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", I.clamp_rect(size - 20, size % 7 - 3, size % 11, size, 16, 12).alias("r")).select("p_partkey", "r.*")


_ONE = "case when json_array_length(values_json) = 1 then values_json->>'$[0]' end"


@query(f"""
select element_id, case when vr in ('CS', 'LO', 'LT', 'UI', 'UT') then {_ONE} end as string, case when vr in ('IS', 'US') and regexp_full_match({_ONE}, '[+-]?[0-9]+') then try_cast({_ONE} as bigint) end as int, case when vr = 'DS' then try_cast({_ONE} as double) end as float,
  case when vr = 'AS' and regexp_full_match({_ONE}, '[0-9]{{3}}[DWMY]') then ({_ONE})[1:3]::int end as age, case when vr = 'DA' and regexp_full_match({_ONE}, '[0-9]{{8}}') then ({_ONE})[1:4]::int end as year, strlen(values_json) is null as empty
from elements where vr not in ('PN', 'OW', 'TM', 'DT')
""")
def getters_single(spark: SparkSession, d: str) -> DataFrame:
    """The only value of elements by type; null where the representation is another or there are several."""
    rows = table(spark, d, "elements").where("vr not in ('PN', 'OW', 'TM', 'DT')")
    return rows.select("element_id", G.string().alias("string"), G.int_().alias("int"), G.float_().alias("float"), G.age()["number"].alias("age"), G.date()["year"].alias("year"), F.col("values_json").isNull().alias("empty"))


@query("""
select element_id, case when vr in ('CS', 'LO', 'LT', 'UI', 'UT') then coalesce(list_transform(from_json(values_json, '["VARCHAR"]'), lambda x: coalesce(x, '')), []) end as strings,
  case when vr = 'PN' then coalesce(list_transform(from_json(values_json, '[{"Alphabetic":"VARCHAR"}]'), lambda p: case when len(string_split(p.Alphabetic, '^')) <= 5 then rtrim(string_split(p.Alphabetic, '^')[1]) end), []) end as last_names
from elements where vr not in ('OW', 'TM', 'DT')
""")
def getters_many(spark: SparkSession, d: str) -> DataFrame:
    """All values of elements by type."""
    rows = table(spark, d, "elements").where("vr not in ('OW', 'TM', 'DT')")
    return rows.select("element_id", G.strings().alias("strings"), F.transform(G.person_names(), lambda p: p["alphabetic"]["last_name"]).alias("last_names"))


@query("""
with r as (select p_partkey, p_size - 1 as x, p_size % 7 as y, p_size % 11 as w, p_size as h from part) select p_partkey, greatest(x - 5, 0)::int as x, greatest(y - 5, 0)::int as y, (w + x - greatest(x - 5, 0) + 5)::int as width, (h + y - greatest(y - 5, 0) + 5)::int as height from r
""")
def rect_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles grown by five pixels."""
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", I.expand_rect(size - 1, size % 7, size % 11, size, 5).alias("r")).select("p_partkey", "r.*")


@query("""
with f as (select distinct file from elements), t as (select unnest(['00101010', '00180050']) as tag), e as (select file, tag, bool_or(values_json is not null or inline_binary is not null) as filled from elements where len(path) = 0 group by 1, 2)
select f.file, t.tag, e.file is not null as present, coalesce(filled, false) as has_value from f cross join t left join e on e.file = f.file and e.tag = t.tag
""")
def tag_presence(spark: SparkSession, d: str) -> DataFrame:
    """Whether files have two tags, and values in them."""
    return E.presence(table(spark, d, "elements"), ["00101010", "00180050"])


@query("""
with e as (select element_id, file, path, case tag when '00280010' then '00280106' else tag end as tag, values_json from elements), s as (select file, path, element_id % 2 as sign from elements where tag = '00280100')
, m as (select file, path, max(sign) as sign from s group by all)
select e.element_id, case when e.tag = '00280106' then case when m.sign = 1 then 'SS' else 'US' end when e.tag = '7FE00010' then 'OW' else 'UN' end as vr from e left join m on m.file = e.file and m.path = e.path where e.tag in ('00280106', '7FE00010', '00100020')
""")
def vr_by_context(spark: SparkSession, d: str) -> DataFrame:
    """Representations of which a dictionary allows several, told by the pixel representation of the same data set."""
    rows = table(spark, d, "elements").select("element_id", "file", "path", "tag", "values_json")
    signs = rows.where("tag = '00280100'").groupBy("file", "path").agg(F.max(F.col("element_id") % 2).alias("sign"))
    signs = signs.select(F.lit(None).cast("bigint").alias("element_id"), "file", "path", F.lit("00280103").alias("tag"), F.to_json(F.array("sign")).alias("values_json"))
    made = rows.withColumn("tag", F.when(F.col("tag") == "00280010", "00280106").otherwise(F.col("tag"))).where("tag in ('00280106', '7FE00010', '00100020')").unionByName(signs)
    words = spark.createDataFrame([("00280106", "US or SS", ""), ("7FE00010", "OB or OW", "")], "tag string, vr string, name string")
    return E.infer_vr(made.withColumn("vr", F.lit(None).cast("string")), words).where("tag != '00280103'").select("element_id", "vr")


@query("select element_id, to_base64(inline_binary) as inline from elements where inline_binary is not null")
def base64_inline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").where("inline_binary is not null").select("element_id", S.inline_binary(F.col("inline_binary")).alias("inline"))


@query("""
with t as (select element_id, upper(hex(inline_binary)) as h from elements where inline_binary is not null)
select element_id, '[' || rtrim(regexp_replace(h[1:32], '(..)', '\\1 ', 'g')) || case when len(h) > 32 then ' …' else '' end || ']' as preview from t
""")
def byte_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").where("inline_binary is not null").select("element_id", S.byte_preview(F.col("inline_binary")).alias("preview"))


@query("""
select element_id, upper(regexp_replace(hex(inline_binary), '(..)(..)', '\\2\\1', 'g')) as swapped from elements where inline_binary is not null
""")
def swap_endian(spark: SparkSession, d: str) -> DataFrame:
    """Words of two bytes exchanged."""
    return table(spark, d, "elements").where("inline_binary is not null").select("element_id", F.hex(S.bits_swapped(F.col("inline_binary"), 2)).alias("swapped"))


@query("select event_id, (props->>'$.k')::bigint as k from events")
def json_get(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("select element_id, case when strlen(v) % 2 = 1 then v || ' ' else v end as padded from (select element_id, values_json->>'$[0]' as v from elements where vr = 'LO')")
def pad_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").where("vr = 'LO'").select("element_id", S.pad_even(F.get_json_object("values_json", "$[0]"), "LO").alias("padded"))


# -- elements -----------------------------------------------------------------------------------------------


@query("""
select coalesce(s_nationkey, c_nationkey) as nation, case when s.n is not null then s.n else c.n end as n, case when s.n is not null then s.least else c.least end as least
from (select c_nationkey, count(*) as n, min(c_name) as least from customer group by 1) c
full outer join (select s_nationkey, count(*) as n, min(s_name) as least from supplier group by 1) s on c_nationkey = s_nationkey
""")
def merge_right_wins(spark: SparkSession, d: str) -> DataFrame:
    """Two data sets merged by key; the second wins."""
    left = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.min("c_name").alias("least"))
    right = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.min("s_name").alias("least"))
    return E.merge(left, right, ["nation"])


@query("""
with n as (select distinct file, '00081030' as tag, 'LO' as vr, '["replaced"]' as values_json from elements)
select file, tag, vr, values_json, count(*) as n from (
  select file, tag, vr, values_json from elements where coalesce(path[1].tag, tag) not in ('00081030')
  union all select file, tag, vr, values_json from n) group by all
""")
def insert_elements(spark: SparkSession, d: str) -> DataFrame:
    """A root element replaced in every file."""
    new = spark.createDataFrame([("00081030", "LO", '["replaced"]')], "tag string, vr string, values_json string")
    out = E.insert(table(spark, d, "elements").select("file", "path", "tag", "vr", "values_json"), new)
    return out.groupBy("file", "tag", "vr", "values_json").agg(F.count("*").alias("n"))


_KEEP = """not exists (select 1 from rejected r where r.file = e.file and starts_with(e.p, r.p || '/['))"""
# Written out by hand: group 0008, then 0018 to 3006.
_IDENTIFYING = """
'00080014', '00080050', '00080080', '00080081', '00080082', '00080090', '00080092', '00080094', '00080096', '00080201', '00080420', '00080421', '00081000', '00081010', '00081030', '00081032',
'0008103E', '0008103F', '00081040', '00081041', '00081048', '00081049', '00081050', '00081052', '00081060', '00081062', '00081070', '00081072', '00081080', '00081084',
'00181030', '00200010', '00321033', '00400009', '00400275', '00401102', '00401103', '00401104', '0040A124', '00880140', '30060024'"""


@query(f"""
with e as (select element_id, file, tag, coalesce(vr, 'UN') as vr, {PATH} as p, ('0x' || tag)::bigint >> 16 as g from elements)
, rejected as (select distinct file, p from e where vr = 'SQ' and (g & 1 = 1 or g = 16 or tag in ({_IDENTIFYING})))
select element_id, tag, count(*) as n from e where not (vr = 'AE' or g & 1 = 1 or g = 16 or tag in ({_IDENTIFYING})) and {_KEEP} group by all
""")
def anonymize_elements(spark: SparkSession, d: str) -> DataFrame:
    return E.anonymize(table(spark, d, "elements")).groupBy("element_id", "tag").agg(F.count("*").alias("n"))


@query(f"""
with e as (select element_id, file, tag, vr, {PATH} as p from elements), rejected as (select distinct file, p from e where vr = 'SQ' and tag = '00400275')
select element_id, tag, count(*) as n from e where tag != '00400275' and {_KEEP} and not starts_with(p, '00400275/') group by all
""")
def filter_subtree(spark: SparkSession, d: str) -> DataFrame:
    """Without a sequence and all that lies in it, whether the sequence has a row of its own or not."""
    rows = table(spark, d, "elements")
    return E.delete_tags(rows.where(~F.coalesce(F.get("path", F.lit(0))["tag"] == "00400275", F.lit(False))), ["00400275"]).groupBy("element_id", "tag").agg(F.count("*").alias("n"))


@query("""
select file, min(values_json) filter (tag = '00100010') as patient, min(values_json) filter (tag = '00080060') as modality, min(values_json) filter (tag = '00080020') as study_date
from elements where len(path) = 0 and tag in ('00100010', '00080060', '00080020') group by file
""")
def iod_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A module as one row per file."""
    return E.pivot(table(spark, d, "elements"), {"patient": "00100010", "modality": "00080060", "study_date": "00080020"})


@query("""
with p as (select file, min(values_json) filter (tag = '0020000D') as study, min(values_json) filter (tag = '00101010') as age from elements where len(path) = 0 group by file)
select f.path, study, age, list_filter(['0020000D'], lambda t: study is null) as missing from files f left join p using (file)
""")
def select_required(spark: SparkSession, d: str) -> DataFrame:
    """Selected elements per file, with those that are required and missing."""
    found = E.select(table(spark, d, "files").select("file", "path"), table(spark, d, "elements"), {"study": "0020000D"}, {"age": "00101010"})
    return found.select("path", "study", "age", "missing")


@query("""
with d as (select tag, min(vr) as vr from (select tag, vr from elements where tag in ('00100010', '00080020', '00280100') and vr is not null) group by 1)
select element_id, coalesce(case when e.element_id % 2 = 0 then e.vr end, case when (('0x' || e.tag)::bigint >> 16) & 1 = 1 and ('0x' || e.tag)::bigint & 65535 between 16 and 255 then 'LO' when ('0x' || e.tag)::bigint & 65535 = 0 then 'UL' else coalesce(d.vr, 'UN') end) as vr
from elements e left join d on d.tag = e.tag
""")
def vr_infer(spark: SparkSession, d: str) -> DataFrame:
    """Value representations of every other element taken from a dictionary."""
    rows = table(spark, d, "elements")
    words = rows.where(F.col("tag").isin("00100010", "00080020", "00280100") & F.col("vr").isNotNull()).groupBy("tag").agg(F.min("vr").alias("vr")).withColumn("name", F.lit(""))
    return E.infer_vr(rows.withColumn("vr", F.when(F.col("element_id") % 2 == 0, F.col("vr"))), words).select("element_id", "vr")


@query(f"select element_id, file, values_json from elements where {PATH} = '00400275/[0]/00400007'")
def value_at_path(spark: SparkSession, d: str) -> DataFrame:
    return E.value_at(table(spark, d, "elements"), "00400275/[0]/00400007").select("element_id", "file", "values_json")


@query("""
with v as (select file, coalesce(octet_length(inline_binary), case when vr = 'US' then 2 * json_array_length(values_json) end,
  case when vr = 'PN' then strlen(array_to_string(list_transform(from_json(values_json, '[{"Alphabetic":"VARCHAR","Ideographic":"VARCHAR","Phonetic":"VARCHAR"}]'), lambda p: rtrim(coalesce(p.Alphabetic, '') || '=' || coalesce(p.Ideographic, '') || '=' || coalesce(p.Phonetic, ''), '=')), '\\'))
       else strlen(array_to_string(list_transform(from_json(values_json, '["VARCHAR"]'), lambda x: coalesce(x, '')), '\\')) end, 0) as n from elements)
select file, count(*) as n_elements, sum(n + n % 2 + 8)::bigint as n_bytes from v group by file
""")
def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    return E.byte_sizes(table(spark, d, "elements"))


# -- frames and pixels --------------------------------------------------------------------------------------


@query("""
select least(255, greatest(0, floor(greatest(0, least(1, (l_quantity * 2 - 10 - (40 - 0.5)) / (60 - 1) + 0.5)) * 255 + 0.5)))::int as level, count(*) as n from lineitem group by 1
""")
def voi_linear_hist(spark: SparkSession, d: str) -> DataFrame:
    """Rescaled, windowed and counted grey levels."""
    level = I.to_byte(I.voi_linear(I.rescale(F.col("l_quantity"), 2.0, -10.0), 40.0, 60.0))
    return table(spark, d, "lineitem").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, (l_quantity - 25) / 30 + 0.5)), 6) as level from lineitem")
def voi_linear_exact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(I.voi_linear_exact(F.col("l_quantity"), 25.0, 30.0), 6).alias("level"))


@query("select l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-4 * (l_quantity - 25) / 30)), 6) as level from lineitem")
def voi_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(I.voi_sigmoid(F.col("l_quantity"), 25.0, 30.0), 6).alias("level"))


@query("select l_orderkey, l_linenumber, l_partkey, round(l_quantity * 1.5 - 1024, 6) as rescaled from lineitem")
def modality_rescale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(I.rescale(F.col("l_quantity"), 1.5, -1024.0), 6).alias("rescaled"))


@query("select l_orderkey, l_linenumber, l_partkey, ([0, 10, 30, 60, 100, 150, 210, 255])[least(greatest(l_quantity::int - 10, 0), 7) + 1]::int as level from lineitem")
def lut_clamped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", I.lut(F.col("l_quantity").cast("int"), 10, [0, 10, 30, 60, 100, 150, 210, 255]).alias("level"))


@query("""
select p_partkey, ([0, 128, 255, 64])[least(p_size % 8, 3) + 1]::int as r, ([10, 20, 30, 40])[least(p_size % 8, 3) + 1]::int as g, ([255, 0, 255, 0])[least(p_size % 8, 3) + 1]::int as b from part
""")
def palette_rgb(spark: SparkSession, d: str) -> DataFrame:
    colour = I.palette(F.col("p_size") % 8, [0, 128, 255, 64], [10, 20, 30, 40], [255, 0, 255, 0])
    return table(spark, d, "part").select("p_partkey", colour.alias("c")).select("p_partkey", "c.*")


_RGB = "(select p_partkey, (p_size * 5 % 256)::double as r, (p_partkey % 256)::double as g, (floor(p_retailprice) % 256)::double as b from part)"


@query(f"""
select p_partkey, least(255, greatest(0, floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)))::int as y, least(255, greatest(0, floor(-0.168736 * r - 0.331264 * g + 0.5 * b + 128 + 0.5)))::int as cb,
  least(255, greatest(0, floor(0.5 * r - 0.418688 * g - 0.081312 * b + 128 + 0.5)))::int as cr from {_RGB}
""")
def rgb_to_ybr(spark: SparkSession, d: str) -> DataFrame:
    r, g, b = (F.col("p_size") * 5 % 256).cast("double"), (F.col("p_partkey") % 256).cast("double"), (F.floor("p_retailprice") % 256).cast("double")
    return table(spark, d, "part").select("p_partkey", I.rgb_to_ybr(r, g, b).alias("c")).select("p_partkey", "c.*")


@query(f"select vec_id, list_transform(range(0, 32), lambda i: floor((px[2 * i + 1] + px[2 * i + 2]) / 2.0 + 0.5)::int) as chroma from {PIXELS}")
def ybr_422(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("vec_id", I.halve_chroma(F.col("px")).alias("chroma"))


@query(f"select vec_id, list_min(px) as least, list_max(px) as most, (list_min(px) + list_max(px)) / 2.0::double as center, (list_max(px) - list_min(px)) as width from {PIXELS}")
def minmax_window(spark: SparkSession, d: str) -> DataFrame:
    """Extremes of an image and the window that covers them."""
    least, most = F.array_min("px"), F.array_max("px")
    return _pixels(spark, d).select("vec_id", least.alias("least"), most.alias("most"), I.default_window(least, most).alias("w")).select("vec_id", "least", "most", "w.*")


@query("select vec_id, round(avg(e), 6) as mean, round(stddev_pop(e), 6) as sd from (select vec_id, unnest(embedding)::double as e from embeddings) group by 1")
def image_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread per image, within the row."""
    found = table(spark, d, "embeddings").select("vec_id", I.statistics(F.transform("embedding", lambda e: e.cast("double"))).alias("v"))
    return found.select("vec_id", F.round("v.mean", 6).alias("mean"), F.round("v.sd", 6).alias("sd"))


@query(f"select vec_id, list_concat(px[11:14], px[19:22], px[27:30]) as px from {PIXELS}")
def crop_rect(spark: SparkSession, d: str) -> DataFrame:
    """Four columns from the third, three rows from the second."""
    return _pixels(spark, d).select("vec_id", I.crop(F.col("px"), 8, 2, 1, 4, 3).alias("px"))


@query(f"select vec_id, list_transform(px, lambda p: 255 - p) as px from {PIXELS}")
def mono_invert(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("vec_id", F.transform("px", lambda p: I.invert(p, 255)).alias("px"))


@query(f"""
select vec_id, list_transform(range(0, 64), lambda i: px[(i // 8) * 8 + (7 - i % 8) + 1]) as flipped, list_transform(range(0, 64), lambda i: px[(7 - i % 8) * 8 + i // 8 + 1]) as turned,
  list_reverse(px) as half, list_transform(range(0, 64), lambda i: px[(7 - i // 8) * 8 + i % 8 + 1]) as upside_down from {PIXELS}
""")
def flip_rotate(spark: SparkSession, d: str) -> DataFrame:
    px = F.col("px")
    return _pixels(spark, d).select("vec_id", I.flip_horizontal(px, 8).alias("flipped"), I.rotate_90(px, 8).alias("turned"), I.rotate_180(px).alias("half"), I.flip_vertical(px, 8).alias("upside_down"))


@query("select p_partkey, (p_size >> 0) & 1 = 1 as plane_0, (p_size >> 3) & 1 = 1 as plane_3 from part")
def overlay_bits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", I.overlay_bit(F.col("p_size"), 0).alias("plane_0"), I.overlay_bit(F.col("p_size"), 3).alias("plane_3"))


@query(f"select vec_id, list_transform(px, lambda p, i: case when (i - 1) % 8 between 2 and 4 and (i - 1) // 8 between 1 and 2 then 0 else p end) as px from {PIXELS}")
def black_out(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("vec_id", I.black_out(F.col("px"), 8, 2, 1, 3, 2, F.lit(0)).alias("px"))


# -- waveforms ----------------------------------------------------------------------------------------------


# -- windows of time ----------------------------------------------------------------------------------------


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The streaming window over a table."""
    return streams.tumbling(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select time_bucket(interval 15 minutes, ts) - to_minutes((15 * k)::int) as start, event_type, count(*) as n from events, (select unnest(range(0, 4)) as k) group by 1, 2")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of an hour every quarter."""
    return streams.sliding(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events)
, s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k
""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end after six quiet hours."""
    return streams.sessions(table(spark, d, "events").where("user_id is not null")).withColumn("start", F.col("start").cast("timestamp_ntz"))
