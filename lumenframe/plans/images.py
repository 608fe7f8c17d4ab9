"""Queries of the operators on data sets: frames, images, waveforms, modules, private blocks and printing, with their SQL.

The driver tables hold no pixels, waveforms or private elements, so data sets are made of their rows first: each of the embeddings is an image
of 8×8 pixels or a waveform of 8 channels and 8 samples.  What is made goes through the same elements table, and the same operators, as files do.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import pixeldata as P
from lumenframe.functions import printing
from lumenframe.operators import elements as E
from lumenframe.operators import modules, pixels, waveforms
from lumenframe.session import table
from lumenframe.sources import charsets, dicom_json, p10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PATH = "array<struct<tag:string,item:int>>"
#: Grey levels 0 to 200 as SQL, from embeddings between -1 and 1.
IMAGES = "(select vec_id, list_transform(embedding, lambda e: cast(floor((e::double + 1) * 100) as int)) as px from embeddings)"
WORDS = "array_to_string(list_transform({}, lambda x: format('{{:02X}}', x % 256) || format('{{:02X}}', x // 256)), '')"


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("file"), F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 100).cast("int")).alias("px"))


def _bytes(words: Column) -> Column:
    """Little-endian words of 16 bits."""
    each = F.transform(words, lambda x: F.lpad(F.hex(F.when(x < 0, x + 65_536).otherwise(x)), 4, "0"))
    return F.unhex(F.array_join(F.transform(each, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), ""))


def _row(tag: str, vr: str, values: Column | None = None, data: Column | None = None, path: Column | None = None, fragments: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        (path if path is not None else F.array().cast(PATH)).alias("path"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), (values if values is not None else null).cast("string").alias("values_json"),
        (data if data is not None else null).cast("binary").alias("inline_binary"), (fragments if fragments is not None else null).cast("array<binary>").alias("fragments"),
    )


def _values(*held: object) -> Column:
    return F.lit(json.dumps(list(held)))


def _data_sets(rows: DataFrame, *more: Column, syntax: str = p10.EXPLICIT, photometric: str = "MONOCHROME2", frames: int = 1, signed: int = 0, words: Column | None = None, pixel: Column | None = None) -> DataFrame:
    """Elements of one image per row of ``rows`` (file, px)."""
    head = [
        _row("00020010", "UI", _values(syntax)), _row("00280002", "US", _values(1)), _row("00280004", "CS", _values(photometric)), _row("00280008", "IS", _values(frames)), _row("00280010", "US", _values(8 // frames)),
        _row("00280011", "US", _values(8)), _row("00280100", "US", _values(16)), _row("00280101", "US", _values(16)), _row("00280103", "US", _values(signed)),
    ]
    body = pixel if pixel is not None else _row("7FE00010", "OW", data=_bytes(words if words is not None else F.col("px")))
    return rows.select("file", F.inline(F.array(*head, *more, body)))


def _shown(images: DataFrame) -> DataFrame:
    return images.select(F.col("file").cast("bigint").alias("vec_id"), "frame_index", "pixels")


# -- frames -------------------------------------------------------------------------------------------------


@query(f"select vec_id, i::int as frame_index, {WORDS.format('px[(i * 32 + 1):(i * 32 + 32)]')} as data from (select vec_id, px, unnest([0, 1]) as i from {IMAGES})")
def frames_native_split(spark: SparkSession, d: str) -> DataFrame:
    """Two frames of 4×8 pixels cut out of native pixel data."""
    found = pixels.frames(_data_sets(_levels(spark, d), frames=2))
    return found.select(F.col("file").cast("bigint").alias("vec_id"), "frame_index", F.hex("data").alias("data"))


@query(ORACLE["frames_native_split"])
def frames_offset_table(spark: SparkSession, d: str) -> DataFrame:
    """The same frames from four fragments, told apart by a basic offset table."""
    data = _bytes(F.col("px"))
    parts = [F.substring(data, 1 + 32 * i, 32) for i in range(4)]
    row = _row("7FE00010", "OB", fragments=F.array(F.unhex(F.lit("0000000050000000")), *parts))
    found = pixels.frames(_data_sets(_levels(spark, d), frames=2, syntax=P.RLE, pixel=row))
    return found.select(F.col("file").cast("bigint").alias("vec_id"), "frame_index", F.hex("data").alias("data"))


@query(ORACLE["frames_native_split"])
def frames_extended_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The same frames by an extended offset table and its lengths."""
    data = _bytes(F.col("px"))
    parts = [F.substring(data, 1 + 64 * i, 64) for i in range(2)]
    rows = [_row("7FE00001", "OV", data=F.unhex(F.lit("0000000000000000" + "4800000000000000"))), _row("7FE00002", "OV", data=F.unhex(F.lit("4000000000000000" * 2)))]
    row = _row("7FE00010", "OB", fragments=F.array(F.unhex(F.lit("")), *parts))
    found = pixels.frames(_data_sets(_levels(spark, d), *rows, frames=2, syntax=P.RLE, pixel=row))
    return found.select(F.col("file").cast("bigint").alias("vec_id"), "frame_index", F.hex("data").alias("data"))


@query(f"select vec_id, 0::int as frame_index, list_transform(px, lambda x: x - 100) as pixels from {IMAGES}")
def stored_values_signed(spark: SparkSession, d: str) -> DataFrame:
    """Signed stored values of native images."""
    return _shown(pixels.stored_values(_data_sets(_levels(spark, d), signed=1, words=F.transform("px", lambda x: x - 100))))


@query(f"select vec_id, 0::int as frame_index, list_transform(px, lambda x: x % 2) as pixels from {IMAGES}")
def stored_values_bits(spark: SparkSession, d: str) -> DataFrame:
    """Images of single bits, least significant first."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.lpad(F.hex(F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, c: s + F.call_function("shiftleft", F.lit(1), c) * (F.get("px", r * 8 + c) % 2))), 2, "0"))
    rows = _data_sets(_levels(spark, d), pixel=_row("7FE00010", "OB", data=F.unhex(F.array_join(bits, ""))))
    return _shown(pixels.stored_values(rows.withColumn("values_json", F.when(F.col("tag").isin("00280100", "00280101"), "[1]").otherwise(F.col("values_json")))))


@query(f"select vec_id, i::int as frame_index, px[(i * 32 + 1):(i * 32 + 32)] as pixels from (select vec_id, px, unnest([0, 1]) as i from {IMAGES})")
def transcoded_rle(spark: SparkSession, d: str) -> DataFrame:
    """Native frames coded by run lengths within their data sets, then decoded."""
    coded, _ = pixels.transcoded_elements(_data_sets(_levels(spark, d), frames=2), P.RLE)
    return _shown(pixels.stored_values(coded))


@query(ORACLE["transcoded_rle"])
def transcoded_deflated(spark: SparkSession, d: str) -> DataFrame:
    """Deflated frame by frame, back to native, then decoded."""
    coded, _ = pixels.transcoded_elements(_data_sets(_levels(spark, d), frames=2), P.DEFLATED_FRAME)
    native, _ = pixels.transcoded_elements(coded, p10.EXPLICIT)
    return _shown(pixels.stored_values(native))


@query(f"select vec_id, vec_id::varchar || '.0000.bin' as name, {WORDS.format('px')} as data from {IMAGES}")
def frame_files_raw(spark: SparkSession, d: str) -> DataFrame:
    """A file per frame, as it lies in the data set."""
    return pixels.image_files(_data_sets(_levels(spark, d)), "raw").select(F.col("file").cast("bigint").alias("vec_id"), "name", F.hex("content").alias("data"))


# -- rendering ----------------------------------------------------------------------------------------------

_LINEAR = "greatest(0, least(1, (x - 99.5) / 200 + 0.5))"


@query(f"select vec_id, 0::int as frame_index, list_transform(list_transform(px, lambda x: x * 2 - 50), lambda x: floor({_LINEAR} * 255 + 0.5)::int) as pixels from {IMAGES}")
def rendered_window(spark: SparkSession, d: str) -> DataFrame:
    """Rescaled by slope and intercept, then through the window of the file."""
    steps = [_row("00281053", "DS", _values(2)), _row("00281052", "DS", _values(-50)), _row("00281050", "DS", _values(100)), _row("00281051", "DS", _values(201))]
    return _shown(pixels.rendered(_data_sets(_levels(spark, d), *steps)))


@query(f"select vec_id, 0::int as frame_index, list_transform(px, lambda x: floor((1 - {_LINEAR}) * 255 + 0.5)::int) as pixels from {IMAGES}")
def rendered_inverse(spark: SparkSession, d: str) -> DataFrame:
    """White is low."""
    steps = [_row("00281050", "DS", _values(100)), _row("00281051", "DS", _values(201))]
    return _shown(pixels.rendered(_data_sets(_levels(spark, d), *steps, photometric="MONOCHROME1")))


@query(f"select vec_id, 0::int as frame_index, list_transform(px, lambda x: ([51, 102, 153, 255])[least(greatest(least(greatest(x - 60, 0), 4) * 10 - 10, 0), 30) // 10 + 1]) as pixels from {IMAGES}")
def rendered_tables(spark: SparkSession, d: str) -> DataFrame:
    """A modality table, then a table of values of interest, both in sequences."""
    at = lambda tag: F.array(F.struct(F.lit(tag).alias("tag"), F.lit(0).alias("item"))).cast(PATH)
    interest = [51] * 10 + [102] * 10 + [153] * 10 + [255]
    steps = [
        _row("00283002", "US", _values(5, 60, 16), path=at("00283000")), _row("00283006", "US", _values(0, 10, 20, 30, 40), path=at("00283000")),
        _row("00283002", "US", _values(31, 10, 8), path=at("00283010")), _row("00283006", "US", _values(*interest), path=at("00283010")),
    ]
    return _shown(pixels.rendered(_data_sets(_levels(spark, d), *steps)))


@query(f"select vec_id, 0::int as frame_index, list_transform(px, lambda x: ([0, 51, 255])[floor(greatest(0, least(1, (x - 99.5) / 200 + 0.5)) * 2 + 0.5)::int + 1]) as pixels from {IMAGES}")
def rendered_presentation(spark: SparkSession, d: str) -> DataFrame:
    """Through the window of the file, then a presentation table over its whole range."""
    at = F.array(F.struct(F.lit("20500010").alias("tag"), F.lit(0).alias("item"))).cast(PATH)
    steps = [_row("00281050", "DS", _values(100)), _row("00281051", "DS", _values(201)), _row("00283002", "US", _values(3, 0, 8), path=at), _row("00283006", "US", _values(0, 51, 255), path=at)]
    return _shown(pixels.rendered(_data_sets(_levels(spark, d), *steps)))


@query(f"select vec_id, 0::int as frame_index, flatten(list_transform(px, lambda x: [([0, 128, 255, 64])[least(x % 6, 3) + 1], ([10, 20, 30, 40])[least(x % 6, 3) + 1], ([255, 0, 255, 0])[least(x % 6, 3) + 1]])) as pixels from {IMAGES}")
def rendered_palette(spark: SparkSession, d: str) -> DataFrame:
    """Palette indexes as colours; those beyond the table take its last entry."""
    tables = [[0, 128, 255, 64], [10, 20, 30, 40], [255, 0, 255, 0]]
    steps = [_row(f"0028110{i}", "US", _values(4, 0, 8)) for i in (1, 2, 3)] + [_row(f"0028120{i + 1}", "OW", data=F.unhex(F.lit("".join(f"{x:02X}00" for x in t)))) for i, t in enumerate(tables)]
    return _shown(pixels.rendered(_data_sets(_levels(spark, d), *steps, photometric="PALETTE COLOR", words=F.transform("px", lambda x: x % 6))))


@query(f"select vec_id, 0::int as frame_index, flatten(list_transform(px, lambda x: [least(255, 2 * x), greatest(0, 2 * (x - 128)), greatest(0, 4 * (x - 191))])) as pixels from {IMAGES}")
def rendered_hot_iron(spark: SparkSession, d: str) -> DataFrame:
    """Grey levels through a palette of the standard."""
    return _shown(pixels.rendered(_data_sets(_levels(spark, d)), window=(127.5, 255.0), colours="HOT_IRON"))


@query(f"select vec_id, 0::int as frame_index, list_transform(px, lambda x, i: case when i > 8 and (i - 1) % 8 > 0 and (i - 1) % 8 % 2 = 0 then 255 else x end) as pixels from {IMAGES}")
def rendered_overlay(spark: SparkSession, d: str) -> DataFrame:
    """An overlay of 7×7 pixels with every other column set, from row and column 2 on."""
    bits = [int(c % 2 == 1) for _ in range(7) for c in range(7)]
    data = bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, 49, 8)) + b"\0"
    steps = [_row("60000010", "US", _values(7)), _row("60000011", "US", _values(7)), _row("60000050", "SS", _values(2, 2)), _row("60003000", "OW", data=F.unhex(F.lit(data.hex())))]
    return _shown(pixels.rendered(_data_sets(_levels(spark, d), *steps), window=(127.5, 255.0), overlays=True))


@query(f"select vec_id, 0::int as frame_index, list_transform(range(0, 12), lambda j: px[(3 - j % 3) * 8 + 2 + j // 3 + 1]) as pixels from {IMAGES}")
def rendered_turned(spark: SparkSession, d: str) -> DataFrame:
    """Four columns from the third and three rows from the second, turned by 90 degrees."""
    return _shown(pixels.rendered(_data_sets(_levels(spark, d)), window=(127.5, 255.0), crop=(2, 1, 4, 3), orientation="rotate-90"))


# -- waveforms ----------------------------------------------------------------------------------------------

_SAMPLES = "(select vec_id, list_transform(embedding, lambda e: cast(floor(e::double * 1000) as bigint)) as x from embeddings)"


def _waveforms(spark: SparkSession, d: str) -> DataFrame:
    at = F.array(F.struct(F.lit("54000100").alias("tag"), F.lit(0).alias("item"))).cast(PATH)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("file"), F.transform("embedding", lambda e: F.floor(e.cast("double") * 1000).cast("int")).alias("x"))
    held = [_row("003A0005", "US", _values(8), path=at), _row("003A0010", "UL", _values(8), path=at), _row("54001006", "CS", _values("SS"), path=at), _row("54001010", "OW", data=_bytes(F.col("x")), path=at)]
    return rows.select("file", F.inline(F.array(*held)))


@query(f"select vec_id, (i % 8)::int as channel_ix, (i // 8)::bigint as sample_ix, x[i + 1] as value from (select vec_id, x, unnest(range(0, 64)) as i from {_SAMPLES})")
def waveform_samples(spark: SparkSession, d: str) -> DataFrame:
    """Interleaved samples told apart by channel."""
    return waveforms.samples(_waveforms(spark, d)).select(F.col("file").cast("bigint").alias("vec_id"), "channel_ix", "sample_ix", "value")


@query(f"select vec_id, c::int as channel_ix, (k * 3)::bigint as first_sample, list_transform(range(k * 3, least(8, k * 3 + 3)), lambda s: x[s * 8 + c + 1]) as samples from (select vec_id, x, unnest(range(0, 8)) as c from {_SAMPLES}), (select unnest(range(0, 3)) as k)")
def waveform_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of three whole sample sets of eight channels."""
    return waveforms.chunks(_waveforms(spark, d), 3).select(F.col("file").cast("bigint").alias("vec_id"), "channel_ix", "first_sample", "samples")


@query(f"select vec_id, {WORDS.format('list_transform(x, lambda v: (v + 65536) % 65536)')} as data from {_SAMPLES}")
def waveform_written(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written back as waveform data."""
    found = waveforms.encoded(waveforms.chunks(_waveforms(spark, d), 3), "SS").where("tag = '54001010' and error is null")
    return found.select(F.col("file").cast("bigint").alias("vec_id"), F.hex("inline_binary").alias("data"))


@query("select vec_id, 0::int as item_ix, 8::int as n_channels, 8::bigint as n_samples, 'SS' as interpretation from embeddings")
def waveform_groups(spark: SparkSession, d: str) -> DataFrame:
    """The multiplex groups of waveforms as typed rows."""
    return modules.sequence_items(_waveforms(spark, d), "54000100").select(F.col("file").cast("bigint").alias("vec_id"), "item_ix", "n_channels", "n_samples", "interpretation")


@query(f"select vec_id, list_min(x) >= -128 and list_max(x) <= 127 as fits from {_SAMPLES}")
def waveform_range(spark: SparkSession, d: str) -> DataFrame:
    """Whether samples fit eight bits."""
    return waveforms.in_range(waveforms.chunks(_waveforms(spark, d)), "SB").select(F.col("file").cast("bigint").alias("vec_id"), "fits")


# -- modules and elements -----------------------------------------------------------------------------------


@query("""
select p_partkey, i::int as frame_index, round(p_retailprice, 2) as duration_ms, round(i * p_retailprice, 2) as at_ms, not (i + 1 between 2 and 4) as trimmed
from (select p_partkey, p_retailprice, unnest(range(0, p_size % 5 + 1)) as i from part)
""")
def cine_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of frames by the cine module, read from elements."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), "p_size", "p_retailprice")
    held = [_row("00280008", "IS", F.to_json(F.array(F.col("p_size") % 5 + 1))), _row("00181063", "DS", F.to_json(F.array("p_retailprice"))), _row("00082142", "IS", _values(2)), _row("00082143", "IS", _values(4))]
    timed = modules.frame_times(modules.module(rows.select("file", F.inline(F.array(*held))), "cine"))
    return timed.select(F.col("file").cast("bigint").alias("p_partkey"), "frame_index", F.round("duration_ms", 2).alias("duration_ms"), F.round("at_ms", 2).alias("at_ms"), "trimmed")


@query("""
select file, (min(values_json) filter (tag = '00280010')->>'$[0]')::int as n_rows, (min(values_json) filter (tag = '00280100')->>'$[0]')::int as bits_allocated
from elements where len(path) = 0 and tag in ('00280002', '00280004', '00280006', '00280010', '00280011', '00280100', '00280101', '00280102', '00280103') group by file
""")
def image_pixel_module(spark: SparkSession, d: str) -> DataFrame:
    """A module as typed columns."""
    return modules.module(table(spark, d, "elements"), "image_pixel").select("file", "n_rows", "bits_allocated")


@query("""
with n as (select c_custkey::varchar as file, '00100010' as tag, 'PN' as vr, to_json([{'Alphabetic': c_name}])::varchar as v from customer union all select c_custkey::varchar, '00101010', 'AS', null from customer
  union all select c_custkey::varchar, '00081030', 'LO', '["kept"]' from customer)
select file, tag, vr, v as values_json from n where v is not null union all select c_custkey::varchar, '00100020', 'LO', '["' || c_custkey || '"]' from customer
""")
def insert_module(spark: SparkSession, d: str) -> DataFrame:
    """Columns written as elements of a module, over elements of the same tags; null columns leave what is there."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file"), "c_name")
    old = rows.select("file", F.inline(F.array(_row("00100010", "PN", _values("old")), _row("00081030", "LO", _values("kept")))))
    values = rows.select("file", F.col("c_name").alias("name"), F.col("file").alias("id"), F.lit(None).cast("string").alias("study"))
    return E.insert_module(old, values, {"name": ("00100010", "PN"), "id": ("00100020", "LO"), "study": ("00081030", "LO")}).select("file", "tag", "vr", "values_json")


@query("""
with e as (select element_id, file, tag from elements where len(path) = 0), g as (select * from e where tag in ('00080016', '00080018'))
select element_id, file, case tag when '00080016' then '00020002' else '00020003' end as tag from g
""")
def file_meta(spark: SparkSession, d: str) -> DataFrame:
    """File meta information made from the data set."""
    return E.file_meta(table(spark, d, "elements")).select("element_id", "file", "tag")


@query("""
select element_id, coalesce(max(tag) over (partition by file, path order by element_id rows between unbounded preceding and 1 preceding) > tag, false) as late
from (select element_id, min(file) as file, min(path) as path, min(tag) as tag from elements group by 1)
""")
def order_violations(spark: SparkSession, d: str) -> DataFrame:
    """Elements that come after a greater tag of their data set."""
    one = table(spark, d, "elements").groupBy("element_id").agg(F.min(F.struct("file", "path", "tag")).alias("v")).select("element_id", "v.*")
    return E.order_violations(one).select("element_id", "late")


_PRIVATE = """
(select element_id, file, path, tag, values_json from elements where tag not in ('00100020', '00080016', '00080018', '00080060')
 union all select element_id, file, path, '00110010', '["ACME"]' from elements where tag = '00080060'
 union all select element_id, file, path, '00111001', values_json from elements where tag = '00100020'
 union all select element_id, file, path, '00112001', values_json from elements where tag in ('00080016', '00080018'))
"""


def _with_private(spark: SparkSession, d: str) -> DataFrame:
    """Elements, some of them made private: with a block, and in a block that nobody reserves."""
    tag, values = F.col("tag"), F.col("values_json")
    private = F.when(tag == "00080060", "00110010").when(tag == "00100020", "00111001").when(tag.isin("00080016", "00080018"), "00112001").otherwise(tag)
    return table(spark, d, "elements").withColumns({"tag": private, "values_json": F.when(tag == "00080060", '["ACME"]').otherwise(values)})


@query(f"""
with e as {_PRIVATE}, c as (select distinct file, path from e where tag = '00110010')
select e.element_id, e.tag, case when e.tag = '00111001' and c.file is not null then 'ACME' end as private_creator from e left join c on c.file = e.file and c.path = e.path where e.tag in ('00111001', '00112001')
""")
def private_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Private elements with the creator of their block."""
    return E.private_blocks(_with_private(spark, d)).select("element_id", "tag", "private_creator")


@query(f"select element_id, tag from {_PRIVATE} where tag not like '0011%'")
def delete_private_blocks(spark: SparkSession, d: str) -> DataFrame:
    return E.delete_private(_with_private(spark, d)).select("element_id", "tag")


@query("""
with p as (select element_id, rtrim(values_json->>'$[0]') as v from elements where tag = '00100020' and values_json is not null and len(path) = 0)
select element_id, rpad('(0010,0020) LO Patient ID', 52, ' ') || '[' || lpad((strlen(v) + strlen(v) % 2)::varchar, 6, ' ') || ' bytes] "' || v || '"' as line from p where v != ''
""")
def print_line(spark: SparkSession, d: str) -> DataFrame:
    """An element as it is printed: name padded to a column, length, value."""
    rows = table(spark, d, "elements").where("tag = '00100020' and values_json is not null and size(path) = 0").where(F.rtrim(F.get_json_object("values_json", "$[0]")) != "")
    names = ["element_id", "path", "tag", "vr", "values_json", "inline_binary"]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            text = ["\n".join(printing.lines([dicom_json.element(r)], 1_000)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["element_id", "line"])

    return rows.select(*names).mapInArrow(run, "element_id bigint, line string")


# Bytes written out by hand, with their declared character sets.
_CODED = [(1, "4DFC6C6C6572", "ISO_IR 100"), (2, "4DC3BC6C6C6572", "ISO_IR 192"), (3, "BCD8E8D0", "ISO_IR 144"), (6, "4A6F73E9", "ISO_IR 100"), (7, "41", None)]


@query("select * from (values (1, 'Müller'), (2, 'Müller'), (3, 'Миша'), (6, 'José'), (7, 'A')) as t(id, text)")
def charset_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Bytes in several declared character sets as text."""
    rows = spark.createDataFrame(_CODED, "id int, data string, declared string").withColumn("data", F.unhex("data"))
    return charsets.decode_column(rows, "data", "declared", "text").select("id", "text")


@query("""
with e as (select file, path, tag, min((element_id, coalesce(vr, 'UN'), values_json)) as v from elements where file is not null and tag != '00080005' group by all)
select file, tag, array_to_string(list_transform(path, lambda p: p.tag || '/[' || p.item || ']'), '/') as at, v[2] as vr, case when v[2] in ('UI', 'DA', 'IS', 'US') then v[3]->>'$[0]' end as value from e
""")
def part10_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Every data set written as a Part 10 file and read again: all elements at their places, with their values."""
    from lumenframe.plans.codecs import COLUMNS, _elements

    kinds = pa.schema([("file", pa.string()), ("content", pa.binary())])

    def run(part: pa.Table) -> pa.Table:
        held = part.to_pylist()
        return pa.table([pa.array([held[0]["file"]]), pa.array([p10.write(dicom_json.element(r) for r in held)], pa.binary())], schema=kinds)

    from lumenframe.sources import datasource

    files = _elements(spark, d).select(*COLUMNS).groupBy("file").applyInArrow(run, "file string, content binary").withColumnRenamed("file", "path")
    rows = datasource.parsed(files).where("error is null and vr != 'SQ' and tag != '00080005' and tag not like '0002%'")
    at = F.array_join(F.transform("path", lambda p: F.concat(p["tag"], F.lit("/["), p["item"].cast("string"), F.lit("]"))), "/")
    value = F.when(F.col("vr").isin("UI", "DA", "IS", "US"), F.get_json_object("values_json", "$[0]"))
    return rows.select("file", "tag", at.alias("at"), "vr", value.alias("value"))


@query("select file, (min(values_json) filter (tag = '00280010')->>'$[0]')::bigint * 2 as twice, case when min(values_json) filter (tag = '00280010') is null then 'IndexError: list index out of range' end as error from elements where len(path) = 0 and tag in ('00280010', '00080060') group by file")
def derived_type(spark: SparkSession, d: str) -> DataFrame:
    """A type of one's own, made by a function from the values of two tags."""
    return E.derived(table(spark, d, "elements"), {"rows": "00280010", "modality": "00080060"}, lambda v: {"twice": 2 * int(v["rows"][0])}, "twice bigint")


@query("select c_custkey, 'LO' as vr, '[\"' || c_name || '\"]' as values_json from customer")
def elements_of_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Part 10 files in a column of bytes, read by the table function in SQL."""
    from lumenframe.sources import datasource

    datasource.register(spark)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            made = [p10.write([p10.Element((), 0x00100020, "LO", dicom_json.V.from_json([name], "LO"))]) for name in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["c_custkey", "content"])

    files = table(spark, d, "customer").select("c_custkey", "c_name").mapInArrow(run, "c_custkey bigint, content binary")
    return spark.sql("select c_custkey, e.vr, e.values_json from {files} f, lateral dicom_elements(f.content) e where e.tag = '00100020'", files=files)


@query(ORACLE["part10_read_back"])
def json_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Every data set written as DICOM JSON and read again."""
    from lumenframe.plans.codecs import _elements

    rows = dicom_json.json_to_elements(dicom_json.elements_to_json(_elements(spark, d))).where("error is null and vr != 'SQ'")
    at = F.array_join(F.transform("path", lambda p: F.concat(p["tag"], F.lit("/["), p["item"].cast("string"), F.lit("]"))), "/")
    value = F.when(F.col("vr").isin("UI", "DA", "IS", "US"), F.get_json_object("values_json", "$[0]"))
    return rows.select("file", "tag", at.alias("at"), "vr", value.alias("value"))
