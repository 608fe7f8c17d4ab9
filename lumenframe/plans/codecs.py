"""Queries of the codecs over the elements table: what is written must be read back the same.

They need parsers in Python and have no SQL; their columns say for each file whether the round trip holds.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import printing
from lumenframe.session import table
from lumenframe.sources import dicom_json, p10

COLUMNS = ["file", "path", "tag", "vr", "values_json", "inline_binary"]


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements once per place; the first received counts."""
    rows = table(spark, d, "elements").where("file is not null and tag rlike '^[0-9A-Fa-f]{8}$'")
    first = F.min(F.struct("element_id", "vr", "values_json", "inline_binary")).alias("v")
    # Spread by file first: what works on whole files then needs no second shuffle.
    return rows.repartition("file").groupBy("file", "path", "tag").agg(first).select("file", "path", "tag", "v.vr", "v.values_json", "v.inline_binary")


def _round_trip(rows: DataFrame, syntax: str) -> DataFrame:
    schema = pa.schema([("file", pa.string()), ("n_bytes", pa.int64()), ("n_elements", pa.int64()), ("same", pa.bool_())])

    def run(part: pa.Table) -> pa.Table:
        held = part.to_pylist()
        try:
            written = [dicom_json.element(r) for r in held]
            data = p10.write(written, syntax)
            words = {e.tag: e.vr for e in written}
            read = [e for e in p10.Walker(data, p10.Config(dictionary=words)).elements() if e.tag >> 16 != 2]
            same = json.loads(dicom_json.write(written)) == json.loads(dicom_json.write(read))
            out = (held[0]["file"], len(data), len(read), same)
        except (ValueError, TypeError, AttributeError, KeyError):
            out = (held[0]["file"], None, None, False)
        return pa.table([pa.array([x], t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    return rows.select(*COLUMNS).groupBy("file").applyInArrow(run, "file string, n_bytes bigint, n_elements bigint, same boolean")


def part10_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every data set as a Part 10 file, explicit little endian, and back."""
    return _round_trip(_elements(spark, d), p10.EXPLICIT)


def part10_round_trip_deflated(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(_elements(spark, d), p10.DEFLATED)


def part10_round_trip_implicit(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(_elements(spark, d), p10.IMPLICIT)


def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every data set as one DICOM JSON text."""
    return dicom_json.elements_to_json(_elements(spark, d))


def module_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the waveform modules, read from their JSON texts."""
    texts = table(spark, d, "waveform_modules").where("module_json is not null").select(F.col("module_id").cast("string").alias("file"), F.col("module_json").alias("text"))
    rows = dicom_json.json_to_elements(texts)
    return rows.groupBy("tag", "vr").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_modules"))


def printed_data_sets(spark: SparkSession, d: str) -> DataFrame:
    """Every data set as aligned text."""

    def run(part: pa.Table) -> pa.Table:
        held = part.to_pylist()
        try:
            text = "\n".join(printing.lines(dicom_json.element(r) for r in held))
        except (ValueError, TypeError, AttributeError, KeyError) as e:
            text = f"error: {e}"
        return pa.table({"file": [held[0]["file"]], "text": [text]})

    return _elements(spark, d).select(*COLUMNS).groupBy("file").applyInArrow(run, "file string, text string")


QUERIES = {f.__name__: f for f in (part10_round_trip, part10_round_trip_deflated, part10_round_trip_implicit, json_documents, module_elements, printed_data_sets)}
