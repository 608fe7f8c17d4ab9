"""Lines of data element headers: valid ones typed, the others with the reason.

Quoting is judged per line against RFC 4180, column counts by pyarrow's CSV reader and its callback for invalid rows,
fields are read as strings and then cast as vectors, so that each failing cell can be named.

Defined results: a null line is rejected as ``null_line``; an empty one has too few columns; the first reason in
the order quoting, columns, tag, vr, length, offset is given; a valid line may have an empty file or keyword.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame

# Fixed values of the standard: the value representations by the width of their length field.
SHORT_VRS = ["AE", "AS", "AT", "CS", "DA", "DS", "DT", "FD", "FL", "IS", "LO", "LT", "PN", "SH", "SL", "SS", "ST", "TM", "UI", "UL", "US"]
LONG_VRS = ["OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"]
UNDEFINED_VRS = ["SQ", "UN", "OB", "OW"]
SHORT_MOST, LONG_MOST, UNDEFINED = 65_535, 4_294_967_294, 4_294_967_295

FIELDS = ["file", "tag", "vr", "length", "offset", "keyword"]
QUOTING = r'(?s)\A(?:[^",\r\n]*|"(?:[^"]|"")*")(?:,(?:[^",\r\n]*|"(?:[^"]|"")*"))*\z'
OUT = pa.schema(
    [("line_id", pa.int64()), ("valid", pa.bool_()), ("reason", pa.string()), ("file", pa.string()), ("tag", pa.string()), ("vr", pa.string()), ("length", pa.int64()), ("offset", pa.decimal128(38, 0)), ("keyword", pa.string())]
)
DDL = "line_id bigint, valid boolean, reason string, file string, tag string, vr string, length bigint, offset decimal(38,0), keyword string"


def _read(raw: pa.Array, rows: pa.Array) -> tuple[pa.Table, set[int]]:
    """Fields of the well-quoted lines as strings with their row numbers, and the rows with a wrong count of columns."""
    wrong: set[int] = set()

    def reject(row: csv.InvalidRow) -> str:
        wrong.add(int(row.text.split(",", 1)[0]))
        return "skip"

    numbered = pc.binary_join_element_wise(rows.cast(pa.string()), raw, ",")
    text = "\n".join(numbered.to_pylist()).encode() + b"\n"
    names = ["row", *FIELDS]
    table = csv.read_csv(
        pa.BufferReader(text),
        read_options=csv.ReadOptions(column_names=names, block_size=len(text) + 1, use_threads=False),
        parse_options=csv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=reject),
        convert_options=csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
    )
    return table.set_column(0, "row", table["row"].cast(pa.int64())), wrong


def _digits(column: pa.ChunkedArray) -> tuple[pa.ChunkedArray, pa.ChunkedArray]:
    """Which cells are ASCII digits, and those digits without leading zeros."""
    fine = pc.match_substring_regex(column, r"\A[0-9]+\z")
    return fine, pc.if_else(fine, pc.replace_substring_regex(column, r"\A0+([0-9])", r"\1"), "0")


def judge(lines: pa.RecordBatch) -> pa.RecordBatch:
    """Verdicts for a batch of (line_id, raw)."""
    ids, raw = lines.column(0), lines.column(1)
    n = len(raw)
    reason: list[str | None] = ["null_line" if x else None for x in pc.is_null(raw).to_pylist()]
    quoted = pc.fill_null(pc.match_substring_regex(raw, QUOTING), False)
    for i, ok in enumerate(quoted.to_pylist()):
        if not ok and reason[i] is None:
            reason[i] = "quoting"
    rows = pa.array(range(n), pa.int64()).filter(quoted)
    values: dict[str, list] = {f: [None] * n for f in FIELDS}
    if len(rows):
        table, wrong = _read(raw.filter(quoted), rows)
        for i in wrong:
            reason[i] = "columns"
        tag, vr = table["tag"], table["vr"]
        good_tag = pc.match_substring_regex(tag, r"\A[0-9A-F]{8}\z")
        short = pc.is_in(vr, pa.array(SHORT_VRS))
        known = pc.or_(short, pc.is_in(vr, pa.array(LONG_VRS)))
        delimiter = pc.and_(pc.equal(vr, ""), pc.starts_with(tag, "FFFE"))
        good_vr = pc.or_(known, delimiter)
        numeric, length = _digits(table["length"])
        small = pc.less_equal(pc.utf8_length(length), 10)
        length = pc.if_else(small, length, "9999999999").cast(pa.int64())
        most = pc.if_else(short, SHORT_MOST, LONG_MOST)
        undefined = pc.and_(pc.equal(length, UNDEFINED), pc.is_in(vr, pa.array(UNDEFINED_VRS)))
        good_length = pc.and_(numeric, pc.or_(pc.less_equal(length, most), undefined))
        good_offset, offset = _digits(table["offset"])
        for i, checks in zip(table["row"].to_pylist(), zip(*[x.to_pylist() for x in (good_tag, good_vr, good_length, good_offset)], strict=True), strict=True):
            reason[i] = next((name for name, fine in zip(("tag", "vr", "length", "offset"), checks, strict=True) if not fine), None)
        for name, column in zip(FIELDS, (table["file"], tag, vr, length, offset, table["keyword"]), strict=True):
            for i, x in zip(table["row"].to_pylist(), column.to_pylist(), strict=True):
                if reason[i] is None:
                    values[name][i] = x
    offsets = [None if x is None or len(x) > 38 else x for x in values["offset"]]
    columns = [ids, pa.array([r is None for r in reason]), pa.array(reason, pa.string()), *[pa.array(values[f], t) for f, t in (("file", pa.string()), ("tag", pa.string()), ("vr", pa.string()), ("length", pa.int64()))]]
    return pa.RecordBatch.from_arrays([*columns, pa.array(offsets, pa.string()).cast(pa.decimal128(38, 0)), pa.array(values["keyword"], pa.string())], schema=OUT)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Verdict and typed fields of every row of ``lines`` (line_id, raw); a stage without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield judge(batch)

    return lines.select("line_id", "raw").mapInArrow(run, DDL)
