"""DICOM JSON: data sets to texts and back."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lumenframe.sources import p10
from lumenframe.sources import values as V

ENCAPSULATED = (0xFFFEE000, 0xFFFEE0DD)


def fragments_of(data: bytes) -> list[bytes]:
    """Fragments of inline encapsulated pixel data: item headers, then an end mark that may be missing."""
    found, at = [], 0
    while at + 8 <= len(data):
        group, element, length = struct.unpack_from("<HHI", data, at)
        tag = group << 16 | element
        if tag == ENCAPSULATED[1]:
            break
        if tag != ENCAPSULATED[0] or at + 8 + length > len(data):
            raise ValueError("broken encapsulated pixel data")
        found.append(data[at + 8 : at + 8 + length])
        at += 8 + length
    return found


def fragments_inline(fragments: list[bytes]) -> bytes:
    parts = [struct.pack("<HHI", 0xFFFE, 0xE000, len(f)) + f for f in fragments]
    return b"".join(parts)


def read(text: str, encapsulated: bool | None = None) -> Iterator[p10.Element]:
    """Elements of a DICOM JSON object; text values become UTF-8.

    Inline pixel data is split into fragments where it begins with an item header, or as told.
    """
    yield from _read(json.loads(text), (), encapsulated)


def _read(item: dict, path: p10.Path, encapsulated: bool | None) -> Iterator[p10.Element]:
    for key in sorted(item, key=str.upper):
        element, tag = item[key], int(key, 16)
        vr = element.get("vr", "UN")
        if "BulkDataURI" in element:
            raise ValueError(f"{key}: bulk data by reference is not supported")
        if vr == "SQ":
            held = element.get("Value") or []
            for i, inner in enumerate(held):
                yield from _read(inner or {}, (*path, (f"{tag:08X}", i)), encapsulated)
            yield p10.Element(path, tag, "SQ", items=len(held))
        elif "InlineBinary" in element:
            data = base64.b64decode(element["InlineBinary"])
            cut = tag == p10.PIXELS and (encapsulated if encapsulated is not None else data[:4] == b"\xfe\xff\x00\xe0")
            yield p10.Element(path, tag, vr, b"" if cut else data, fragments=fragments_of(data) if cut else None)
        else:
            yield p10.Element(path, tag, vr, V.from_json(element.get("Value") or [], vr) if element.get("Value") else b"", charset="ISO_IR 192")


def write(elements: Iterable[p10.Element], pretty: bool = False, keep_encapsulated: bool = True, binary: set[int] | None = None) -> str:
    """The DICOM JSON of a data set; group lengths and the character set are left out.

    With ``binary`` only the binary values of these tags are written, others are left empty.
    """
    held = list(elements)
    charsets = {(e.path, e.tag): e.charset for e in held}
    shown = _json(p10.tree(e for e in held if e.tag & 0xFFFF), (), charsets, keep_encapsulated, binary)
    return json.dumps(shown, ensure_ascii=False, indent=2) if pretty else json.dumps(shown, ensure_ascii=False, separators=(",", ":"))


def _json(data_set: p10.DataSet, path: p10.Path, charsets: dict, keep: bool, binary: set[int] | None = None) -> dict:
    out: dict = {}
    for tag in sorted(data_set):
        vr, value = data_set[tag]
        if tag == p10.CHARSET:
            continue
        element: dict = {"vr": vr}
        if vr == "SQ":
            items = [_json(x, (*path, (f"{tag:08X}", i)), charsets, keep, binary) for i, x in enumerate(value)]  # type: ignore[arg-type]
            element["Value"] = items
        elif isinstance(value, list):
            if not keep or binary is not None and tag not in binary:
                continue
            element["InlineBinary"] = V.inline(fragments_inline(value))  # type: ignore[arg-type]
        else:
            found = V.to_json(value, vr, charsets.get((path, tag)))
            if found is None and value and binary is not None and tag not in binary:
                pass
            elif found is None and value:
                element["InlineBinary"] = V.inline(value)
            elif found:
                element["Value"] = found
        out[f"{tag:08X}"] = element
    return out


ROW = pa.schema(
    [
        ("file", pa.string()), ("ordinal", pa.int64()), ("path", pa.list_(pa.struct([("tag", pa.string()), ("item", pa.int32())]))), ("tag", pa.string()), ("vr", pa.string()),
        ("values_json", pa.string()), ("inline_binary", pa.binary()), ("fragments", pa.list_(pa.binary())), ("item_count", pa.int32()),
    ]
)
DDL = "file string, ordinal bigint, path array<struct<tag:string,item:int>>, tag string, vr string, values_json string, inline_binary binary, fragments array<binary>, item_count int"


def rows(file: str, elements: Iterable[p10.Element]) -> Iterator[tuple]:
    """Rows of the elements table."""
    for i, e in enumerate(elements):
        shown, binary = V.row_values(e.value, e.vr, e.charset) if e.fragments is None and e.vr != "SQ" else (None, None)
        yield (file, i, [{"tag": t, "item": n} for t, n in e.path], e.hex, e.vr, shown, binary, e.fragments, e.items)


def element(row: dict) -> p10.Element:
    """A row of the elements table as an element again."""
    path = tuple((p["tag"], p["item"]) for p in row["path"] or [])
    vr = row["vr"] or "UN"
    if row.get("fragments") is not None:
        return p10.Element(path, int(row["tag"], 16), vr, fragments=[bytes(f) for f in row["fragments"]])
    if vr == "SQ":
        return p10.Element(path, int(row["tag"], 16), vr, items=row.get("item_count") or 0)
    data = bytes(row["inline_binary"]) if row.get("inline_binary") is not None else V.from_json(json.loads(row["values_json"]), vr) if row.get("values_json") else b""
    return p10.Element(path, int(row["tag"], 16), vr, data, charset="ISO_IR 192")


def json_to_elements(texts: DataFrame) -> DataFrame:
    """Elements of ``texts`` (file, text), with a column ``error``; an unreadable text gives one row with the reason and no tag."""
    kinds = pa.schema([*ROW, ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found: list[tuple] = []
            for file, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                try:
                    found += [(*r, None) for r in list(rows(file, read(text)))]
                except (ValueError, TypeError, AttributeError, RecursionError) as e:
                    found.append((file, *[None] * (len(ROW) - 1), f"not DICOM JSON: {e}"))
            columns = list(zip(*found, strict=True)) if found else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    return texts.select("file", "text").where("text is not null").mapInArrow(run, DDL + ", error string")


def whole(elements: DataFrame) -> DataFrame:
    """The elements of files that were read to their end, without the column ``error``; files with an error are left out altogether."""
    if "error" not in elements.columns:
        return elements
    broken = elements.where("error is not null").select("file").distinct()
    return elements.where("error is null").join(broken, "file", "left_anti").select(*[c for c in elements.columns if c != "error"])


def elements_to_json(elements: DataFrame) -> DataFrame:
    """(file, text): one DICOM JSON object per file; a file is one data set and fits a task.  Files with an error are left out."""
    elements = whole(elements)
    names = [c for c in ROW.names if c in elements.columns]

    def run(table: pa.Table) -> pa.Table:
        held = table.to_pylist()
        return pa.table({"file": [held[0]["file"]], "text": [write(element(r) for r in held)]})

    return elements.select(*names).groupBy("file").applyInArrow(run, "file string, text string")
