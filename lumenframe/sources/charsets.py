"""Decoding of text in the character sets that DICOM names, with ISO 2022 code extensions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the standard: defined terms and the Python codecs that read them.
SINGLE = {
    "ISO_IR 6": "ascii", "ISO_IR 100": "iso8859-1", "ISO_IR 101": "iso8859-2", "ISO_IR 109": "iso8859-3", "ISO_IR 110": "iso8859-4",
    "ISO_IR 144": "iso8859-5", "ISO_IR 127": "iso8859-6", "ISO_IR 126": "iso8859-7", "ISO_IR 138": "iso8859-8", "ISO_IR 148": "iso8859-9",
    "ISO_IR 203": "iso8859-15", "ISO_IR 13": "shift_jis", "ISO_IR 166": "tis-620", "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk",
}

# Fixed values of the standard: escape sequences, the codec of what follows, and whether they set the upper half (G1).
ESCAPES = {
    b"\x1b(B": ("ascii", False), b"\x1b(J": ("shift_jis", False), b"\x1b)I": ("shift_jis", True), b"\x1b-A": ("iso8859-1", True),
    b"\x1b-B": ("iso8859-2", True), b"\x1b-C": ("iso8859-3", True), b"\x1b-D": ("iso8859-4", True), b"\x1b-L": ("iso8859-5", True),
    b"\x1b-G": ("iso8859-6", True), b"\x1b-F": ("iso8859-7", True), b"\x1b-H": ("iso8859-8", True), b"\x1b-M": ("iso8859-9", True),
    b"\x1b-b": ("iso8859-15", True), b"\x1b-T": ("tis-620", True), b"\x1b$B": ("iso2022_jp", False), b"\x1b$(D": ("iso2022_jp_1", False),
    b"\x1b$)C": ("euc_kr", True), b"\x1b$)A": ("gb2312", True),
}

ESCAPE = re.compile(rb"\x1b(?:\$?[()\-][A-Za-z]|\$[@AB])")
DELIMITERS = re.compile(rb"[\\^=\r\n\f\t]")


def terms(declared: str | None) -> list[str]:
    """The terms of a Specific Character Set value, repaired: case, blanks, underscores and hyphens of known terms."""
    out = []
    for term in (declared or "").split("\\"):
        t = re.sub(r"[\s_-]+", " ", term.strip().upper())
        t = re.sub(r"^ISO 2022 ?IR ?", "ISO 2022 IR ", t)
        t = re.sub(r"^ISO ?IR ?", "ISO_IR ", t)
        out.append("ISO_IR 192" if t in ("UTF 8", "UTF8") else t)
    return out


def codec(term: str) -> str:
    """Codec of the initial state; unknown terms read as UTF-8 with its ASCII part."""
    if not term:
        return "ascii"
    return SINGLE.get(term.replace("ISO 2022 IR ", "ISO_IR "), "ascii" if term.startswith("ISO 2022") else "utf-8")


def _plain(data: bytes, name: str) -> str:
    text = data.decode(name, "replace")
    return text


def decode(data: bytes, declared: str | None = None, multi: bool = True) -> str:
    """Text of a value; the initial set is restored at every delimiter of values, components and lines."""
    names = terms(declared)
    first = codec(names[0])
    if first == "ascii" and len(names) == 1 and b"\x1b" not in data:
        return _plain(data, "ascii")
    if b"\x1b" not in data:
        return _plain(data, first)
    out = []
    parts = re.split(rb"([\\^=\r\n\f\t])" if multi else rb"([\r\n\f\t])", data)
    for part in parts:
        at, low, high = 0, "ascii" if first not in SINGLE.values() else first, first
        low = first
        for m in [*ESCAPE.finditer(part), None]:
            end = m.start() if m else len(part)
            if end > at:
                out.append(_run(part[at:end], low, high))
            if m:
                name, upper = ESCAPES.get(m[0], ("ascii", False))
                if upper:
                    high, low = name, low if low not in ("iso2022_jp", "iso2022_jp_1") else "ascii"
                else:
                    low = name
                at = m.end()
    return "".join(out)


def _run(data: bytes, low: str, high: str) -> str:
    """Bytes between two escape sequences."""
    if low in ("iso2022_jp", "iso2022_jp_1"):
        lead = b"\x1b$B" if low == "iso2022_jp" else b"\x1b$(D"
        return (lead + data + b"\x1b(B").decode(low, "replace")
    return data.decode(high if any(b > 0x7F for b in data) else ("ascii" if low == high and high not in ("utf-8", "gb18030", "gbk", "shift_jis") else low), "replace")


def decode_column(df: DataFrame, data: str, declared: str, name: str) -> DataFrame:
    """Add ``name``: the text of a binary column by the character set in another; null for null."""
    schema = df.schema.jsonValue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[name] = [None if d is None else decode(bytes(d), c) for d, c in zip(pdf[data], pdf[declared], strict=True)]
            yield pdf

    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInPandas(run, StructType([*StructType.fromJson(schema).fields, StructField(name, StringType())]))


__all__ = ["decode", "decode_column", "terms", "codec", "pa"]
