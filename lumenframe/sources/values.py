"""Values of the 34 value representations: bytes, and the values of DICOM JSON."""

from __future__ import annotations

import base64
import json
import math
import struct

from lumenframe.sources import charsets

# Fixed values of the standard: classes of value representations.
TEXT = {"LO", "SH", "UC", "PN", "LT", "ST", "UT"}
ASCII = {"AE", "AS", "CS", "DA", "DS", "DT", "IS", "TM", "UI", "UR"}
SINGLE_TEXT = {"LT", "ST", "UT", "UR"}
BINARY = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "UV": "Q", "SV": "q", "FL": "f", "FD": "d", "AT": "HH"}
LONG_LENGTH = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
WORD = {"US": 2, "SS": 2, "OW": 2, "AT": 2, "UL": 4, "SL": 4, "FL": 4, "OF": 4, "OL": 4, "UV": 8, "SV": 8, "FD": 8, "OD": 8, "OV": 8}
GROUPS = ("Alphabetic", "Ideographic", "Phonetic")
SAFE = 2**53 - 1


def swap(data: bytes, vr: str) -> bytes:
    """The other byte order."""
    n = WORD.get(vr, 1)
    if n == 1 or len(data) % n:
        return data
    return b"".join(data[i : i + n][::-1] for i in range(0, len(data), n))


def trim(text: str, vr: str) -> str:
    if vr == "UI":
        return text.rstrip("\0 ")
    if vr == "CS":
        return text.rstrip("\0").strip(" ")
    if vr in ("LT", "ST", "UT", "PN"):
        return text.rstrip(" \0")
    return text.strip(" \0")


def texts(data: bytes, vr: str, declared: str | None = None) -> list[str]:
    """The values of a text; an empty one has none."""
    text = charsets.decode(data, declared, multi=vr not in SINGLE_TEXT) if vr in TEXT else data.decode("ascii", "replace")
    if not trim(text, vr):
        return []
    return [trim(text, vr)] if vr in SINGLE_TEXT else [trim(v, vr) for v in text.split("\\")]


def _number(text: str, vr: str) -> object:
    if not text:
        return None
    try:
        return int(text) if vr == "IS" else _real(float(text))
    except ValueError:
        try:
            return _real(float(text))
        except ValueError:
            return text


def _real(x: float) -> object:
    """A JSON number; not-a-number and infinities become texts."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    return int(x) if x.is_integer() and abs(x) < 1e15 else x


def _name(text: str) -> dict | None:
    groups = [g.rstrip(" ") for g in text.split("=")][:3]
    found = {n: g for n, g in zip(GROUPS, groups, strict=False) if g}
    return found or None


def to_json(data: bytes, vr: str, declared: str | None = None) -> list | None:
    """The JSON values of an element; None for binary ones."""
    if vr in TEXT or vr in ASCII:
        found = texts(data, vr, declared)
        if vr == "PN":
            return [_name(v) for v in found]
        if vr in ("IS", "DS"):
            return [_number(v, vr) for v in found]
        return [v or None for v in found]
    if vr in NUMBERS:
        code = NUMBERS[vr]
        size = struct.calcsize("<" + code)
        parts = list(struct.iter_unpack("<" + code, data[: len(data) // size * size]))
        if vr == "AT":
            return [f"{g:04X}{e:04X}" for g, e in parts]
        if vr in ("FL", "FD"):
            return [_real(x[0]) for x in parts]
        return [x[0] if abs(x[0]) <= SAFE else str(x[0]) for x in parts]
    return None


def _real_text(x: object) -> str:
    """A DS of at most 16 characters, the shorter of decimal and exponential notation."""
    if isinstance(x, str):
        return x
    best = repr(float(x))
    best = best[:-2] if best.endswith(".0") else best
    for digits in range(17, 0, -1):
        if len(best) <= 16:
            break
        best = f"{float(x):.{digits}g}".replace("e+0", "e").replace("e-0", "e-").replace("e+", "e")
    return best


def from_json(values: list, vr: str) -> bytes:
    """The bytes of JSON values, little endian, text in UTF-8, padded to even length."""
    if vr in NUMBERS:
        code = NUMBERS[vr]
        if vr == "AT":
            return b"".join(struct.pack("<HH", int(v[:4], 16), int(v[4:], 16)) for v in values if v)
        number = float if vr in ("FL", "FD") else int
        return b"".join(struct.pack("<" + code, number(v)) for v in values if v is not None)
    if vr == "PN":
        items = ["=".join(v.get(g, "") for g in GROUPS).rstrip("=") if v else "" for v in values]
    elif vr == "DS":
        items = ["" if v is None else _real_text(v) for v in values]
    else:
        items = ["" if v is None else str(v) for v in values]
    text = "\\".join(items).encode()
    return text + (b"\0" if vr == "UI" else b" ") * (len(text) % 2)


def row_values(data: bytes, vr: str, declared: str | None) -> tuple[str | None, bytes | None]:
    """(values_json, inline_binary) of the elements table."""
    found = to_json(data, vr, declared)
    if found is None:
        return None, data or None
    return (json.dumps(found, ensure_ascii=False) if found else None), None


def inline(data: bytes) -> str:
    return base64.b64encode(data).decode()
