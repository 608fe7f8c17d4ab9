"""DICOMDIR files and archives of exported files.

Records and links come from the relational index; byte offsets need the lengths of all records before, so the file is
written twice, with zeros and then with what was measured.  One DICOMDIR is one file, so its records pass through one
task; file sets are independent of each other.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.sources import p10
from lumenframe.sources import values as V

NEXT, CHILD, FIRST, LAST, SEQUENCE = 0x00041400, 0x00041420, 0x00041200, 0x00041202, 0x00041220
KEYS = [("PATIENT", "patient"), ("STUDY", "study"), ("SERIES", "series"), ("IMAGE", "instance")]


def _record(kind: str, values: dict[int, tuple[str, list]], after: int = 0, below: int = 0) -> p10.DataSet:
    out: p10.DataSet = {NEXT: ("UL", struct.pack("<I", after)), 0x00041410: ("US", b"\xff\xff"), CHILD: ("UL", struct.pack("<I", below)), 0x00041430: ("CS", V.from_json([kind], "CS"))}
    return out | {tag: (vr, V.from_json(v, vr)) for tag, (vr, v) in values.items()}


def _size(record: p10.DataSet) -> int:
    return 16 + sum(len(x) for x in p10._body(record, False, False))


def dicomdir(entries: Iterable[dict], file_set: str = "") -> bytes:
    """A DICOMDIR of entries (patient, patient_name, study, study_date, series, modality, instance, sop_class, syntax, file_id), ordered by their keys."""
    rows = sorted(entries, key=lambda e: [str(e[k] or "") for _, k in KEYS])
    records: list[tuple[str, dict, int]] = []
    seen: set[tuple] = set()
    for e in rows:
        fields = [
            {0x00100010: ("PN", [{"Alphabetic": e.get("patient_name") or ""}]), 0x00100020: ("LO", [e["patient"]])},
            {0x00080020: ("DA", [e.get("study_date") or ""]), 0x0020000D: ("UI", [e["study"]])},
            {0x00080060: ("CS", [e.get("modality") or "OT"]), 0x0020000E: ("UI", [e["series"]])},
            {0x00041500: ("CS", e["file_id"].split("/")), 0x00041510: ("UI", [e.get("sop_class") or ""]), 0x00041511: ("UI", [e["instance"]]), 0x00041512: ("UI", [e.get("syntax") or p10.EXPLICIT])},
        ]
        for depth, (kind, _) in enumerate(KEYS):
            key = tuple(str(e[k]) for _, k in KEYS[: depth + 1])
            if key not in seen:
                seen.add(key)
                records.append((kind, fields[depth], depth))
    head: p10.DataSet = {0x00041130: ("CS", V.from_json([file_set[:16]], "CS")), FIRST: ("UL", b"\0" * 4), LAST: ("UL", b"\0" * 4), 0x00041212: ("US", b"\0\0")}
    mark = p10._head(SEQUENCE, "SQ", p10.UNDEFINED, False, False)
    start = _file(head | {SEQUENCE: ("SQ", [])}).index(mark) + len(mark)
    places, at = [], start
    for kind, values, _ in records:
        places.append(at)
        at += _size(_record(kind, values))
    after, below, open_ = [0] * len(records), [0] * len(records), {}
    for i, (_, _, depth) in enumerate(records):
        if depth in open_:
            after[open_[depth]] = places[i]
        elif depth - 1 in open_:
            below[open_[depth - 1]] = places[i]
        for deeper in [d for d in open_ if d > depth]:
            del open_[deeper]
        open_[depth] = i
    roots = [places[i] for i, r in enumerate(records) if r[2] == 0]
    if roots:
        head[FIRST], head[LAST] = ("UL", struct.pack("<I", roots[0])), ("UL", struct.pack("<I", roots[-1]))
    return _file(head | {SEQUENCE: ("SQ", [_record(k, v, a, b) for (k, v, _), a, b in zip(records, after, below, strict=True)])})


def _file(data_set: p10.DataSet) -> bytes:
    def flat(at: p10.DataSet, path: p10.Path) -> Iterator[p10.Element]:
        for tag, (vr, value) in at.items():
            if vr == "SQ":
                for i, item in enumerate(value):
                    yield from flat(item, (*path, (f"{tag:08X}", i)))  # type: ignore[arg-type]
                yield p10.Element(path, tag, "SQ", items=len(value))
            else:
                yield p10.Element(path, tag, vr, value)  # type: ignore[arg-type]

    return p10.write(flat(data_set, ()))


def dicomdirs(entries: DataFrame) -> DataFrame:
    """(file_set_id, content): one DICOMDIR per file set of ``entries`` (file_set_id and the columns of an entry)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.table({"file_set_id": [rows[0]["file_set_id"]], "content": pa.array([dicomdir(rows, rows[0]["file_set_id"] or "")], pa.binary())})

    return entries.groupBy("file_set_id").applyInArrow(run, "file_set_id string, content binary")


def write_zip(contents: DataFrame, path: str) -> int:
    """Write ``contents`` (name, content) to one ZIP file and count the entries.

    One output file is inherently serial: rows stream through the driver partition by partition, never all at once.
    """
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for row in contents.where(F.col("name").isNotNull()).select("name", "content").toLocalIterator():
            out.writestr(row["name"], bytes(row["content"] or b""))
            n += 1
    return n
