"""``spark.read.format("dicom")``: Part 10 files as rows of data elements, in batches and as streams, and back to files.

Options: ``path`` (a file, a folder or a glob, several with line breaks between them), ``tags`` (comma-separated hexadecimal root tags: others are not materialised and the read stops behind the largest),
``mode`` (PERMISSIVE keeps what was read before an error and adds it in ``error``; FAILFAST raises; DROPMALFORMED drops the file),
``requirePrefix`` (a file without the DICM prefix is an error like others; with ``false`` it is read from its first byte), ``defaultSyntax``, ``maxDepth``, ``maxValue``,
``maxString``, ``extension``, ``skipHidden`` (default false), ``bytesPerPartition``; for writing ``transferSyntax``, ``zlibLevel`` and ``base`` (the folder that output names are
relative to).  Object stores and anything else that Spark lists come in through ``parsed`` over ``binaryFile``.
"""

from __future__ import annotations

import glob as globs
import os
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lumenframe.sources import dicom_json, p10

SCHEMA = dicom_json.DDL + ", error string"


def _local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path


def walk(root: str, extension: str | None = None, hidden: bool = True) -> list[tuple[str, int, float]]:
    """(path, size, time of arrival) of the files below a folder or that match a glob, in order of path.

    Of a glob only the folder before its first wildcard is listed.  The time is that of the last change of a file's entry, which a copied file gets
    when it arrives, however old its content is.  Files that are still being written (``.tmp``) are left out.
    """
    found: list[str] = []
    for one in filter(None, root.split("\n")):
        one = _local(one)
        fixed, pattern = split_glob(one)
        if os.path.isfile(one):
            found.append(one)
            continue
        names = (os.path.join(folder, n) for folder, _, files in os.walk(fixed) for n in files)
        found += names if pattern is None else [n for n in names if re.match(pattern, n.lower())]
    kept = [n for n in found if not n.endswith(".tmp") and (hidden or not os.path.basename(n).startswith((".", "_")))]
    if extension:
        kept = [n for n in kept if n.lower().endswith("." + extension.lower().lstrip("."))]
    out = []
    for n in sorted(set(kept)):
        stat = os.stat(n)
        out.append((n, stat.st_size, stat.st_ctime))
    return out


def split_glob(path: str) -> tuple[str, str | None]:
    """(folder before the first wildcard, pattern over lower-cased paths), or (path, None) of one without wildcards."""
    if not globs.has_magic(path) and "{" not in path:
        return path, None
    from lumenframe.operators.listing import glob_pattern

    fixed: list[str] = []
    for part in path.split("/"):
        if globs.has_magic(part) or "{" in part:
            break
        fixed.append(part)
    return "/".join(fixed) or ("/" if path.startswith("/") else "."), glob_pattern(path)


def inputs(paths: list[str], file_list: str | None = None) -> list[str]:
    """Paths, folders and globs of a command, with those of a list (one per line, ``-`` for standard input).

    An input that is given twice or lies in another one would be read twice: that is an error.
    """
    given = list(paths)
    if file_list:
        lines = sys.stdin if file_list == "-" else open(file_list)  # noqa: SIM115
        given += [line.strip() for line in lines if line.strip()]
    seen: dict[str, str] = {}
    for one in given:
        at = one if "://" in one and not one.startswith("file://") else os.path.abspath(_local(one))
        if at in seen:
            raise ValueError(f"{one} is given twice")
        seen[at] = one
    for at, one in seen.items():
        above = os.path.dirname(at)
        while above and above != os.path.dirname(above):
            if above in seen:
                raise ValueError(f"{one} lies in {seen[above]}")
            above = os.path.dirname(above)
    return given


@dataclass
class Files(InputPartition):
    """Files read by one task."""

    paths: tuple[str, ...]


def grouped(files: list[tuple[str, int, float]], most: int) -> list[Files]:
    """Files packed into partitions of about ``most`` bytes."""
    out: list[list[str]] = []
    size = most
    for path, n, _ in files:
        if size + n > most or not out:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n + 4_096
    return [Files(tuple(paths)) for paths in out]


def config_of(options: dict) -> p10.Config:
    tags = options.get("tags")
    return p10.Config(
        tags=frozenset(int(t, 16) for t in tags.replace(" ", "").split(",") if t) if tags else None,
        require_prefix=options.get("requireprefix", "true").lower() == "true",
        default_syntax=options.get("defaultsyntax", p10.IMPLICIT),
        max_depth=int(options.get("maxdepth", 10_000)),
        max_value=int(options.get("maxvalue", 2**32 - 2)),
        max_string=int(options.get("maxstring", 2**32 - 2)),
    )


def read_elements(name: str, source: object, options: dict) -> Iterator[tuple]:
    """Rows of one file or of its bytes."""
    mode = options.get("mode", "PERMISSIVE").upper()
    held: list[tuple] = []
    try:
        for row in dicom_json.rows(name, p10.Walker(source, config_of(options)).elements()):  # type: ignore[arg-type]
            if mode == "PERMISSIVE":
                yield (*row, None)
            else:
                held.append((*row, None))
    except ValueError as e:
        if mode == "FAILFAST":
            raise
        if mode == "PERMISSIVE":
            yield (name, None, None, None, None, None, None, None, None, str(e))
        return
    yield from held


def read_file(path: str, options: dict) -> Iterator[tuple]:
    with open(path, "rb") as file:
        yield from read_elements(path, file, options)


def parsed(files: DataFrame, **options: str) -> DataFrame:
    """Elements of ``files`` (path, content), as ``spark.read.format("binaryFile")`` gives them on any file system, or any table with a column of bytes."""
    own = {k.lower(): str(v) for k, v in options.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([*dicom_json.ROW, ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(read_elements(path, content, own)) if content is not None else [(path, *[None] * 8, "no content")]
                columns = list(zip(*found, strict=True)) if found else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Files]:
        return grouped(walk(self.options["path"], self.options.get("extension"), self.options.get("skiphidden", "false").lower() != "true"), int(self.options.get("bytesperpartition", 32 << 20))) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from read_file(path, self.options)


class StreamReader(DataSourceStreamReader):
    """New files by time of arrival and path; each micro-batch takes at most ``maxFilesPerTrigger`` and reads them in tasks."""

    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.reached: dict | None = None

    def initialOffset(self) -> dict:
        return {"time": 0.0, "path": ""}

    def _between(self, start: dict, end: dict | None) -> list[tuple[str, int, float]]:
        low = (start["time"], start["path"])
        found = sorted(walk(self.options["path"], self.options.get("extension")), key=lambda f: (f[2], f[0]))
        return [f for f in found if (f[2], f[0]) > low and (end is None or (f[2], f[0]) <= (end["time"], end["path"]))]

    def latestOffset(self, *limits: object) -> dict:
        start = limits[0] if limits and isinstance(limits[0], dict) else self.reached or self.initialOffset()
        new = self._between(start, None)[: int(self.options.get("maxfilespertrigger", 1_000))]
        self.reached = {"time": new[-1][2], "path": new[-1][0]} if new else start
        return self.reached

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.reached = end
        return grouped(self._between(start, end), int(self.options.get("bytesperpartition", 32 << 20)))

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from read_file(path, self.options)


def output_name(file: str, base: str | None = None) -> str:
    """Name of an output file: the path below ``base``, else the last part of the path."""
    name = os.path.relpath(_local(file), _local(base)) if base else os.path.basename(file)
    if name.startswith(".."):
        raise ValueError(f"{file} does not lie in {base}")
    return name if name.lower().endswith(".dcm") else name + ".dcm"


@dataclass
class Written(WriterCommitMessage):
    """Pairs of temporary and final names."""

    files: tuple[tuple[str, str], ...]


class Writer(DataSourceWriter):
    """One file per value of ``file``; all rows of a file must be in one partition, which ``save`` sees to."""

    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def write(self, rows: Iterator) -> Written:
        folder = _local(self.options["path"])
        os.makedirs(folder, exist_ok=True)
        syntax, level, base = self.options.get("transfersyntax", p10.EXPLICIT), int(self.options.get("zliblevel", 6)), self.options.get("base")
        names: list[tuple[str, str]] = []

        def flush(file: str, held: list) -> None:
            final = os.path.join(folder, output_name(file, base))
            os.makedirs(os.path.dirname(final), exist_ok=True)
            temporary = f"{final}.{uuid.uuid4().hex}.tmp"
            with open(temporary, "wb") as out:
                out.write(p10.write((dicom_json.element(r) for r in held), syntax, level))
            names.append((temporary, final))

        current, held = None, []
        for row in rows:
            r = row.asDict(recursive=True)
            if r["file"] != current and held:
                flush(current, held)
                held = []
            current = r["file"]
            held.append(r)
        if held:
            flush(current, held)
        return Written(tuple(names))

    def commit(self, messages: list) -> None:
        made = [pair for m in messages if m for pair in m.files]
        if len({final for _, final in made}) < len(made):
            self.abort(messages)
            raise ValueError("two data sets have the same output name; give their common folder as base")
        for temporary, final in made:
            os.replace(temporary, final)

    def abort(self, messages: list) -> None:
        for m in messages:
            for temporary, _ in m.files if m else ():
                if os.path.exists(temporary):
                    os.remove(temporary)


class DicomSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dicom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


class Elements:
    """Table function: the elements in a value of bytes, for SQL as ``FROM files, LATERAL dicom_elements(content)``."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        for _, ordinal, path, tag, vr, values_json, data, fragments, items, error in read_elements("", bytes(content), {}):
            yield ordinal, None if path is None else [(p["tag"], p["item"]) for p in path], tag, vr, values_json, data, fragments, items, error


def register(spark: SparkSession) -> None:
    """Make the data source ``dicom`` and the table function ``dicom_elements`` known to a session."""
    spark.dataSource.register(DicomSource)
    spark.udtf.register("dicom_elements", F.udtf(Elements, returnType=SCHEMA.split(", ", 1)[1]))


def save(elements: DataFrame, folder: str, syntax: str = p10.EXPLICIT, base: str | None = None) -> None:
    """Write one file per data set, the rows of a file brought together and in order of path and tag.

    With ``base`` the files keep their paths below it; two data sets of one output name are an error, and nothing is written.
    Files with a row in ``error`` were not read to their end and are left out.
    """
    register(elements.sparkSession)
    elements = dicom_json.whole(elements)
    if "fragments" not in elements.columns:
        elements = elements.withColumns({"fragments": F.lit(None).cast("array<binary>"), "item_count": F.lit(None).cast("int")})
    columns = ["file", "path", "tag", "vr", "values_json", "inline_binary", "fragments", "item_count"]
    together = elements.select(*columns).repartition("file").sortWithinPartitions("file", "path", "tag")
    writer = together.write.format("dicom").mode("append").option("transferSyntax", syntax)
    (writer.option("base", base) if base else writer).save(folder)
