"""Frames of whole archives: extracted, decoded, rendered and transcoded per data set.

The unit of work is one data set, which holds its own pixel data; data sets are spread over tasks by file.  What cannot be
decoded comes out with its reason in ``error`` and no image.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import elements as E
from lumenframe.functions import pixeldata as P
from lumenframe.functions.dictionaries import TRANSFER_SYNTAXES

EXTENSIONS = {uid: extension for uid, _, _, extension in TRANSFER_SYNTAXES}
FRAMES = pa.schema([("file", pa.string()), ("frame_index", pa.int32()), ("bit_offset", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
IMAGES = pa.schema([("file", pa.string()), ("frame_index", pa.int32()), ("rows", pa.int32()), ("columns", pa.int32()), ("samples", pa.int32()), ("pixels", pa.list_(pa.int32())), ("error", pa.string())])
FRAMES_DDL = "file string, frame_index int, bit_offset int, data binary, error string"
IMAGES_DDL = "file string, frame_index int, rows int, columns int, samples int, pixels array<int>, error string"
FILES = pa.schema([("file", pa.string()), ("frame_index", pa.int32()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])
FILES_DDL = "file string, frame_index int, name string, content binary, error string"
MODALITY_LUT, VOI_LUT, PRESENTATION_LUT = "00283000", "00283010", "20500010"
OVERLAYS = [f"{0x6000 + 2 * i:04X}" for i in range(16)]
#: Root tags that the pixel operators read; a scan can be pruned to them.
TAGS = ["00020010", "00080016", "00280002", "00280004", "00280006", "00280008", "00280010", "00280011", "00280100", "00280101", "00280103", "00281050", "00281051", "00281052", "00281053", "00281056", "20500020", "7FE00001", "7FE00002", "7FE00010", MODALITY_LUT, VOI_LUT, PRESENTATION_LUT, "00281101", "00281102", "00281103", "00281201", "00281202", "00281203", "00281221", "00281222", "00281223", *[g + e for g in OVERLAYS for e in ("0010", "0011", "0050", "0100", "0102", "3000")]]


class DataSet:
    """Root elements of one file, or those of an item, with the items of its sequences."""

    def __init__(self, rows: list[dict], depth: int = 0) -> None:
        self.rows = {r["tag"]: r for r in rows if len(r["path"] or []) == depth}
        self.below: dict[tuple[str, int], list[dict]] = {}
        for r in rows:
            if len(r["path"] or []) > depth:
                step = r["path"][depth]
                self.below.setdefault((step["tag"], step["item"]), []).append(r)
        self.depth = depth

    def item(self, tag: str, i: int = 0) -> DataSet | None:
        held = self.below.get((tag, i))
        return DataSet(held, self.depth + 1) if held else None

    def words(self, tag: str) -> bytes:
        """Values of a table as little-endian words, whether they are numbers or bytes."""
        return self.bytes(tag) or np.array(self.all(tag), dtype=np.int64).astype("<u2").tobytes()

    def lut(self, descriptor: str, data: str) -> P.Lut | None:
        held = [int(x) for x in self.all(descriptor)]
        return P.lut_of(held, self.words(data), signed=self.get("00280103", 0) == 1) if len(held) == 3 else None

    def sequence_lut(self, tag: str, signed: bool) -> P.Lut | None:
        """The table in the first item of a sequence."""
        item = self.item(tag)
        held = [int(x) for x in item.all("00283002")] if item else []
        return P.lut_of(held, item.words("00283006"), signed) if item and len(held) == 3 else None

    def palette(self) -> tuple[P.Lut, P.Lut, P.Lut]:
        """The tables of red, green and blue, plain or segmented."""
        found = []
        for i in (1, 2, 3):
            held = [int(x) for x in self.all(f"0028110{i}")]
            if len(held) != 3:
                raise P.DecoderError("no palette")
            if f"0028122{i}" in self.rows:
                words = np.frombuffer(self.words(f"0028122{i}"), "<u2").tolist()
                found.append(P.Lut(held[1], P.segmented(words), held[2]))
            else:
                found.append(P.lut_of(held, self.words(f"0028120{i}")))
        return found[0], found[1], found[2]

    def overlays(self) -> list[tuple[np.ndarray, tuple[int, int]]]:
        """(bits, origin) of the overlay planes that have data of their own."""
        found = []
        for g in OVERLAYS:
            data, rows, columns = self.bytes(g + "3000"), self.get(g + "0010"), self.get(g + "0011")
            if data is None or not rows or not columns:
                continue
            bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: int(rows) * int(columns)]
            if len(bits) == int(rows) * int(columns):
                origin = [int(x) for x in self.all(g + "0050")] or [1, 1]
                found.append((bits.reshape(int(rows), int(columns)), (origin[0], origin[-1])))
        return found

    def all(self, tag: str) -> list:
        text = (self.rows.get(tag) or {}).get("values_json")
        return json.loads(text) if text else []

    def get(self, tag: str, default: object = None) -> object:
        held = self.all(tag)
        return held[0] if held and held[0] is not None else default

    def bytes(self, tag: str) -> bytes | None:
        data = (self.rows.get(tag) or {}).get("inline_binary")
        return bytes(data) if data is not None else None

    @property
    def syntax(self) -> str:
        return str(self.get("00020010", "1.2.840.10008.1.2"))

    def description(self) -> P.Description:
        if not self.get("00280010") or not self.get("00280011"):
            raise P.DecoderError("no rows or columns")
        return P.Description(
            int(self.get("00280010")), int(self.get("00280011")), int(self.get("00280100", 16)), int(self.get("00280101", 0)), self.get("00280103", 0) == 1,
            int(self.get("00280002", 1)), self.get("00280006", 0) == 1, str(self.get("00280004", "MONOCHROME2")), int(self.get("00280008", 1) or 1),
        )

    def frames(self) -> list[tuple[int, int, bytes]]:
        d, row = self.description(), self.rows.get("7FE00010")
        if row is None:
            return []
        if row.get("fragments") is not None:
            parts = [bytes(f) for f in row["fragments"]]
            return [(i, 0, data) for i, data in P.encapsulated_frames(parts, d.frames, self.bytes("7FE00001"), self.bytes("7FE00002"))]
        return P.native_frames(self.bytes("7FE00010") or b"", d)

    def grey(self, stored_first: np.ndarray | None, window: tuple[float, float] | None) -> P.Grey:
        """The grey-level pipeline; without a window of its own a file takes that of its first frame for all."""
        slope, intercept = float(self.get("00281053", 1) or 1), float(self.get("00281052", 0) or 0)
        if window:
            chosen = P.Window(*window, "LINEAR_EXACT")
        elif self.all("00281050") and self.all("00281051"):
            chosen = P.Window(float(self.get("00281050")), float(self.get("00281051")), str(self.get("00281056", "LINEAR")))
        else:
            chosen = P.window_of(stored_first.astype(np.float32) * slope + intercept) if stored_first is not None else None
        signed = self.get("00280103", 0) == 1
        modality = self.sequence_lut(MODALITY_LUT, signed)
        voi = None if window or (self.all("00281050") and self.all("00281051")) else self.sequence_lut(VOI_LUT, signed)
        if chosen is None or not (window or self.all("00281050")):
            chosen = P.window_of(modality.at(stored_first)) if modality and stored_first is not None else chosen
        inverse = self.get("20500020") == "INVERSE" or (self.get("20500020") is None and self.get("00280004") == "MONOCHROME1")
        return P.Grey(slope, intercept, modality, chosen, voi, bool(inverse), self.sequence_lut(PRESENTATION_LUT, False))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Arrays of numbers go into the column as they lie in memory."""
    if not pa.types.is_list(kind) or not any(isinstance(v, np.ndarray) for v in values):
        return pa.array(values, kind)
    flat = [np.zeros(0, np.int32) if v is None else v.reshape(-1).astype(np.int32, copy=False) for v in values]
    ends = np.cumsum([0] + [len(f) for f in flat]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)), mask=pa.array([v is None for v in values]))


def _per_file(elements: DataFrame, ddl: str, schema: pa.Schema, make: Callable[[str, DataSet], list[tuple]], together: bool = False) -> DataFrame:
    """``together``: the rows of a file follow each other in one partition, as the data source gives them, so that no pixel is shuffled."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        file = rows[0]["file"]
        try:
            found = make(file, DataSet(rows))
        except (P.DecoderError, ValueError) as e:
            found = [(file, *[None] * (len(schema) - 2), str(e))]
        columns = list(zip(*found, strict=True)) if found else [[] for _ in schema]
        return pa.table([_column(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            files = batch.column("file")
            edges = [0, *[i for i in range(1, len(files)) if files[i] != files[i - 1]], len(files)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and files[a].as_py() != current:
                    yield from run(pa.Table.from_batches(held)).to_batches()
                    held = []
                current = files[a].as_py()
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    nested = (F.size("path") == 1) & F.get("path", F.lit(0))["tag"].isin(MODALITY_LUT, VOI_LUT, PRESENTATION_LUT)
    wanted = elements.where((F.col("tag").isin(TAGS) & (F.size("path") == 0)) | nested)
    names = [c for c in ("file", "path", "tag", "vr", "values_json", "inline_binary", "fragments") if c in elements.columns]
    wanted = wanted.select(*names)
    return wanted.mapInArrow(stream, ddl) if together else wanted.groupBy("file").applyInArrow(run, ddl)


def frames(elements: DataFrame, together: bool = False) -> DataFrame:
    """(file, frame_index, bit_offset, data, error)."""
    return _per_file(elements, FRAMES_DDL, FRAMES, lambda file, s: [(file, *f, None) for f in s.frames()], together)


def _image(file: str, index: int, image: np.ndarray) -> tuple:
    return (file, index, image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, image, None)


def stored_values(elements: DataFrame, together: bool = False) -> DataFrame:
    """Decoded frames: (file, frame_index, rows, columns, samples, pixels, error)."""

    def make(file: str, s: DataSet) -> list[tuple]:
        d = s.description()
        return [_image(file, i, P.decode(data, d, s.syntax, bit)) for i, bit, data in s.frames()]

    return _per_file(elements, IMAGES_DDL, IMAGES, make, together)


def _render(s: DataSet, window: tuple[float, float] | None, colours: str | None, overlays: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(frame index, image) of a data set: eight-bit grey levels, or RGB."""
    d, grey, tables = s.description(), None, None
    for i, bit, data in s.frames():
        image = P.decode(data, d, s.syntax, bit)
        if d.photometric == "PALETTE COLOR":
            tables = tables or s.palette()
            image = P.palette(image, *tables)
        elif d.samples == 1:
            grey = grey or s.grey(image, window)
            image = grey.render(image)
            if colours:
                image = P.standard_palette(colours)[image]
        else:
            if d.photometric.startswith("YBR"):
                image = P.ybr_to_rgb(image, d.bits_stored)
            image = (image >> max(0, d.bits_stored - 8)).astype(np.uint8)
        for bits, origin in s.overlays() if overlays else ():
            image = P.overlaid(image, bits, origin)
        yield i, image


def _shaped(image: np.ndarray, crop: tuple[int, int, int, int] | None, orientation: str, size: tuple[int, int] | None) -> np.ndarray:
    if crop:
        image = P.cut_out(image, *crop)
    image = P.ORIENTATIONS[orientation](image)
    return P.resized(image, *size) if size else image


def rendered(elements: DataFrame, window: tuple[float, float] | None = None, crop: tuple[int, int, int, int] | None = None, orientation: str = "identity", size: tuple[int, int] | None = None, together: bool = False, colours: str | None = None, overlays: bool = False) -> DataFrame:
    """Frames as eight-bit grey or RGB images, then cropped, turned and resized, in this order.

    ``colours`` names a palette of the standard for grey images; ``overlays`` draws the overlay planes in white.
    """
    make = lambda file, s: [_image(file, i, _shaped(image, crop, orientation, size)) for i, image in _render(s, window, colours, overlays)]
    return _per_file(elements, IMAGES_DDL, IMAGES, make, together)


def image_files(elements: DataFrame, kind: str = "png", together: bool = False, **options: object) -> DataFrame:
    """(file, frame_index, name, content, error): each frame as a PNG file, or ``raw`` as it lies in the data set.

    A raw frame has the extension of its coding.  ``options`` are those of ``rendered``.
    """

    def make(file: str, s: DataSet) -> list[tuple]:
        if kind == "raw":
            end = EXTENSIONS.get(s.syntax, ".bin")
            return [(file, i, f"{file}.{i:04d}{end}", data, None) for i, _, data in s.frames()]
        shape = (options.get("crop"), str(options.get("orientation", "identity")), options.get("size"))
        images = _render(s, options.get("window"), options.get("colours"), bool(options.get("overlays")))  # type: ignore[arg-type]
        return [(file, i, f"{file}.{i:04d}.png", P.png(_shaped(image, *shape)), None) for i, image in images]  # type: ignore[arg-type]

    return _per_file(elements, FILES_DDL, FILES, make, together)


def transcoded(elements: DataFrame, syntax: str, together: bool = False) -> DataFrame:
    """Frames decoded and coded again in another transfer syntax: (file, frame_index, bit_offset, data, error)."""

    def make(file: str, s: DataSet) -> list[tuple]:
        d = s.description()
        target = P.Description(**{**d.__dict__, "planar": False}) if syntax == P.RLE else d
        return [(file, i, 0, P.encode(P.decode(data, d, s.syntax, bit), target, syntax), None) for i, bit, data in s.frames()]

    return _per_file(elements, FRAMES_DDL, FRAMES, make, together)


PLACED = pa.schema([("file", pa.string()), ("tag", pa.string()), ("vr", pa.string()), ("values_json", pa.string()), ("inline_binary", pa.binary()), ("fragments", pa.list_(pa.binary())), ("error", pa.string())])


def transcoded_elements(elements: DataFrame, syntax: str, hook: Callable[[np.ndarray, int], np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """(elements with their pixel data in another transfer syntax, (file, error) of the data sets that stay as they are).

    Run-length coded colour is by pixel, so the planar configuration becomes 0; frames that are encapsulated get a basic offset
    table of zero length.  Targets are lossless, so that the mark of lossy compression stays as it was.  ``hook`` gets the stored values of each frame and its
    index, and returns what is to be coded, of the same shape.
    """

    def make(file: str, s: DataSet) -> list[tuple]:
        d = s.description()
        target = P.Description(**{**d.__dict__, "planar": False}) if syntax == P.RLE else d
        if d.photometric == "YBR_FULL_422":
            target = P.Description(**{**target.__dict__, "photometric": "YBR_FULL"})
        images = [P.decode(data, d, s.syntax, bit) for _, bit, data in s.frames()]
        if hook:
            shapes = [x.shape for x in images]
            images = [np.asarray(hook(x, i)) for i, x in enumerate(images)]
            if [x.shape for x in images] != shapes:
                raise P.DecoderError("the hook changed the size of a frame")
        coded = [P.encode(x, target, syntax) for x in images]
        text = lambda *v: json.dumps(list(v))
        rows = [(file, "00020010", "UI", text(syntax), None, None, None), (file, "00280004", "CS", text(target.photometric), None, None, None)]
        if d.samples > 1:
            rows.append((file, "00280006", "US", text(int(target.planar)), None, None, None))
        if "7FE00010" in s.rows:
            if syntax in P.NATIVE:
                if d.bits_allocated == 1 and len(coded) > 1:
                    bits = np.concatenate([x.reshape(-1) for x in images])
                    coded = [np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()]
                rows.append((file, "7FE00010", "OB" if d.bits_allocated <= 8 else "OW", None, b"".join(coded), None, None))
            else:
                rows.append((file, "7FE00010", "OB", None, None, [b"", *coded], None))
        return rows

    columns = "file string, tag string, vr string, values_json string, inline_binary binary, fragments array<binary>, error string"
    made = _per_file(elements, columns, PLACED, make)
    new = made.where("error is null").drop("error")
    offset_tables = new.where("tag = '7FE00010'").select("file", F.explode(F.array(F.lit("7FE00001"), F.lit("7FE00002"))).alias("tag"))
    kept = elements.join(offset_tables.withColumn("gone", F.lit(True)), ["file", "tag"], "left_anti")
    return E.insert(kept, new), made.where("error is not null").select("file", "error")


def write_files(files: DataFrame, folder: str, base: str | None = None) -> int:
    """Write (file, name, content) below a folder that all executors share, from the tasks; how many files were written.

    Each file appears at once, by renaming.  With ``base`` the names keep their paths below it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                final = os.path.join(folder, os.path.relpath(name, base) if base else os.path.basename(name))
                os.makedirs(os.path.dirname(final), exist_ok=True)
                temporary = f"{final}.{uuid.uuid4().hex}.tmp"
                with open(temporary, "wb") as out:
                    out.write(content)
                os.replace(temporary, final)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.where("error is null").select("name", "content").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
