"""Frames and images of one data set, with numpy: splitting, decoding, encoding, grey-level and colour pipelines.

Native, run-length coded, deflated and JPEG frames (sequential and lossless Huffman coding) are decoded; other codings have no library here and give DecoderError.
Stored values are arrays of rows by columns, by three for colour.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from lumenframe.functions import jpeg

RLE = "1.2.840.10008.1.2.5"
DEFLATED_FRAME = "1.2.840.10008.1.2.8.1"
JPEG = {"1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.51", "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70"}
NATIVE = {"1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.1.98"}


class DecoderError(ValueError):
    """A coding that cannot be decoded here, or data that do not fit their description."""


@dataclass
class Description:
    """The image pixel module."""

    rows: int
    columns: int
    bits_allocated: int
    bits_stored: int = 0
    signed: bool = False
    samples: int = 1
    planar: bool = False
    photometric: str = "MONOCHROME2"
    frames: int = 1

    def __post_init__(self) -> None:
        self.bits_stored = self.bits_stored or self.bits_allocated

    @property
    def frame_bits(self) -> int:
        samples = 2 if self.photometric in ("YBR_FULL_422", "YBR_PARTIAL_422") else self.samples
        return self.rows * self.columns * samples * self.bits_allocated

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"<{'i' if self.signed else 'u'}{max(1, self.bits_allocated // 8)}")


def native_frames(data: bytes, d: Description) -> list[tuple[int, int, bytes]]:
    """(index, bit offset of the first pixel, bytes) of the frames; an incomplete last one is left out."""
    out = []
    for i in range(d.frames):
        start, end = i * d.frame_bits, (i + 1) * d.frame_bits
        if end > len(data) * 8:
            break
        out.append((i, start % 8, data[start // 8 : -(-end // 8)]))
    return out


def offsets(basic: bytes, extended: bytes | None = None) -> list[int]:
    """Offsets of the frames from a basic or extended table."""
    if extended:
        return [x[0] for x in struct.iter_unpack("<Q", extended)]
    return [x[0] for x in struct.iter_unpack("<I", basic)]


def encapsulated_frames(fragments: list[bytes], frames: int, extended: bytes | None = None, lengths: bytes | None = None) -> list[tuple[int, bytes]]:
    """(index, bytes) of the frames: by an offset table, else a fragment each, else all fragments one frame.

    A fragment belongs to the frame with the greatest offset that is not after it.
    """
    table, parts = offsets(fragments[0] if fragments else b"", extended), fragments[1:]
    if not table:
        if frames > 1:
            if len(parts) != frames:
                raise DecoderError(f"{len(parts)} fragments for {frames} frames without an offset table")
            return list(enumerate(parts))
        return [(0, b"".join(parts))] if parts else []
    if sorted(table) != table or table[0] != 0:
        raise DecoderError("offsets do not ascend from 0")
    held: list[list[bytes]] = [[] for _ in table]
    at, frame = 0, 0
    for part in parts:
        while frame + 1 < len(table) and at >= table[frame + 1]:
            frame += 1
        held[frame].append(part)
        at += 8 + len(part)
    out = [b"".join(h) for h in held]
    if lengths:
        out = [o[: n[0]] for o, n in zip(out, struct.iter_unpack("<Q", lengths), strict=False)]
    return list(enumerate(out[:frames] if frames else out))


def unpack_bits(data: bytes) -> bytes:
    """PackBits decoding of one segment."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits coding: runs of two or more equal bytes, else literals."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    edges = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        n = b - a
        if n == 1 or (n == 2 and literal):
            literal += data[a:b]
            continue
        flush()
        while n > 0:
            step = min(n, 128)
            if step == 1:
                literal += data[a : a + 1]
            else:
                out += bytes((257 - step, data[a]))
            n -= step
    flush()
    return bytes(out)


def rle_decode(data: bytes, d: Description) -> bytes:
    """Native bytes of a run-length coded frame, samples interleaved; missing bytes are zero."""
    if len(data) < 64:
        raise DecoderError("no run-length header")
    header = struct.unpack("<16I", data[:64])
    n, width = header[0], max(1, d.bits_allocated // 8)
    if n != d.samples * width:
        raise DecoderError(f"{n} segments for {d.samples} samples of {width} bytes")
    size = d.rows * d.columns
    bounds = [*header[1 : n + 1], len(data)]
    out = np.zeros((size, d.samples, width), np.uint8)
    for i in range(n):
        part = np.frombuffer(unpack_bits(data[bounds[i] : bounds[i + 1]])[:size], np.uint8)
        out[: len(part), i // width, width - 1 - i % width] = part
    return out.tobytes()


def rle_encode(data: bytes, d: Description) -> bytes:
    """Run-length coding of interleaved native bytes, row by row."""
    width = max(1, d.bits_allocated // 8)
    x = np.frombuffer(data, np.uint8)[: d.rows * d.columns * d.samples * width].reshape(d.rows, d.columns, d.samples, width)
    segments = []
    for sample in range(d.samples):
        for byte in range(width - 1, -1, -1):
            coded = b"".join(pack_bits(x[r, :, sample, byte].tobytes()) for r in range(d.rows))
            segments.append(coded + b"\0" * (len(coded) % 2))
    starts = np.cumsum([64] + [len(s) for s in segments[:-1]]).tolist()
    return struct.pack("<16I", len(segments), *starts, *[0] * (15 - len(starts))) + b"".join(segments)


def decode(data: bytes, d: Description, syntax: str, bit_offset: int = 0) -> np.ndarray:
    """Stored values of a frame: (rows, columns) or (rows, columns, 3)."""
    if syntax in JPEG:
        return _jpeg(data, d)
    if syntax == RLE:
        data, planar = rle_decode(data, d), False
    elif syntax == DEFLATED_FRAME:
        try:
            data, planar = zlib.decompressobj(-15).decompress(data, -(-d.frame_bits // 8) + 1), d.planar  # never more than a frame
        except zlib.error as e:
            raise DecoderError(str(e)) from e
    elif syntax in NATIVE:
        planar = d.planar
    else:
        raise DecoderError(f"no decoder for {syntax}")
    n = d.rows * d.columns
    if d.bits_allocated == 1:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[bit_offset : bit_offset + n]
        if len(bits) < n:
            raise DecoderError("frame is too short")
        return bits.reshape(d.rows, d.columns)
    if d.photometric == "YBR_FULL_422" and syntax in NATIVE:
        raw = np.frombuffer(data, d.dtype)[: n * 2].reshape(-1, 4)
        out = np.stack([raw[:, :2], np.repeat(raw[:, 2:3], 2, 1), np.repeat(raw[:, 3:4], 2, 1)], -1)
        return out.reshape(d.rows, d.columns, 3)
    need = n * d.samples * d.dtype.itemsize
    if len(data) < need:
        raise DecoderError(f"frame has {len(data)} bytes, not {need}")
    x = np.frombuffer(data, d.dtype, n * d.samples)
    if d.samples == 1:
        x = x.reshape(d.rows, d.columns)
    else:
        x = x.reshape(d.samples, d.rows, d.columns).transpose(1, 2, 0) if planar else x.reshape(d.rows, d.columns, d.samples)
    spare = d.bits_allocated - d.bits_stored
    if spare and d.samples == 1:
        # Bits above the stored ones are not part of the value.
        wide = x.astype(f"<u{d.dtype.itemsize}") << spare
        x = (wide.view(d.dtype) >> spare) if d.signed else wide >> spare
    return x


def _jpeg(data: bytes, d: Description) -> np.ndarray:
    try:
        x = jpeg.decode(data)
    except (ValueError, IndexError, struct.error) as e:
        raise DecoderError(f"JPEG: {e}") from e
    if x.shape != ((d.rows, d.columns) if d.samples == 1 else (d.rows, d.columns, d.samples)):
        raise DecoderError(f"JPEG image of {x.shape}")
    if d.signed:
        spare = d.dtype.itemsize * 8 - d.bits_stored
        return (x.astype(f"<u{d.dtype.itemsize}") << spare).view(d.dtype) >> spare
    return x


def encode(image: np.ndarray, d: Description, syntax: str) -> bytes:
    """Bytes of a frame of stored values."""
    if d.bits_allocated == 1:
        return np.packbits(image.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
    x = image.astype(d.dtype)
    if syntax == RLE:
        return rle_encode(x.tobytes(), d)
    if d.samples == 3 and d.planar:
        x = x.transpose(2, 0, 1)
    data = np.ascontiguousarray(x).tobytes()
    if syntax == DEFLATED_FRAME:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = c.compress(data) + c.flush()
    return data + b"\0" * (len(data) % 2)


# -- grey levels --------------------------------------------------------------------------------------------


@dataclass
class Lut:
    """A table of values from a first input value on."""

    first: int
    data: np.ndarray
    bits: int

    def at(self, x: np.ndarray) -> np.ndarray:
        return self.data[np.clip(x.astype(np.int64) - self.first, 0, len(self.data) - 1)]

    def normalised(self, x: np.ndarray) -> np.ndarray:
        return self.at(x).astype(np.float32) / np.float32(2**self.bits - 1)


def lut_of(descriptor: list[int], data: bytes, signed: bool = False) -> Lut:
    """A table from its descriptor (entries, first value, bits) and its bytes; 0 entries mean 65536."""
    entries, first, bits = descriptor[0] or 65_536, descriptor[1], descriptor[2]
    if signed and first > 32_767:
        first -= 65_536
    x = np.frombuffer(data, "<u2" if bits > 8 or len(data) >= 2 * entries else np.uint8)[:entries].astype(np.int64)
    return Lut(first, x, bits)


def segmented(words: list[int]) -> np.ndarray:
    """Data of a segmented table: discrete (0) and linear (1) segments."""
    out: list[int] = []
    at = 0
    while at < len(words):
        kind, n = words[at], words[at + 1]
        if kind == 0:
            out += words[at + 2 : at + 2 + n]
            at += 2 + n
        elif kind == 1:
            if not out:
                raise DecoderError("a linear segment needs a value before it")
            start, end = out[-1], words[at + 2]
            out += [round(start + (end - start) * i / n) for i in range(1, n + 1)]
            at += 3
        else:
            raise DecoderError("indirect segments are not supported")
    return np.array(out, np.int64)


@dataclass
class Window:
    center: float
    width: float
    function: str = "LINEAR"

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        if self.function == "SIGMOID":
            return 1 / (1 + np.exp(-4 * (x - np.float32(self.center)) / np.float32(self.width)))
        if self.function == "LINEAR_EXACT":
            return np.clip((x - np.float32(self.center)) / np.float32(self.width) + np.float32(0.5), 0, 1)
        if self.width <= 1:
            return (x > self.center - 0.5).astype(np.float32)
        return np.clip((x - np.float32(self.center - 0.5)) / np.float32(self.width - 1) + np.float32(0.5), 0, 1)


def window_of(image: np.ndarray) -> Window:
    """The window that covers an image."""
    least, most = float(image.min()), float(image.max())
    return Window((least + most) / 2, max(most - least, 1.0), "LINEAR_EXACT")


@dataclass
class Grey:
    """Modality, values-of-interest and presentation steps."""

    slope: float = 1.0
    intercept: float = 0.0
    modality: Lut | None = None
    window: Window | None = None
    voi: Lut | None = None
    inverse: bool = False
    presentation: Lut | None = None
    cache: np.ndarray | None = None
    first: int = 0

    def render(self, stored: np.ndarray) -> np.ndarray:
        """Eight-bit grey levels; those of up to 65 536 different stored values are worked out once and kept for further frames."""
        if not stored.size:
            return stored.astype(np.uint8)
        least, most = int(stored.min()), int(stored.max())
        if self.window is None and self.voi is None or most - least >= 65_536:
            return self.levels(stored)
        if self.cache is None or least < self.first or most >= self.first + len(self.cache):
            low, high = (least, most) if self.cache is None else (min(least, self.first), max(most, self.first + len(self.cache) - 1))
            if high - low >= 65_536:
                return self.levels(stored)
            self.first, self.cache = low, self.levels(np.arange(low, high + 1))
        return self.cache[stored.astype(np.int64) - self.first]

    def levels(self, stored: np.ndarray) -> np.ndarray:
        x = self.modality.at(stored).astype(np.float32) if self.modality else stored.astype(np.float32) * np.float32(self.slope) + np.float32(self.intercept)
        if self.voi:
            level = self.voi.normalised(x)
        else:
            level = (self.window or window_of(x)).apply(x)
        if self.presentation:
            level = self.presentation.normalised(np.floor(level * (len(self.presentation.data) - 1) + 0.5) + self.presentation.first)
        elif self.inverse:
            level = 1 - level
        return np.clip(np.floor(level * 255 + 0.5), 0, 255).astype(np.uint8)


def standard_palette(name: str) -> np.ndarray:
    """256 RGB colours of a palette of the standard, from the straight lines it is made of; each level is rounded down."""
    if name == "PET_20_STEP":
        steps = np.array([c for c, _ in STEPS], np.uint8)
        return np.repeat(steps, [n for _, n in STEPS], axis=0)
    i = np.arange(256)
    channels = []
    for points in PALETTES[name]:
        at, level = zip(*points, strict=True)
        line = np.interp(i, at, np.array(level, float))
        channels.append(np.clip(np.floor(line + 1e-9), 0, 255).astype(np.uint8))
    return np.stack(channels, -1)


# Fixed values of the standard: (index, level) where the lines of red, green and blue begin and end.
PALETTES = {
    "HOT_IRON": ([(0, 0), (128, 256)], [(128, 0), (254, 252), (255, 255)], [(191, 0), (255, 256)]),
    "PET": ([(63, 0), (192, 255)], [(0, 0), (63, 128), (128, 0), (255, 255)], [(0, 0), (127, 253.0078125), (128, 256), (192, 0), (255, 255)]),
    "SPRING": ([(0, 255)], [(0, 0), (255, 255)], [(0, 255), (255, 0)]),
    "SUMMER": ([(0, 0)], [(0, 255.5), (255, 128)], [(127, 0.5), (255, 254.5)]),
    "FALL": ([(0, 255)], [(0, 255), (255, 0)], [(0, 0)]),
    "WINTER": ([(127, 0.5), (255, 127.5)], [(0, 0), (255, 255)], [(0, 255.5), (255, 128)]),
}
# Fixed values of the standard: the twenty colours of the stepped palette, and how many levels each has.
STEPS = [
    ((0, 0, 0), 13), ((96, 0, 80), 13), ((48, 48, 80), 13), ((48, 48, 112), 12), ((80, 80, 128), 13), ((96, 96, 176), 13), ((112, 112, 192), 13), ((128, 128, 224), 12), ((48, 96, 48), 13), ((48, 144, 48), 13),
    ((80, 192, 80), 13), ((64, 224, 64), 12), ((224, 224, 80), 13), ((208, 208, 96), 13), ((208, 176, 64), 13), ((208, 144, 0), 12), ((192, 96, 0), 13), ((176, 48, 0), 13), ((255, 0, 0), 13), ((255, 255, 255), 13),
]


def png(image: np.ndarray) -> bytes:
    """A grey or RGB image of eight or sixteen bits as a PNG file."""
    depth = 16 if image.dtype.itemsize == 2 else 8
    rows = np.ascontiguousarray(image.astype(">u2" if depth == 16 else np.uint8)).reshape(image.shape[0], -1).view(np.uint8).reshape(image.shape[0], -1)
    lines = np.concatenate([np.zeros((image.shape[0], 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


# -- colour and geometry ------------------------------------------------------------------------------------


def ybr_to_rgb(x: np.ndarray, bits: int = 8) -> np.ndarray:
    half, most = 2 ** (bits - 1), 2**bits - 1
    y, cb, cr = (x[..., i].astype(np.float64) for i in range(3))
    out = np.stack([y + 1.402 * (cr - half), y - 0.344136 * (cb - half) - 0.714136 * (cr - half), y + 1.772 * (cb - half)], -1)
    return np.clip(np.floor(out + 0.5), 0, most).astype(x.dtype)


def rgb_to_ybr(x: np.ndarray, bits: int = 8) -> np.ndarray:
    half, most = 2 ** (bits - 1), 2**bits - 1
    r, g, b = (x[..., i].astype(np.float64) for i in range(3))
    out = np.stack([0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + half, 0.5 * r - 0.418688 * g - 0.081312 * b + half], -1)
    return np.clip(np.floor(out + 0.5), 0, most).astype(x.dtype)


def palette(x: np.ndarray, red: Lut, green: Lut, blue: Lut) -> np.ndarray:
    """RGB of palette indexes, at eight bits."""
    return np.stack([(t.at(x) >> (t.bits - 8 if t.bits > 8 else 0)).astype(np.uint8) for t in (red, green, blue)], -1)


def cut_out(image: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """A rectangle; sizes of 0 or less count from the far edge."""
    w = width if width > 0 else image.shape[1] - x + width
    h = height if height > 0 else image.shape[0] - y + height
    return image[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]


def blackened(image: np.ndarray, x: int, y: int, width: int, height: int, photometric: str = "MONOCHROME2") -> np.ndarray:
    """A rectangle in the black of the colour space."""
    out = image.copy()
    most = np.iinfo(image.dtype).max
    black = [0, most // 2 + 1, most // 2 + 1] if photometric.startswith("YBR") else most if photometric == "MONOCHROME1" else 0
    out[max(0, y) : max(0, y + height), max(0, x) : max(0, x + width)] = black
    return out


ORIENTATIONS = {
    "rotate-90": lambda a: np.rot90(a, -1), "rotate-180": lambda a: np.rot90(a, 2), "rotate-270": lambda a: np.rot90(a, 1),
    "flip-horizontal": lambda a: a[:, ::-1], "flip-vertical": lambda a: a[::-1], "rotate-90-flip-horizontal": lambda a: np.rot90(a, -1)[:, ::-1],
    "rotate-270-flip-horizontal": lambda a: np.rot90(a, 1)[:, ::-1], "identity": lambda a: a,
}


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest neighbours."""
    rows = np.minimum((np.arange(height) + 0.5) * image.shape[0] / height, image.shape[0] - 1).astype(int)
    columns = np.minimum((np.arange(width) + 0.5) * image.shape[1] / width, image.shape[1] - 1).astype(int)
    return image[rows][:, columns]


def overlaid(image: np.ndarray, bits: np.ndarray, origin: tuple[int, int], colour: int = 255) -> np.ndarray:
    """Overlay pixels drawn over an image; origin (row, column) counts from 1."""
    out = image.copy()
    r0, c0 = origin[0] - 1, origin[1] - 1
    rows, columns = np.nonzero(bits)
    inside = (rows + r0 >= 0) & (rows + r0 < out.shape[0]) & (columns + c0 >= 0) & (columns + c0 < out.shape[1])
    out[rows[inside] + r0, columns[inside] + c0] = colour
    return out
