"""JPEG frames with Huffman coding: sequential (8 and 12 bits) and lossless, in Python and numpy.

Entropy decoding goes bit by bit in Python and is slow; everything behind it is
vectorised.  Progressive, hierarchical and arithmetic coding are not read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the standard: the order in which coefficients are stored.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
SEQUENTIAL, LOSSLESS = (0xC0, 0xC1), 0xC3


class JpegError(ValueError):
    """A stream that is broken or coded in a way that is not read here."""


@dataclass
class Component:
    number: int
    across: int
    down: int
    table: int
    dc: int = 0
    ac: int = 0


@dataclass
class Frame:
    process: int
    precision: int
    rows: int
    columns: int
    components: list[Component] = field(default_factory=list)


def _huffman(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits ahead: symbol · 32 + length, 0 where there is no code."""
    table = [0] * 65_536
    code = at = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            table[first : first + (1 << (16 - length))] = [symbols[at] * 32 + length] * (1 << (16 - length))
            code += 1
            at += 1
        code <<= 1
    return table


class Bits:
    """Bits of one restart interval; past its end there are zeros."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def ahead(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.at += 8
        self.held = (self.held << 64) | int.from_bytes(part.ljust(8, b"\0"), "big")
        self.n += 64

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.ahead()
        found = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not found:
            raise JpegError("no such code")
        self.n -= found & 31
        self.held &= (1 << self.n) - 1
        if self.at - self.n // 8 > len(self.data) + 8:
            raise JpegError("scan is too short")
        return found >> 5

    def signed(self, size: int) -> int:
        """A number of that many bits; those that begin with 0 are negative."""
        if not size:
            return 0
        if self.n < size:
            self.ahead()
        self.n -= size
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value if value >> (size - 1) else value - (1 << size) + 1


def decode(data: bytes) -> np.ndarray:
    """Samples as rows by columns, by components if there are several."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no JPEG stream")
    quantisers: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], list[int]] = {}
    frame, restart, at = None, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError(f"no marker at {at}")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if kind == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quantisers[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (*SEQUENTIAL, LOSSLESS):
            precision, rows, columns, n = struct.unpack(">BHHB", body[:6])
            frame = Frame(kind, precision, rows, columns, [Component(c, hv >> 4, hv & 15, t) for c, hv, t in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])])
        elif 0xC5 <= kind <= 0xCF or kind == 0xC2:
            raise JpegError(f"coding process {kind - 0xC0} is not read")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            if frame is None or body[0] != len(frame.components):
                raise JpegError("all components must be in one scan")
            for number, tables in struct.iter_unpack("BB", body[1 : 1 + 2 * body[0]]):
                c = next((c for c in frame.components if c.number == number), None)
                if c is None:
                    raise JpegError("unknown component")
                c.dc, c.ac = tables >> 4, tables & 15
            predictor, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
            parts = _intervals(data[at + 2 + size :])
            try:
                return _lossless(frame, parts, codes, restart, predictor, shift) if frame.process == LOSSLESS else _sequential(frame, parts, codes, quantisers, restart)
            except KeyError as e:
                raise JpegError(f"table {e} is missing") from e
        at += 2 + size
    raise JpegError("no scan")


def _intervals(data: bytes) -> list[bytes]:
    """The restart intervals of a scan, without stuffed bytes."""
    out, start, at = [], 0, data.find(b"\xff")
    while at >= 0 and at + 1 < len(data):
        follows = data[at + 1]
        if 0xD0 <= follows <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        elif follows not in (0, 0xFF):
            break
        at = data.find(b"\xff", at + (1 if follows == 0xFF else 2))
    out.append(data[start : at if at >= 0 else len(data)])
    return [o.replace(b"\xff\0", b"\xff") for o in out]


def _lossless(frame: Frame, parts: list[bytes], codes: dict, restart: int, predictor: int, shift: int) -> np.ndarray:
    n, width = len(frame.components), frame.columns
    if any((c.across, c.down) != (1, 1) for c in frame.components):
        raise JpegError("components of different size")
    if restart % width:
        raise JpegError("intervals do not end with rows")
    tables = [codes[0, c.dc] for c in frame.components]
    rows_each = restart // width or frame.rows
    out = np.zeros((frame.rows, width, n), np.int64)
    for i, part in enumerate(parts):
        top, bottom = i * rows_each, min(frame.rows, (i + 1) * rows_each)
        if top >= bottom:
            break
        bits = Bits(part)
        symbol, signed = bits.symbol, bits.signed
        found = []
        for _ in range((bottom - top) * width):
            for table in tables:
                size = symbol(table)
                found.append(32_768 if size == 16 else signed(size))
        differences = np.array(found, np.int64).reshape(bottom - top, width, n)
        for k in range(n):
            out[top:bottom, :, k] = _predicted(differences[..., k], predictor, 1 << (frame.precision - shift - 1))
    out = (out << shift) & 0xFFFF
    return (out[..., 0] if n == 1 else out).astype(np.uint16 if frame.precision > 8 else np.uint8)


def _predicted(d: np.ndarray, predictor: int, start: int) -> np.ndarray:
    """Samples from their differences to what is predicted from left, above and both."""
    first = d.copy()
    first[0, 0] += start
    if predictor == 1:
        first[:, 0] = np.cumsum(first[:, 0])
        return np.cumsum(first, axis=1) & 0xFFFF
    first[0] = np.cumsum(first[0])
    if predictor == 2:
        return np.cumsum(first, axis=0) & 0xFFFF
    ways = {3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1}
    if predictor not in ways:
        raise JpegError(f"no predictor {predictor}")
    way = ways[predictor]
    rows = [(first[0] & 0xFFFF).tolist()]
    for line in d[1:].tolist():
        above = rows[-1]
        left = (above[0] + line[0]) & 0xFFFF
        row = [left]
        for x in range(1, len(line)):
            left = (way(left, above[x], above[x - 1]) + line[x]) & 0xFFFF
            row.append(left)
        rows.append(row)
    return np.array(rows, np.int64)


def _sequential(frame: Frame, parts: list[bytes], codes: dict, quantisers: dict, restart: int) -> np.ndarray:
    most_across, most_down = max(c.across for c in frame.components), max(c.down for c in frame.components)
    if len(frame.components) == 1:
        frame.components[0].across = frame.components[0].down = most_across = most_down = 1
    units_across, units_down = -(-frame.columns // (8 * most_across)), -(-frame.rows // (8 * most_down))
    held = [np.zeros((units_down * c.down, units_across * c.across, 64), np.int64) for c in frame.components]
    tables = [(codes[0, c.dc], codes[1, c.ac]) for c in frame.components]
    unit, total = 0, units_across * units_down
    for part in parts:
        bits, before = Bits(part), [0] * len(held)
        symbol, signed = bits.symbol, bits.signed
        for _ in range(min(restart or total, total - unit)):
            y, x = divmod(unit, units_across)
            for i, c in enumerate(frame.components):
                dc, ac = tables[i]
                for v in range(c.down):
                    for h in range(c.across):
                        block = held[i][y * c.down + v, x * c.across + h]
                        before[i] += signed(symbol(dc))
                        block[0] = before[i]
                        k = 1
                        while k < 64:
                            s = symbol(ac)
                            run, size = s >> 4, s & 15
                            if not size:
                                if run < 15:
                                    break
                                k += 16
                                continue
                            k += run
                            if k > 63:
                                raise JpegError("too many coefficients")
                            block[ZIGZAG[k]] = signed(size)
                            k += 1
            unit += 1
    u = np.arange(8)
    base = np.cos((2 * u[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0)[None] / 2
    planes = []
    for c, blocks in zip(frame.components, held, strict=True):
        natural = np.zeros(64)
        natural[ZIGZAG] = quantisers[c.table]
        spatial = base @ (blocks * natural).reshape(*blocks.shape[:2], 8, 8) @ base.T
        plane = spatial.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
        plane = np.repeat(np.repeat(plane, most_down // c.down, 0), most_across // c.across, 1)
        planes.append(plane[: frame.rows, : frame.columns])
    levels = np.clip(np.floor(np.stack(planes, -1) + 2 ** (frame.precision - 1) + 0.5), 0, 2**frame.precision - 1)
    out = levels.astype(np.uint16 if frame.precision > 8 else np.uint8)
    return out[..., 0] if len(planes) == 1 else out
