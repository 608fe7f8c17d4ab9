"""DICOM Part 10 files: a reader that walks elements in one pass, and a writer.

The reader holds one value at a time, stops after the largest wanted tag, reads all native and encapsulated syntaxes
including deflated ones, and takes files that end on the border of two elements.  A sequence comes as an element of its
own after what lies in it, with the number of its items.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field

from lumenframe.sources import values as V

IMPLICIT, EXPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
UNDEFINED = 0xFFFFFFFF
ITEM, ITEM_END, SEQUENCE_END, PADDING, PIXELS = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFCFFFC, 0x7FE00010
CHARSET, REPRESENTATION = 0x00080005, 0x00280103

Path = tuple[tuple[str, int], ...]


class P10Error(ValueError):
    """A file that cannot be read on; ``offset`` is where."""

    def __init__(self, message: str, offset: int) -> None:
        super().__init__(f"{message} at byte {offset}")
        self.offset = offset


@dataclass
class Config:
    """Limits and choices of a read."""

    max_depth: int = 10_000
    max_value: int = 2**32 - 2
    max_string: int = 2**32 - 2
    require_prefix: bool = False
    default_syntax: str = IMPLICIT
    tags: frozenset[int] | None = None
    dictionary: dict[int, str] = field(default_factory=dict)


@dataclass
class Element:
    path: Path
    tag: int
    vr: str
    value: bytes = b""
    fragments: list[bytes] | None = None
    charset: str | None = None
    items: int | None = None

    @property
    def hex(self) -> str:
        return f"{self.tag:08X}"


class Bytes:
    """A stream of bytes with a position; chunks of any size give the same result."""

    def __init__(self, source: Iterable[bytes] | bytes | io.RawIOBase) -> None:
        if isinstance(source, bytes):
            source = [source]
        elif hasattr(source, "read"):
            file = source
            source = iter(lambda: file.read(262_144), b"")
        self.chunks = iter(source)
        self.held, self.at, self.pos = b"", 0, 0

    def peek(self, n: int) -> bytes:
        if len(self.held) - self.at < n:
            parts, size = [self.held[self.at :]], len(self.held) - self.at
            while size < n and (chunk := next(self.chunks, None)) is not None:
                parts.append(chunk)
                size += len(chunk)
            self.held, self.at = b"".join(parts), 0
        return self.held[self.at : self.at + n]

    def read(self, n: int) -> bytes:
        data = self.peek(n)
        if len(data) < n:
            raise P10Error(f"ends within {n} bytes", self.pos)
        self.at += n
        self.pos += n
        return data

    def rest(self) -> Iterator[bytes]:
        yield self.held[self.at :]
        yield from self.chunks

    def ended(self) -> bool:
        return not self.peek(1)


def inflated(chunks: Iterable[bytes], step: int = 65_536) -> Iterator[bytes]:
    """Raw inflate in bounded steps."""
    d = zlib.decompressobj(-15)
    for chunk in chunks:
        while chunk:
            yield d.decompress(chunk, step)
            chunk = d.unconsumed_tail
    yield d.flush()


def is_p10(head: bytes) -> bool:
    return head[128:132] == b"DICM"


def settled(vr: str, representation: int | None) -> str:
    """One of several representations that a dictionary allows in an implicit file: signed or not by the pixel representation, words for bytes or words."""
    if vr in ("US_SS", "US or SS"):
        return "SS" if representation else "US"
    return "OW" if vr in ("OB or OW", "OB_OW", "US or OW", "US_OW", "US or SS or OW") else vr


class Walker:
    """Reads the elements of one file."""

    def __init__(self, source: Iterable[bytes] | bytes | io.RawIOBase, config: Config | None = None) -> None:
        self.bytes, self.config = Bytes(source), config or Config()
        self.syntax: str | None = None
        self.last = max(self.config.tags) if self.config.tags else None

    def elements(self) -> Iterator[Element]:
        yield from self.header()
        if self.syntax == DEFLATED:
            self.bytes = Bytes(inflated(self.bytes.rest()))
        yield from self.body(None, {})

    def body(self, charset: str | None, clarify: dict) -> Iterator[Element]:
        """The elements of the data set from a border of two root elements on."""
        yield from self._data_set((), UNDEFINED, charset, self.syntax == IMPLICIT, self.syntax == BIG, clarify)

    def header(self) -> Iterator[Element]:
        """Preamble and file meta information, which name the transfer syntax."""
        b = self.bytes
        if is_p10(b.peek(132)):
            b.read(132)
        elif self.config.require_prefix:
            raise P10Error("no DICM prefix", 0)
        while len(head := b.peek(8)) == 8 and struct.unpack("<H", head[:2])[0] == 2:
            for e in self._standard((), None, False, False):
                if e.tag == 0x00020010:
                    self.syntax = V.trim(e.value.decode("ascii", "replace"), "UI")
                if e.tag & 0xFFFF:
                    yield from self._wanted(e)
        self.syntax = self.syntax or self.config.default_syntax

    def tokens(self, most: int = 262_144) -> Iterator[tuple]:
        """The file as a flat sequence of bounded tokens: ("element", path, tag, vr, length), ("bytes", data, left) of at most ``most`` bytes each,
        ("items", path, tag, n) after what lies in a sequence."""
        for e in self.elements():
            if e.vr == "SQ":
                yield "items", e.path, e.hex, e.items
                continue
            parts = e.fragments if e.fragments is not None else [e.value]
            yield "element", e.path, e.hex, e.vr, sum(map(len, parts))
            left = sum(map(len, parts))
            for part in parts:
                for i in range(0, len(part), most):
                    data = part[i : i + most]
                    left -= len(data)
                    yield "bytes", data, left

    def _wanted(self, e: Element) -> Iterator[Element]:
        root = int(e.path[0][0], 16) if e.path else e.tag
        if self.config.tags is None or root in self.config.tags:
            yield e

    def _header(self, implicit: bool, big: bool, clarify: dict) -> tuple[int, str, int]:
        order = ">" if big else "<"
        group, element = struct.unpack(order + "HH", self.bytes.read(4))
        tag = group << 16 | element
        if group == 0xFFFE:
            return tag, "", struct.unpack(order + "I", self.bytes.read(4))[0]
        if implicit:
            return tag, self._implied(tag, clarify), struct.unpack("<I", self.bytes.read(4))[0]
        vr = self.bytes.read(2).decode("latin-1")
        if not vr.strip(" \0"):
            self.bytes.read(2)
            return tag, "UN", struct.unpack(order + "I", self.bytes.read(4))[0]
        if vr in V.LONG_LENGTH:
            self.bytes.read(2)
            return tag, vr, struct.unpack(order + "I", self.bytes.read(4))[0]
        if vr not in V.TEXT | V.ASCII | V.BINARY | set(V.NUMBERS):
            raise P10Error(f"unknown value representation {vr!r}", self.bytes.pos)
        return tag, vr, struct.unpack(order + "H", self.bytes.read(2))[0]

    def _implied(self, tag: int, clarify: dict) -> str:
        if tag & 0xFFFF == 0:
            return "UL"
        if tag >> 16 & 1 and 0x10 <= tag & 0xFFFF <= 0xFF:
            return "LO"
        vr = self.config.dictionary.get(tag, "UN")
        return settled(vr, clarify.get(REPRESENTATION))

    def _standard(self, path: Path, charset: str | None, implicit: bool, big: bool) -> Iterator[Element]:
        tag, vr, length = self._header(implicit, big, {})
        yield Element(path, tag, vr, self._value(length, vr, big), charset=charset)

    def _value(self, length: int, vr: str, big: bool) -> bytes:
        if length > (min(self.config.max_value, self.config.max_string) if vr in V.TEXT or vr in V.ASCII else self.config.max_value):
            raise P10Error(f"value of {length} bytes is too long", self.bytes.pos)
        data = self.bytes.read(length)
        return V.swap(data, vr) if big else data

    def _data_set(self, path: Path, end: int, charset: str | None, implicit: bool, big: bool, clarify: dict) -> Iterator[Element]:
        if len(path) > self.config.max_depth:
            raise P10Error("sequences are nested too deeply", self.bytes.pos)
        clarify = dict(clarify)
        while (end == UNDEFINED or self.bytes.pos < end) and not self.bytes.ended():
            tag, vr, length = self._header(implicit, big, clarify)
            if tag == ITEM_END:
                return
            if tag == SEQUENCE_END:
                continue
            if not path and self.last is not None and tag > self.last:
                return
            if vr == "SQ" or (length == UNDEFINED and tag != PIXELS):
                inner = implicit or vr == "UN"
                n = yield from self._sequence(path, tag, length, charset, inner, big and vr != "UN", clarify)
                yield from self._wanted(Element(path, tag, "SQ", items=n))
                continue
            if length == UNDEFINED:
                yield from self._wanted(Element(path, tag, vr, fragments=self._fragments(big)))
                continue
            value = self._value(length, vr, big)
            if tag == CHARSET:
                charset = value.decode("ascii", "replace").strip(" \0")
            elif tag == REPRESENTATION and len(value) >= 2:
                clarify[REPRESENTATION] = struct.unpack("<H", value[:2])[0]
            if tag & 0xFFFF and tag != PADDING:
                yield from self._wanted(Element(path, tag, vr, value, charset=charset))

    def _sequence(self, path: Path, tag: int, length: int, charset: str | None, implicit: bool, big: bool, clarify: dict) -> Generator[Element, None, int]:
        """The elements of all items; returns how many items there are."""
        end = UNDEFINED if length == UNDEFINED else self.bytes.pos + length
        n = 0
        while (end == UNDEFINED or self.bytes.pos < end) and not self.bytes.ended():
            item, _, size = self._header(implicit, big, clarify)
            if item == SEQUENCE_END:
                return n
            if item != ITEM:
                raise P10Error(f"{item:08X} where an item should be", self.bytes.pos)
            stop = UNDEFINED if size == UNDEFINED else self.bytes.pos + size
            yield from self._data_set((*path, (f"{tag:08X}", n)), stop, charset, implicit, big, clarify)
            n += 1
        return n

    def _fragments(self, big: bool) -> list[bytes]:
        found = []
        while True:
            tag, _, length = self._header(False, big, {})
            if tag == SEQUENCE_END:
                return found
            if tag != ITEM:
                raise P10Error(f"{tag:08X} among fragments", self.bytes.pos)
            found.append(self.bytes.read(length))


class Pushed:
    """A reader that bytes are pushed into as they come: it gives out the elements that are whole and keeps only the bytes behind the last whole root element.

    Chunks of any size give the same elements.  While a long element comes in, reading is tried again only when the bytes held have doubled.
    """

    def __init__(self, config: Config | None = None) -> None:
        self.config = config or Config()
        self.held, self.again = bytearray(), 0
        self.syntax: str | None = None
        self.charset: str | None = None
        self.clarify: dict = {}
        self.inflate = None

    def push(self, data: bytes, last: bool = False) -> list[Element]:
        """The elements that have become whole; with ``last`` the file ends here, and an incomplete element raises P10Error."""
        self.held += self.inflate.decompress(data) if self.inflate else data
        if not last and (len(self.held) < self.again or self.syntax is None and len(self.held) < 140):
            return []
        found: list[Element] = []
        whole = 0
        walker = Walker(bytes(self.held), Config(**{**self.config.__dict__, "tags": None}))
        try:
            if self.syntax is None:
                found += walker.header()
                if not last and len(walker.bytes.peek(8)) < 8:
                    self.again = len(self.held) + 1
                    return []
                self.syntax, whole = walker.syntax, walker.bytes.pos
                if self.syntax == DEFLATED:
                    self.inflate = zlib.decompressobj(-15)
                    rest = bytes(self.held[whole:])
                    self.held, self.again = bytearray(), 0
                    return self._wanted(found) + self.push(rest, last)
            walker.syntax = self.syntax
            open_: list[Element] = []
            for e in walker.body(self.charset, self.clarify):
                open_.append(e)
                if e.path:
                    continue
                if not last and walker.bytes.pos >= len(self.held):
                    break  # a sequence may go on where the bytes end
                found += open_
                open_, whole = [], walker.bytes.pos
                if e.tag == CHARSET:
                    self.charset = e.value.decode("ascii", "replace").strip(" \0")
                elif e.tag == REPRESENTATION and len(e.value) >= 2:
                    self.clarify[REPRESENTATION] = struct.unpack("<H", e.value[:2])[0]
            else:
                whole = walker.bytes.pos
        except P10Error:
            if last:
                raise
        if self.syntax is None:
            found = []
        del self.held[:whole]
        self.again = 2 * len(self.held) if self.held else 0
        return self._wanted(found)

    def _wanted(self, found: list[Element]) -> list[Element]:
        tags = self.config.tags
        return [e for e in found if tags is None or (int(e.path[0][0], 16) if e.path else e.tag) in tags]


def _head(tag: int, vr: str, length: int, implicit: bool, big: bool) -> bytes:
    order = ">" if big else "<"
    start = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF)
    if implicit or tag >> 16 == 0xFFFE:
        return start + struct.pack(order + "I", length)
    if vr in V.LONG_LENGTH:
        return start + vr.encode() + b"\0\0" + struct.pack(order + "I", length)
    if length > 0xFFFF:
        return start + b"UN\0\0" + struct.pack(order + "I", length)
    return start + vr.encode() + struct.pack(order + "H", length)


DataSet = dict[int, tuple[str, "bytes | list[bytes] | list[DataSet]"]]


def tree(elements: Iterable[Element]) -> DataSet:
    """Elements as a nested data set: tag to (vr, value); sequences hold lists of data sets, fragments lists of bytes."""
    root: DataSet = {}
    for e in elements:
        at = root
        for tag, item in e.path:
            held = at.setdefault(int(tag, 16), ("SQ", []))[1]
            while len(held) <= item:
                held.append({})  # type: ignore[union-attr]
            at = held[item]  # type: ignore[assignment]
        if e.vr == "SQ":
            held = at.setdefault(e.tag, ("SQ", []))[1]
            while len(held) < (e.items or 0):
                held.append({})  # type: ignore[union-attr]
        else:
            at[e.tag] = (e.vr, e.value if e.fragments is None else e.fragments)
    return root


def _body(data_set: DataSet, implicit: bool, big: bool) -> Iterator[bytes]:
    for tag in sorted(data_set):
        vr, value = data_set[tag]
        if vr == "SQ":
            yield _head(tag, vr, UNDEFINED, implicit, big)
            for item in value:
                yield _head(ITEM, "", UNDEFINED, implicit, big)
                yield from _body(item, implicit, big)  # type: ignore[arg-type]
                yield _head(ITEM_END, "", 0, implicit, big)
            yield _head(SEQUENCE_END, "", 0, implicit, big)
        elif isinstance(value, list):
            yield _head(tag, vr, UNDEFINED, implicit, big)
            for part in value:
                yield _head(ITEM, "", len(part) + len(part) % 2, implicit, big) + part + b"\0" * (len(part) % 2)  # type: ignore[operator]
            yield _head(SEQUENCE_END, "", 0, implicit, big)
        else:
            data = value + (b"\0" if vr in V.BINARY or vr == "UI" else b" ") * (len(value) % 2)
            yield _head(tag, vr, len(data), implicit, big) + (V.swap(data, vr) if big else data)


def write(elements: Iterable[Element], syntax: str = EXPLICIT, level: int = 6, implementation: str = "2.25.1", version: str | None = None, header: bool = True) -> bytes:
    """The file of a data set; group 2 is made anew, sequences have undefined length, text is UTF-8.  Without ``header`` neither preamble nor group 2 is written."""
    root = tree(e for e in elements if e.tag >> 16 != 2)
    root[CHARSET] = ("CS", b"ISO_IR 192")
    data = b"".join(_body(root, syntax == IMPLICIT, syntax == BIG))
    meta = [(0x00020001, "OB", b"\0\1")]
    for tag, source in ((0x00020002, 0x00080016), (0x00020003, 0x00080018)):
        if source in root:
            uid = root[source][1]
            meta.append((tag, "UI", uid + b"\0" * (len(uid) % 2)))  # type: ignore[operator,arg-type]
    meta += [(0x00020010, "UI", V.from_json([syntax], "UI")), (0x00020012, "UI", V.from_json([implementation], "UI"))]
    if version:
        meta.append((0x00020013, "SH", V.from_json([version[:16]], "SH")))
    group = b"".join(_head(t, vr, len(v), False, False) + v for t, vr, v in meta)
    if syntax == DEFLATED:
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        data = c.compress(data) + c.flush()
        data += b"\0" * (len(data) % 2)
    if not header:
        return data
    return b"\0" * 128 + b"DICM" + _head(0x00020000, "UL", 4, False, False) + struct.pack("<I", len(group)) + group + data
