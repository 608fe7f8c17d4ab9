"""Data sets as aligned text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

from lumenframe.functions.dictionaries import CODE_STRINGS, ELEMENTS, SOP_CLASSES, TRANSFER_SYNTAXES
from lumenframe.sources import p10
from lumenframe.sources import values as V

NAME_WIDTH = 37
UIDS = {u: n for u, n, _, _ in TRANSFER_SYNTAXES} | SOP_CLASSES


def graphemes(text: str) -> list[str]:
    """Characters with the combining marks that belong to them."""
    out: list[str] = []
    for c in text:
        if out and (unicodedata.combining(c) or c in "‍️" or out[-1].endswith("‍")):
            out[-1] += c
        else:
            out.append(c)
    return out


def clipped(text: str, width: int) -> str:
    """At most ``width`` graphemes, with an ellipsis where something is cut."""
    parts = graphemes(text)
    return text if len(parts) <= width else "".join(parts[: max(0, width - 2)]) + " …"


def shown(e: p10.Element, name_of_code: bool = True) -> str:
    """The value of an element."""
    if e.fragments is not None:
        return f"Items: {len(e.fragments)}, bytes: {sum(map(len, e.fragments))}"
    found = V.to_json(e.value, e.vr, e.charset)
    if found is None:
        return "[" + " ".join(f"{b:02X}" for b in e.value[:64]) + (" …" if len(e.value) > 64 else "") + "]"
    if e.vr in V.NUMBERS:
        return ", ".join(f"({x[:4]},{x[4:]})" if e.vr == "AT" else str(x) for x in found)
    text = V.texts(e.value, e.vr, e.charset)
    if not text:
        return '""'
    if e.vr == "DA" and len(text) == 1 and len(text[0]) == 8 and text[0].isdigit():
        return f"{text[0][:4]}-{text[0][4:6]}-{text[0][6:]}"
    if e.vr == "TM" and len(text) == 1 and text[0][:2].isdigit():
        t = text[0]
        return ":".join(x for x in (t[:2], t[2:4], t[4:]) if x)
    line = ", ".join(f'"{x}"' for x in text)
    if name_of_code and len(text) == 1:
        meaning = UIDS.get(text[0]) if e.vr == "UI" else CODE_STRINGS.get(e.hex, {}).get(text[0])
        return f"{line} ({meaning})" if meaning else line
    return line


def lines(elements: Iterable[p10.Element], width: int = 100, names: dict[str, str] | None = None) -> Iterator[str]:
    """Lines of a data set: indented elements, items and delimiters."""
    held = list(elements)
    charsets = {(e.path, e.tag): e.charset for e in held}
    yield from _lines(p10.tree(held), 0, (), charsets, width, {t: n for t, (_, n) in ELEMENTS.items()} | (names or {}))


def _lines(data_set: p10.DataSet, depth: int, path: p10.Path, charsets: dict, width: int, names: dict[str, str]) -> Iterator[str]:
    indent = "  " * depth
    for tag in sorted(data_set):
        vr, value = data_set[tag]
        hexa = f"{tag:08X}"
        name = names.get(hexa) or ("Private Creator" if tag >> 16 & 1 and 0x10 <= tag & 0xFFFF <= 0xFF else "Unknown")
        head = f"{indent}({hexa[:4]},{hexa[4:]}) {vr} {name}"
        if vr == "SQ":
            yield head
            for i, item in enumerate(value):
                yield f"{indent}  (FFFE,E000) Item"
                yield from _lines(item, depth + 2, (*path, (hexa, i)), charsets, width, names)  # type: ignore[arg-type]
                yield f"{indent}  (FFFE,E00D) Item Delimitation Item"
            yield f"{indent}(FFFE,E0DD) Sequence Delimitation Item"
            continue
        fragments = value if isinstance(value, list) else None
        e = p10.Element(path, tag, vr, b"" if fragments is not None else value, fragments=fragments, charset=charsets.get((path, tag)))  # type: ignore[arg-type]
        size = sum(map(len, fragments)) if fragments is not None else len(value)
        start = f"{head.ljust(len(indent) + 15 + NAME_WIDTH)}[{size:6d} bytes] "
        yield start + clipped(shown(e), max(10, width - len(start)))
