"""Deeply nested DICOM JSON, shredded to columns and rebuilt as related flat tables.

Each record is cut into columns, one per leaf path, of (repetition level, definition level, value) triples.  A sequence
of nesting depth k has a presence column: definition level 2k where an item exists, 2k-1 where the place is taken by
something that is no item, less where the element, its items or an ancestor are missing.  The tables of items are rebuilt
from the level sequences alone: the repetition level says which ancestor's counter moves on.

Defined results: null, blank and unreadable texts and texts that hold no JSON object give no rows and come out of ``unreadable``
with the reason; a text wrapped as a JSON string, however often, is unwrapped; records may be nested to any depth; tags are
compared in upper case; of a repeated key the last counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Level = tuple[int, int, object]
LEVELS = pa.schema([("origin", pa.string()), ("parent_id", pa.int64()), ("leaf_path", pa.string()), ("levels", pa.list_(pa.struct([("r", pa.int32()), ("d", pa.int32()), ("value", pa.string())])))])


SPACE = re.compile(r"[ \t\r\n]*")
SCALAR = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|NaN|-?Infinity")


def deep_loads(text: str) -> object:
    """JSON of any depth: the containers that are open lie on a list, not on the call stack."""
    skip = lambda i: SPACE.match(text, i).end()
    open_: list[tuple[object, str | None]] = []
    at, result = skip(0), None

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(f"key expected at {i}")
        name, i = scanstring(text, i + 1)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"colon expected at {i}")
        return name, skip(i + 1)

    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            else:
                name = None
                if c == "{":
                    name, at = key(at)
                open_.append((value, name))
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1)
        else:
            m = SCALAR.match(text, at)
            if not m:
                raise ValueError(f"value expected at {at}")
            value, at = json.loads(m[0]), m.end()
        # The value is whole; so may be the containers that it ends.
        while True:
            at = skip(at)
            if not open_:
                result = value
                if at != len(text):
                    raise ValueError(f"more text at {at}")
                return result
            holder, name = open_.pop()
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            c = text[at : at + 1]
            if c == ",":
                at, name = skip(at + 1), None
                if isinstance(holder, dict):
                    name, at = key(at)
                open_.append((holder, name))
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"comma or end expected at {at}")
            value, at = holder, at + 1


def deep_dumps(value: object) -> str:
    """JSON text of a value of any depth."""
    out: list[str] = []
    todo: list[object] = [value]
    while todo:
        one = todo.pop()
        if isinstance(one, _Text):
            out.append(one)
        elif isinstance(one, dict):
            inner: list[object] = []
            for i, (k, v) in enumerate(one.items()):
                inner += [_Text((", " if i else "") + json.dumps(k, ensure_ascii=False) + ": "), v]
            todo += [_Text("}"), *reversed(inner), _Text("{")]
        elif isinstance(one, list):
            inner = []
            for i, v in enumerate(one):
                inner += [_Text(", "), v] if i else [v]
            todo += [_Text("]"), *reversed(inner), _Text("[")]
        else:
            out.append(json.dumps(one, ensure_ascii=False))
    return "".join(out)


class _Text(str):
    __slots__ = ()


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return deep_loads(text)


def _dumps(value: object) -> str:
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return deep_dumps(value)


def read(text: str | None) -> tuple[dict | None, str | None]:
    """(JSON object of a text, unwrapped; None), or (None, why there is none)."""
    value: object = text
    while isinstance(value, str):
        if not value.strip():
            return None, "blank"
        try:
            value = _loads(value)
        except ValueError as e:
            return None, f"not JSON: {e}"
    if isinstance(value, dict):
        return value, None
    return None, "null" if value is None else "no object"


def data_set(text: str | None) -> dict | None:
    """The JSON object of a text, unwrapped; None if there is none."""
    return read(text)[0]


def _sequence(element: object) -> list | None:
    """The item list of an SQ element, empty without Value; None for anything else."""
    if isinstance(element, dict) and element.get("vr") == "SQ":
        value = element.get("Value")
        return value if isinstance(value, list) else []
    return None


def _walk(first: Iterator) -> None:
    """Run nested generators, each of which yields those it would call; the calls lie on a list."""
    calls = [first]
    while calls:
        call = next(calls[-1], None)
        if call is None:
            calls.pop()
        else:
            calls.append(call)


def _layout(item: dict, node: dict, with_values: bool) -> Iterator:
    """Collect the sequences (dict) and leaves (None) that occur anywhere in the record."""
    for tag, element in item.items():
        items = _sequence(element)
        if items is not None:
            below = node.setdefault(tag.upper(), {})
            if below is None:
                below = node[tag.upper()] = {}
            for one in items:
                if isinstance(one, dict):
                    yield _layout(one, below, with_values)
        elif with_values:
            node.setdefault(tag.upper(), None)


def shred(record: dict, with_values: bool = False) -> dict[str, list[Level]]:
    """Columns of a record: leaf path (tags joined with /) to its level sequence; sequences have a presence column."""
    layout: dict = {}
    _walk(_layout(record, layout, with_values))
    columns: dict[str, list[Level]] = {}

    def missing(node: dict, prefix: str, r: int, d: int) -> Iterator:
        for tag, below in node.items():
            path = prefix + tag
            columns.setdefault(path, []).append((r, d, None))
            if below:
                yield missing(below, path + "/", r, d)

    def emit(item: dict, node: dict, prefix: str, depth: int, r: int) -> Iterator:
        here = {tag.upper(): element for tag, element in item.items()}
        for tag, below in node.items():
            path = prefix + tag
            element = here.get(tag)
            if below is None:
                value = None
                if isinstance(element, dict):
                    held = element.get("Value", element.get("InlineBinary"))
                    value = None if held is None else _dumps(held)
                columns.setdefault(path, []).append((r, 2 * depth + (tag in here), value))
                continue
            items = _sequence(element)
            if not items:
                yield missing({tag: below}, prefix, r, 2 * depth)
                continue
            column = columns.setdefault(path, [])
            for i, one in enumerate(items):
                again = r if i == 0 else depth + 1
                if isinstance(one, dict):
                    column.append((again, 2 * depth + 2, None))
                    yield emit(one, below, path + "/", depth + 1, again)
                else:
                    column.append((again, 2 * depth + 1, None))
                    yield missing(below, path + "/", again, 2 * depth + 1)

    _walk(emit(record, layout, "", 0, 0))
    return columns


def places(levels: list[Level], depth: int) -> Iterator[tuple[tuple[int, ...], int, object]]:
    """(positions of the repeated ancestors, definition level, value) of each entry of a level sequence."""
    at = [0] * depth
    for r, d, value in levels:
        if r:
            at[r - 1] += 1
        for k in range(r, depth):
            at[k] = 0
        yield tuple(at), d, value


def item_path(tags: list[str], at: tuple[int, ...]) -> str:
    return "/".join(f"{tag}/[{i}]" for tag, i in zip(tags, at, strict=True))


def items(columns: dict[str, list[Level]], sequences: set[str]) -> Iterator[str]:
    """Paths of all items, from the presence columns."""
    for path in sequences:
        tags = path.split("/")
        depth = len(tags)
        for at, d, _ in places(columns[path], depth):
            if d == 2 * depth:
                yield item_path(tags, at)


def shredded(records: DataFrame, with_values: bool = True) -> DataFrame:
    """(origin, parent_id, leaf_path, levels) of ``records`` (origin, parent_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for origin, parent, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                record = data_set(text)
                if record is not None:
                    for path, levels in shred(record, with_values).items():
                        for row, x in zip(rows, (origin, parent, path, [{"r": r, "d": d, "value": v} for r, d, v in levels]), strict=True):
                            row.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, LEVELS.types, strict=True)], schema=LEVELS)

    return records.select("origin", "parent_id", "text").where("text is not null").mapInArrow(run, "origin string, parent_id bigint, leaf_path string, levels array<struct<r:int,d:int,value:string>>")


def nested_items(records: DataFrame) -> DataFrame:
    """(origin, parent_id, item_path, parent_path) of each item of each record; shredded and rebuilt within the task."""
    schema = pa.schema([("origin", pa.string()), ("parent_id", pa.int64()), ("item_path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for origin, parent, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                record = data_set(text)
                if record is not None:
                    columns = shred(record)
                    found = list(items(columns, set(columns)))
                    rows[0].extend([origin] * len(found))
                    rows[1].extend([parent] * len(found))
                    rows[2].extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, schema.types, strict=True)], schema=schema)

    rows = records.select("origin", "parent_id", "text").where(r"parent_id is not null and (contains(text, 'SQ') or contains(text, '\\u'))").mapInArrow(run, "origin string, parent_id bigint, item_path string")
    return rows.distinct().withColumn("parent_path", F.nullif(F.regexp_replace("item_path", r"/?[^/]+/\[[0-9]+\]$", ""), F.lit("")))


def field_table(records: DataFrame, sequence: str, fields: dict[str, str]) -> DataFrame:
    """One row per item of ``sequence`` (tags joined with /) with its key, its parent's key and the named leaf fields.

    ``fields`` maps a column name to the path of a leaf below the sequence that is not repeated itself; absent
    fields are null.  The values are JSON texts of the Value arrays.
    """
    tags = sequence.split("/")
    depth = len(tags)
    names = list(fields)
    schema = pa.schema([("origin", pa.string()), ("parent_id", pa.int64()), ("item_path", pa.string()), ("parent_path", pa.string()), *[(n, pa.string()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for origin, parent, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                record = data_set(text)
                columns = shred(record, True) if record is not None else {}
                if sequence not in columns:
                    continue
                values = {n: {at: v for at, d, v in places(columns.get(f"{sequence}/{p}", []), depth) if d == 2 * depth + 1} for n, p in fields.items()}
                for at, d, _ in places(columns[sequence], depth):
                    if d == 2 * depth:
                        row = (origin, parent, item_path(tags, at), item_path(tags[:-1], at[:-1]) or None, *[values[n].get(at) for n in names])
                        for column, x in zip(rows, row, strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, schema.types, strict=True)], schema=schema)

    columns = "origin string, parent_id bigint, item_path string, parent_path string" + "".join(f", {n} string" for n in names)
    return records.select("origin", "parent_id", "text").where(F.col("parent_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, columns).distinct()


def unreadable(records: DataFrame) -> DataFrame:
    """(origin, parent_id, reason) of the records whose text gives no rows."""
    schema = pa.schema([("origin", pa.string()), ("parent_id", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            why = pa.array([read(text)[1] for text in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), why], schema=schema).filter(why.is_valid())

    return records.select("origin", "parent_id", "text").mapInArrow(run, "origin string, parent_id bigint, reason string").distinct()
