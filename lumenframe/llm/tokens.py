"""Encoding of whole texts with a public byte-level BPE tokenizer, and decoding.

Texts are cut into overlapping chunks, and every chunk is pre-tokenised by itself, those of one text in different tasks.  A chunk
reports the first pre-token boundary at or after its own start and at or after its own end; where the end of one chunk and
the start of the next agree, the two scans have resynchronised and the pieces between the cuts are those of the whole text.  Only
then the pieces are encoded; the ids of short pieces are kept in a table per worker.  Every text takes this way; one that is no longer than
a chunk is a single chunk, which has no neighbour to be stitched to and need not leave its task.  Texts whose chunks
do not agree (a run longer than the overlap) are encoded as one chunk.  Decoding concatenates the bytes of the ids.

Defined results: null and empty texts have the empty list of ids, which decodes to the empty text; null lists decode to null; every row comes
out, repeated ones too.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut_counted

FOLDER = os.environ.get("LUMENFRAME_TOKENIZERS", "/opt/tokenizers")
CHUNK, OVERLAP = 4_096, 512
PIECES_KEPT, PIECE_LENGTH = 400_000, 64
# Keys of texts to be encoded as one chunk are sent to all tasks up to this number, beyond it they are joined by shuffle.
BROADCAST_KEYS = 100_000

# Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The pattern looks at most at an apostrophe and two letters beyond the end of a piece.
LOOKAHEAD = 3


@cache
def encoding(folder: str = FOLDER, name: str = "byte_bpe_50k"):  # noqa: ANN201 - tiktoken type
    """The tokenizer of a worker process, from the published ranks."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces(dict):
    """Pre-token to its little-endian ids; emptied when it has grown too large."""

    def __init__(self, folder: str, name: str) -> None:
        import regex

        self.encoding, self.split = encoding(folder, name), regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.encoding.encode_ordinary(piece), dtype="<i4").tobytes()
        if len(piece) <= PIECE_LENGTH:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = found
        return found

    def chunk(self, text: str, start: int, end: int, last: bool) -> tuple[int | None, int | None, bytes]:
        """The boundaries of ``cuts`` and the ids of the pieces between them; no ids if one is missing."""
        pieces = self.split(text)
        if start == 0 and last:
            return 0, len(text), b"".join(map(self.__getitem__, pieces))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        a, b = cuts(text, ends, start, end, last)
        if a is None or b is None:
            return None, None, b""
        i, j = np.searchsorted(ends, [a, b], side="right")
        return a, b, b"".join(map(self.__getitem__, pieces[0 if a == 0 else i : j]))


@cache
def pieces(folder: str = FOLDER, name: str = "byte_bpe_50k") -> Pieces:
    return Pieces(folder, name)


def cuts(text: str, ends: np.ndarray, start: int, end: int, last: bool) -> tuple[int | None, int | None]:
    """First boundaries at or after ``start`` and at or after ``end`` among the ends of the pieces of ``text``.

    Only boundaries after other characters than white space count: a run of white space is split by what follows it.
    Near the end of a chunk a piece is sure only where the text really ends; None where no sure boundary follows.
    """
    sure = len(text) if last else len(text) - LOOKAHEAD

    def first(at: int) -> int | None:
        for e in ends[np.searchsorted(ends, at) :]:
            if e > sure:
                return None
            if e == len(text) or not text[e - 1].isspace():
                return int(e)
        return None

    return (0 if start == 0 else first(start)), first(end)


def _lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def _out(parts: list[bytes], count: bool) -> pa.Array:
    return pa.array([len(p) // 4 for p in parts], pa.int32()) if count else _lists(parts)


def _sliced(column: pa.Array, rows: int = 512) -> Iterator[tuple[int, list]]:
    for i in range(0, len(column), rows):
        yield i, column.slice(i, rows).to_pylist()


def encode_documents(documents: DataFrame, count: bool = False, folder: str = FOLDER, name: str = "byte_bpe_50k", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row of ``documents`` (doc_id, text); with ``count`` (doc_id, n_tokens)."""
    result, kind = ("n_tokens", "int") if count else ("ids", "array<int>")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(folder, name)
        for batch in batches:
            for i, texts in _sliced(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), _out([known.chunk(t, 0, len(t), True)[2] if t else b"" for t in texts], count)], ["doc_id", result])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                for first in range(0, -(-len(text) // chunk), 256):
                    at = [chunk * i for i in range(first, min(first + 256, -(-len(text) // chunk)))]
                    begin = [max(0, x - overlap) for x in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * len(at), pa.int64()), pa.array([key] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(begin, pa.int64()),
                            pa.array([x + chunk + overlap >= len(text) for x in at], pa.bool_()), pa.array([text[b : x + chunk + overlap] for b, x in zip(begin, at, strict=True)], pa.string()),
                        ],
                        ["doc_id", "text_key", "at", "begin", "last", "part"],
                    )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(folder, name)
        for batch in batches:
            found: list[list] = [[], [], []]
            for at, begin, last, text in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                a, b, ids = known.chunk(text, at - begin, min(at + chunk - begin, len(text)), last)
                for column, x in zip(found, (None if a is None else a + begin, None if b is None else b + begin, ids), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), _out(found[2], count)], ["doc_id", "text_key", "at", "from_cut", "to_cut", result])

    base, length = documents.select("doc_id", "text"), F.length("text")
    ddl = f"doc_id bigint, {result} {kind}"
    whole = base.where(F.coalesce(length, F.lit(0)) <= chunk).mapInArrow(single, ddl)
    # Rows are known by id and text, which any second run of a task finds again; equal rows are given out as often as they are.
    same = ["doc_id", "text_key"]
    long = base.where(length > chunk).select("doc_id", F.xxhash64("text", length).alias("text_key"), "text")
    parts = long.mapInArrow(spread, "doc_id bigint, text_key bigint, at bigint, begin bigint, last boolean, part string")
    scanned = parts.repartition(*same, "at").mapInArrow(chunks, f"doc_id bigint, text_key bigint, at bigint, from_cut bigint, to_cut bigint, {result} {kind}")
    each = scanned.repartition(*same).groupBy(*same, "at").agg(F.min("from_cut").alias("from_cut"), F.min("to_cut").alias("to_cut"), F.first(result).alias(result), F.count("*").alias("times"))
    joined = each.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("at", "from_cut", "to_cut", result))).alias("p"), F.min("times").cast("int").alias("times"))
    agree = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.coalesce(F.get("p", i)["from_cut"] == F.get("p", i - 1)["to_cut"], F.lit(False)))
    fine = F.forall("p", lambda p: p["from_cut"].isNotNull()) & F.when(F.size("p") > 1, agree).otherwise(True)
    total = F.aggregate("p", F.lit(0), lambda s, p: s + p[result]) if count else F.flatten(F.transform("p", lambda p: p[result]))
    judged, n_apart = cut_counted(joined.select(*same, F.when(fine, total).alias(result), "times"), f"{result} is null")
    stitched = judged.where(F.col(result).isNotNull()).select("doc_id", result, F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_i")).drop("_i")
    out = whole.union(stitched)
    if not n_apart:
        return out
    apart = judged.where(F.col(result).isNull()).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    apart = F.broadcast(apart) if n_apart <= BROADCAST_KEYS else apart.hint("merge")
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    return out.union(long.join(apart, on, "left_semi").select("doc_id", "text").mapInArrow(single, ddl))


@cache
def _bytes_of(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens one after the other, where each begins) by id."""
    tokens = encoding(folder, name)
    held = [tokens.decode_single_token_bytes(i) for i in range(tokens.n_vocab)]
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0] + [len(b) for b in held])


def decode_documents(encoded: DataFrame, folder: str = FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids): the raw bytes of the ids, one after the other, read as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, begin = _bytes_of(folder, name)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = begin[ids + 1] - begin[ids]
            ends = np.r_[0, np.cumsum(sizes)]
            raw = flat[np.repeat(begin[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
            counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            cut_at = ends[np.r_[0, np.cumsum(counts)]]
            texts = [raw[a:b].decode("utf-8", "replace") if known else None for a, b, known in zip(cut_at, cut_at[1:], lists.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
