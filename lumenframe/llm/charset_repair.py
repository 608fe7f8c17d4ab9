"""Texts garbled by a wrong character encoding: found, and restored where possible.

Adjacent character pairs are counted over all texts, and their pointwise mutual information tells which pairs a sound text
would hardly hold.  Maximum-scoring segments of improbable pairs isolate the runs to look at, and only inside those
runs inverse mappings are tested: the run is encoded as it was wrongly decoded and decoded as it should have been.
A mapping counts when the restored run is far more probable than the garbled one.  Replacement characters and escape sequences
inside words cannot be sound either; the former are not restorable.

Characters fall into a fixed number of classes (letters of the alphabets each for itself, ideographs hashed), so that the
table of pairs has a proven bound.

Defined results: null, empty and ASCII texts without escape sequences are sound; so is a text that only quotes garbled
characters, that is, holds them apart from any word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 2048
PRIOR = 5.0
IMPROBABLE = 2.5
# Least gains in log probability: for sequences that are well-formed UTF-8 by more than chance, and for other mappings.
GAIN, FIRM_GAIN, CAPITALS = 0.5, 5.5, 3.0
SHORT = 4  # characters of a run that is restored by itself
# Evidence beside the pairs, which garbled texts in the corpus weaken: scripts mixed in a word, signs inside one, runs of signs that become ideographs.
MIXED, SIGN_INSIDE, IDEOGRAPH = 4.0, 3.0, 1.5

# Blocks of characters that are classes each for themselves, and hashed ones with their number of classes.
SINGLE = [(0x0000, 0x0250), (0x0370, 0x0530), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2500, 0x25A0), (0x3040, 0x3100), (0xFF61, 0xFFA0)]
HASHED = [((0x2150, 0x2500), 32), ((0x3400, 0xA000), 192), ((0xAC00, 0xD7B0), 96), ((0x0000, 0x110000), 48)]

# Encodings that texts really have, each with the decoders that are applied to it wrongly.
LATIN = ["latin-1", "cp1252"]
CYRILLIC = ["iso8859-5", "cp1251", "koi8-r", "cp866"]
CONFUSED = {
    "utf-8": [*LATIN, "cp437", "cp850", "mac-roman", "iso8859-2", "cp1250", *CYRILLIC, "iso8859-7", "iso8859-15", "shift_jis", "gb18030", "euc_kr"],
    "cp1252": ["latin-1", *CYRILLIC, "iso8859-7", "cp437", "cp850", "mac-roman", "iso8859-2"],
    "iso8859-2": [*LATIN, "cp437", "iso8859-5"],
    "cp1250": [*LATIN, "cp437", "iso8859-5"],
    "iso8859-5": [*LATIN, "cp1251", "koi8-r", "cp866"],
    "cp1251": [*LATIN, "iso8859-5", "koi8-r", "cp866"],
    "koi8-r": [*LATIN, "iso8859-5", "cp1251", "cp866"],
    "cp866": [*LATIN, "iso8859-5", "cp1251", "koi8-r"],
    "iso8859-7": LATIN,
    "shift_jis": [*LATIN, "mac-roman"],
    "euc_jp": [*LATIN, "shift_jis"],
    "gb18030": LATIN,
    "euc_kr": LATIN,
}

# Cyrillic letters that look like Latin ones.
LOOKALIKES = str.maketrans("авекмнорстухіјѕАВЕКМНОРСТУХІЈЅ", "abekmhopctyxijsABEKMHOPCTYXIJS")

WORDS = re.compile("[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
ESCAPED = re.compile(r"\x1b\$?[()@AB]?[@ABJI].")
LOST = re.compile("[^\\W\\d_]�|�[^\\W\\d_]|��")
QUOTED = re.compile(r"""^[(\[]?(?:“[^“”]*[”“]|„[^„“”]*[“”]|«[^«»]*»|‹[^‹›]*›|"[^"]*"|'[^']*'|‘[^‘’]*’|`[^`]*`)[.,;:!?)\]]*$""")
SCRIPTS_TOUCH = re.compile("[A-Za-z\u00c0-\u024f][\u0370-\u052f]|[\u0370-\u052f][A-Za-z\u00c0-\u024f]")
SIGN_IN_WORD = re.compile("[A-Za-z][^\\w\\s.,;:!?'’^()/@&+-][A-Za-z]")
CONTROLS = re.compile("[\x80-\x84\x86-\x9f]")
LATIN_WORD = re.compile(r"[A-Za-z]{2,}")
LEVELS = 3


@cache
def class_of() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, dtype=np.uint16)
    at = sum(b - a for a, b in SINGLE)
    for (a, b), n in reversed(HASHED):
        table[a:b] = CLASSES - n + (np.arange(a, b, dtype=np.uint64) * 2654435761 % 2**32 * n >> 32)
    end = CLASSES
    for (a, b), n in reversed(HASHED):
        table[a:b] = end - n + (np.arange(a, b, dtype=np.uint64) * 2654435761 % 2**32 * n >> 32)
        end -= n
    assert at <= end
    at = 0
    for a, b in SINGLE:
        table[a:b] = np.arange(at, at + b - a)
        at += b - a
    return table


class Classes(dict):
    """Class of a character."""

    def __missing__(self, c: str) -> int:
        self[c] = found = int(class_of()[ord(c)])
        return found


CLASS = Classes()


def classes(text: str) -> np.ndarray:
    return class_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def pair_counts(texts: DataFrame) -> np.ndarray:
    """How often each class follows each, over all ``texts`` (text); counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        held: list[str] = []
        size = 0

        def count() -> None:
            nonlocal size
            c = classes("\n".join(held)).astype(np.int32)
            total[:] += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
            held.clear()
            size = 0

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.append(text)
                    size += len(text)
                    if size > 2_000_000:
                        count()
        if held:
            count()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["pair", "n"])

    rows = texts.select("text").where("text is not null").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(CLASSES * CLASSES, np.int64)
    total[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return total.reshape(CLASSES, CLASSES)


def segments(weights: list[float]) -> list[tuple[int, int]]:
    """All maximum-scoring segments (first, last + 1) of a sequence, in linear time."""
    found: list[list] = []
    total = 0.0
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(f[0], f[1]) for f in found]


def _bytes(text: str, codec: str) -> bytes | None:
    """The bytes a wrong decoder read; controls that it has no character for stand for themselves."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if codec not in ("cp1252", "cp1250", "cp1251"):
            return None
    try:
        return b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode(codec) for c in text)
    except UnicodeEncodeError:
        return None


def _again(text: str) -> str | None:
    """What is decoded once more from UTF-8, if the text was read wrongly twice."""
    for codec in LATIN:
        raw = _bytes(text, codec)
        if raw is not None and not raw.isascii():
            try:
                return raw.decode()
            except UnicodeDecodeError:
                continue
    return None


def mixes(word: str) -> bool:
    """Whether Latin letters and those of Greek or Cyrillic touch in a word."""
    return bool(SCRIPTS_TOUCH.search(word))


@dataclass
class Model:
    """Log probabilities of pairs and what has been decided about words so far."""

    pairs: dict[int, float]
    unseen: np.ndarray
    single: np.ndarray
    known: dict[str, tuple[str, str] | None] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: np.ndarray) -> Model:
        first, second = counts.sum(1), counts.sum(0)
        single = (second + 0.5) / (second.sum() + 0.5 * CLASSES)
        a, b = np.nonzero(counts)
        log = np.log((counts[a, b] + PRIOR * single[b]) / (first[a] + PRIOR))
        return cls(dict(zip((a * CLASSES + b).tolist(), log.tolist(), strict=True)), np.log(PRIOR / (first + PRIOR)), np.log(single))

    def logs(self, text: str) -> list[float]:
        """Log probability of each character after the one before."""
        c = [CLASS[x] for x in text]
        get, unseen, single = self.pairs.get, self.unseen, self.single
        return [x if (x := get(a * CLASSES + b)) is not None else unseen[a] + single[b] for a, b in zip(c, c[1:], strict=False)]

    def likelihood(self, word: str) -> float:
        """Log probability of a word between spaces; capitals alone count as the small letters they stand for, at a price."""
        found = sum(self.logs(f" {word} "))
        return max(found, sum(self.logs(f" {word.lower()} ")) - CAPITALS) if word.isupper() else found

    def runs(self, word: str) -> list[tuple[int, int]]:
        """Runs of improbable pairs as spans of the word, found by mutual information."""
        weights = [IMPROBABLE - (log - self.single[CLASS[c]]) for log, c in zip(self.logs(f" {word} "), f"{word} ", strict=False)]
        return [(max(0, a - 1), min(len(word), b)) for a, b in segments(weights)]

    def inverse(self, part: str, only: str | None = None) -> Iterator[tuple[str, str, str]]:
        """(restored part, wrong decoder, true encoding) of all mappings that are possible, or of those of one true encoding."""
        seen = {part}
        raws: dict[str, bytes | None] = {}
        for right, decoders in CONFUSED.items() if only is None else [(only, CONFUSED[only])]:
            for wrong in decoders:
                if wrong not in raws:
                    raws[wrong] = _bytes(part, wrong)
                raw = raws[wrong]
                if raw is None or raw.isascii():
                    continue
                try:
                    new = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if right == "utf-8" and wrong in LATIN and (twice := _again(new)):
                    yield twice, wrong, right
                if new not in seen and not any("\x80" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff" for c in new):
                    seen.add(new)
                    yield new, wrong, right

    def restore(self, word: str) -> tuple[str, str] | None:
        """(restored word, mapping) if a run of it is garbled, else None."""
        if word in self.known:
            return self.known[word]
        best, gain, partial = None, 0.0, False
        runs = self.runs(word)
        if runs:
            low, high = min(a for a, _ in runs), max(b for _, b in runs)
            before = self.likelihood(word)
            letters = sum(c.isalpha() for c in word)
            control = any("\x80" <= c <= "\x9f" for c in word)
            mixed = MIXED * mixes(word)
            if mixed:
                # Letters of another script that look like Latin ones are a disguise, not a wrong encoding.
                before = max(before, self.likelihood(word.translate(LOOKALIKES)))
            inside = SIGN_INSIDE * bool(SIGN_IN_WORD.search(word))
            # The word and all runs together; then runs by themselves and with their neighbours, for mappings that these don't allow.
            together = {(low, high), (0, len(word))}
            alone = {*runs, *((a, b) for (a, _), (_, b) in zip(runs, runs[1:], strict=False))} if len(runs) > 1 else set()
            alone |= {(a, b - 1) for a, b in alone} | {(a + 1, b) for a, b in alone}  # its first or last pair may reach a sound neighbour
            alone -= together
            tried: set[tuple[str, str]] = set()
            for a, b in [*together, *sorted(alone)]:
                part = word[a:b]
                by_itself = (a, b) in alone
                if part.isascii() or by_itself and len(part) < SHORT:
                    continue  # a few characters can be read in many ways
                for new, wrong, right in self.inverse(part, "utf-8" if by_itself else None):
                    if not by_itself:
                        tried.add((wrong, right))
                    elif (wrong, right) in tried:
                        continue
                    whole = word[:a] + new + word[b:]
                    if right != "utf-8" and not control and letters < 2:
                        continue  # signs apart from any word say nothing
                    more = self.likelihood(whole) - before
                    more += mixed * (not mixes(whole)) + inside * (not SIGN_IN_WORD.search(whole)) + IDEOGRAPH * sum(c > "\u3000" for c in new) * (wrong in LATIN)
                    least = GAIN if right == "utf-8" or control else FIRM_GAIN
                    if word.isupper() and right in CYRILLIC and wrong in CYRILLIC:
                        least *= 2  # words in capitals look like another Cyrillic encoding
                    if sum(c.isalpha() for c in whole) < letters and right == "cp1252":
                        least = max(least, 2 * FIRM_GAIN)  # letters seldom stand for signs
                    if more > gain and more >= least:
                        best, gain, partial = (whole, f"{wrong} for {right}"), more, (a, b) in alone
            if best and partial and best[0] != word and (rest := self.restore(best[0])):
                best = rest[0], best[1]  # another garbled run
        if len(word) <= 80:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = best
        return best

    def judge(self, text: str | None) -> tuple[str, str] | None:
        """(restored text or the text as it is, kind) of a garbled text, None of a sound one."""
        if not text:
            return None
        if "\x1b" in text and ESCAPED.search(text):
            try:
                return text.encode("ascii").decode("iso2022_jp_2"), "escapes"
            except (UnicodeDecodeError, UnicodeEncodeError):
                return text, "escapes"
        if text.isascii():
            return None
        restored, kind = text, None
        for _ in range(LEVELS):
            lines = restored.split("\n")
            found = [self._garbled(line) for line in lines]
            kinds = Counter(k for words in found for _, k in words.values())
            if not kinds:
                break
            main = max(kinds, key=lambda k: (kinds[k], k))
            kind = kind or main
            restored = "\n".join(WORDS.sub(lambda m, w=words: self._put(m[0], w, main), line) if words else line for line, words in zip(lines, found, strict=True))
        if kind:
            return restored, kind
        if CONTROLS.search(text):
            return text, "controls"
        return (text, "lost") if "�" in text and lost(text) else None

    def _garbled(self, line: str) -> dict[str, tuple[str, str]]:
        """The garbled words of a line, without those that are only quoted."""
        if line.isascii():
            return {}
        found = {w: new for w in WORDS.findall(line) if (new := self.restore(w)) is not None and not QUOTED.match(w)}
        foreign = [w for w, new in found.items() if not LATIN_WORD.search(new[0]) and any(c > "\u036f" and c.isalpha() for c in new[0])]
        if len(foreign) == len(found) == 1 and len(LATIN_WORD.findall(line)) >= 4:
            return {}  # one word of another script, named in a sentence
        return found

    def _put(self, word: str, found: dict[str, tuple[str, str]], main: str) -> str:
        """A garbled word restored; beside such words others by the main mapping of the text, if they become no less likely."""
        if word in found:
            return found[word][0]
        wrong, right = main.split(" for ")
        raw = _bytes(word, wrong)
        try:
            new = raw.decode(right) if raw is not None else word
        except UnicodeDecodeError:
            return word
        return new if self.likelihood(new) >= self.likelihood(word) - 1 else word


def lost(text: str) -> bool:
    """Whether replacement characters stand for lost ones: inside words, or as signs, but not one that a sentence is about."""
    if LOST.search(text):
        return True
    lines = [line for line in text.split("\n") if "�" in line]
    single = len(lines) == 1 and lines[0].count("�") == 1
    return not (single and len(lines[0].split()) >= 5 and lines[0].rstrip()[-1:] in ".!?")


def judged(texts: DataFrame, model: Model) -> DataFrame:
    """(origin, record_id, kind, restored) of the garbled ones among ``texts`` (origin, record_id, text)."""
    held = texts.sparkSession.sparkContext.broadcast((model.pairs, model.unseen, model.single))
    out = pa.schema([("origin", pa.string()), ("record_id", pa.int64()), ("kind", pa.string()), ("restored", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for origin, record, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                found = own.judge(text)
                if found is not None:
                    for row, x in zip(rows, (origin, record, found[1], found[0].encode("utf-8", "replace").decode()), strict=True):
                        row.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, out.types, strict=True)], schema=out)

    suspects = texts.where(F.col("text").rlike(r"[^\x00-\x7f]|\x1b")).select("origin", "record_id", "text")
    return suspects.mapInArrow(run, "origin string, record_id bigint, kind string, restored string")


def repair(texts: DataFrame) -> DataFrame:
    """One row per garbled text of ``texts`` (origin, record_id, text); repeated rows of a record count once."""
    model = Model.of(pair_counts(texts))
    found = judged(texts, model).where("record_id is not null")
    return found.groupBy("origin", "record_id").agg(F.min(F.struct("kind", "restored")).alias("v")).select("origin", "record_id", "v.*")
