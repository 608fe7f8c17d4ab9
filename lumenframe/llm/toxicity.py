"""Abusive, hateful and sexual language, scored by nearest labelled examples.

Texts are read passage by passage (sentences and lines).  A passage is a TF-IDF vector over folded words and pairs of adjacent
words.  The terms are those of the labelled sample, each known by itself (words by their text, pairs by their two words, never by a
hash alone), and their document frequencies are counted over the passages of all documents; a word or pair outside these terms can match no
example and weighs in the length of a vector like one that the sample would hold once.  Passages of
labelled documents are the examples, each with the share of its documents voted toxic.  For every passage the
nearest examples by exact cosine are found through a block-max inverted index: postings lie in blocks of examples, a block
is read only where the sum of its largest weights can reach the least similarity.  The vote of the nearest
examples, weighted by similarity, is the passage's score; the document has the score of its worst passage, with the nearest
examples of that passage as evidence, and a probability: the share of toxic votes among labelled documents of such a score, when each
is scored without its own vote (isotonic regression).

Voted documents are at most ``max_labelled`` with at most ``max_characters`` of text, documented bounds of the classifier's training sample; everything else
covers all documents.  Examples voted toxic only by company (the harmless passages of a toxic document) are edited out
before the index of abusive examples is built: those whose neighbours and copies were voted harmless count as harmless,
those without such evidence don't vote at all.  Of a toxic document that would be left without an example, the passage
with most wording unknown to documents voted harmless stays.

Defined results: null, empty and wordless texts score 0; without any example voted toxic every score is 0; repeated rows
of a document count once, with the score of its worst row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut

LEAST, CLOSE, NEIGHBOURS, BLOCK = 0.27, 0.40, 15, 64
MAX_LABELLED, MAX_CHARACTERS = 40_000, 32_000_000
EVIDENCE = 3
THRESHOLD = 0.5
PRIOR = 1.5
# Votes of harmless neighbours and copies that make an example harmless; words that tell a passage by wording alone.
AGAINST, TELLING = 0.5, 4

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁԛԝαβεικνορτυχ", "abekmhopctyxijsdqwabeiknoptux")
SIGNS = str.maketrans("$@!013457", "saioieast")
ENDS = ".!?。！？…"
SPACED = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\S)")
RUNS = re.compile(r"(.)\1{2,}")


def fold(token: str) -> str:
    """The word of a token: lower case without accents, separators and disguise; digits alone are 0; authors of comments are nothing."""
    t = unicodedata.normalize("NFKC", token).casefold()
    if t.endswith(":") and t[-2:-1].isdigit():
        return ""
    t = t.strip("\"'“”„«»()[]{}<>.,;:!?…–—-*#|·©")
    if not t:
        return ""
    if t.isascii():
        if t.isalpha():
            return RUNS.sub(r"\1", t)
    else:
        letters = [unicodedata.name(c, "")[:5] for c in t if c.isalpha()]
        if "LATIN" in letters and ("CYRIL" in letters or "GREEK" in letters):
            t = t.translate(LOOKALIKES)
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    if sum(c.isalpha() for c in t) >= 2:
        t = t.translate(SIGNS)
    t = RUNS.sub(r"\1", "".join(c for c in t if c.isalnum()))
    return "0" if t.isdigit() else t


def _unspaced(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯"


class Lookup:
    """Positions of whole numbers in a fixed list, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.shift = keys, 64 - max(4, int(2 * len(keys)).bit_length())
        self.table = np.full(1 << (64 - self.shift), -1, np.int32)
        todo, at = np.arange(len(keys)), self._hash(keys)
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            left = self.table[at] != todo
            todo, at = todo[left], (at[left] + 1) % len(self.table)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is not in the list."""
        out = np.full(len(keys), -1, np.int64)
        todo, at = np.arange(len(keys)), self._hash(keys)
        while len(todo):
            got = self.table[at]
            same = (got >= 0) & (self.keys[np.maximum(got, 0)] == keys[todo]) if len(self.keys) else got >= 0
            out[todo[same]] = got[same]
            left = ~same & (got >= 0)
            todo, at = todo[left], (at[left] + 1) % len(self.table)
        return out


class Terms:
    """The words and pairs of words of the sample, numbered; ``n`` stands for all others."""

    def __init__(self, words: dict[str, int], pairs: np.ndarray) -> None:
        self.words, self.pairs = words, Lookup(pairs)
        self.n = len(words) + len(pairs)

    def features(self, words: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, term, count) of words and pairs of adjacent words, sorted; unknown terms are counted each for itself."""
        same = passage[1:] == passage[:-1]
        pairs = (words[:-1][same] << 32) | words[1:][same]
        at = self.pairs.find(pairs)
        strange = at < 0
        other, number = np.unique(pairs[strange], return_inverse=True)
        n_words = len(self.words)
        fresh = max(0, int(words.max(initial=-1)) + 1 - n_words)
        at += n_words
        at[strange] = self.n + fresh + number
        width = self.n + fresh + len(other)
        single = np.where(words < n_words, words, words + (self.n - n_words))
        keys, counts = np.unique(np.concatenate([passage * width + single, passage[1:][same] * width + at]), return_counts=True)
        return keys // width, np.minimum(keys % width, self.n), counts


class Reader:
    """Turns texts into word numbers and passage numbers; words outside the vocabulary get numbers after it."""

    def __init__(self, words: dict[str, int]) -> None:
        self.words = words
        self.fresh: dict[str, int] = {}
        self.codes: dict[str, tuple[int, ...]] = {}

    def number(self, word: str) -> int:
        found = self.words.get(word)
        return self.fresh.setdefault(word, len(self.words) + len(self.fresh)) if found is None else found

    def look(self, token: str) -> tuple[int, ...]:
        """Codes of a token: its word's number plus one, times two, plus one where a passage ends after it."""
        end = int(token[-1] in ENDS)
        if any(map(_unspaced, token)):
            found = (*(2 * (self.number(c) + 1) if c.isalnum() else 1 if c in ENDS else 0 for c in token), 1)
        else:
            word = fold(token)
            found = (2 * (self.number(word) + 1) + end,) if word else (end,)
        found = tuple(x for x in found if x)
        if len(token) <= 40:
            self.codes[token] = found
        return found

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, passage of each word, text of each passage); the numbers of unknown words hold for one call."""
        if len(self.codes) > 500_000 or len(self.fresh) > 500_000:
            self.codes.clear()
            self.fresh.clear()
        flat: list[int] = []
        owner: list[int] = []
        get, look = self.codes.get, self.look
        for text in texts:
            before = len(flat)
            if text:
                if SPACED.search(text):
                    text = SPACED.sub(lambda m: m[0].replace(" ", ""), text)
                for line in text.split("\n"):
                    for token in line.split():
                        found = get(token)
                        flat.extend(look(token) if found is None else found)
                    flat.append(1)
            owner.append(len(flat) - before)
        codes = np.array(flat, dtype=np.int64)
        ends = codes & 1
        passage = np.cumsum(ends) - ends
        text_of = np.repeat(np.arange(len(owner)), owner)[ends == 1]
        words = codes >> 1
        keep = words > 0
        return words[keep] - 1, passage[keep], text_of


def weigh(passage: np.ndarray, bucket: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of unit length per passage."""
    weight = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(passage, weight * weight, minlength=int(passage.max(initial=-1)) + 1))
    return weight / np.maximum(norm[passage], 1e-12)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all spans one after the other, and the span of each."""
    total = int(lengths.sum())
    of = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[of], of


@dataclass
class Index:
    """Postings by term and block: entries of block e are rows[block_at[e]:block_at[e+1]], its largest weight is block_max[e]; ``slot`` is the place of a term, -1 without postings."""

    slot: np.ndarray
    bucket_at: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    block_at: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    largest: np.ndarray
    n_rows: int

    @classmethod
    def build(cls, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> Index:
        order = np.lexsort((row, bucket))
        row, bucket, weight = row[order], bucket[order], weight[order].astype(np.float32)
        key = bucket * (1 << 24) + row // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        of_bucket = bucket[first]
        start = np.flatnonzero(np.r_[True, of_bucket[1:] != of_bucket[:-1]]) if len(first) else np.zeros(0, int)
        most = np.maximum.reduceat(weight, first) if len(first) else weight
        largest = np.maximum.reduceat(most, start) if len(start) else most
        slot = np.full(int(bucket.max(initial=-1)) + 2, -1, np.int32)
        slot[of_bucket[start]] = np.arange(len(start))
        small = lambda x: x.astype(np.int32)  # noqa: E731 - positions and rows of a bounded sample
        return cls(slot, small(np.r_[start, len(first)]), small(row[first] // BLOCK), most, small(np.r_[first, len(row)]), small(row), weight, largest, int(row.max(initial=-1)) + 1)

    def find(self, query: np.ndarray, bucket: np.ndarray, weight: np.ndarray, least: float = LEAST, step: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, example, cosine) of all examples with at least that cosine; exact."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not self.n_rows or not len(query):
            return none
        at = self.slot[np.minimum(bucket, len(self.slot) - 1)]
        hit = at >= 0
        query, at, weight = query[hit], at[hit], weight[hit]
        if not len(query):
            return none
        bound = np.bincount(query, weight * self.largest[at])
        hit = bound[query] >= least
        query, at, weight = query[hit], at[hit], weight[hit]
        parts = [none]
        lengths = self.bucket_at[at + 1] - self.bucket_at[at]
        # Whole queries at a time, as many as fit a step; sums are kept in dense arrays of queries by examples, or sorted where they are few.
        edges = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True]) if len(query) else np.zeros(1, int)
        work = np.r_[0, np.cumsum(lengths)][edges]
        wide = max(1, step // max(1, self.n_rows))
        i = 0
        while i < len(edges) - 1:
            j = min(max(i + 1, int(np.searchsorted(work, work[i] + step, side="right")) - 1), i + wide)
            part = slice(edges[i], edges[j])
            number = np.repeat(np.arange(j - i), np.diff(edges[i : j + 1]))
            local, example, cosine = self._exact(number, j - i, at[part], weight[part], lengths[part], least)
            parts.append((query[edges[i:j]][local], example, cosine))
            i = j
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _exact(self, query: np.ndarray, n: int, at: np.ndarray, weight: np.ndarray, lengths: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entry, of = _spans(self.bucket_at[at], lengths)
        blocks = self.n_rows // BLOCK + 1
        pair = query[of] * blocks + self.block[entry]
        open_ = np.bincount(pair, weight[of] * self.block_max[entry], minlength=n * blocks) >= least - 1e-9
        keep = open_[pair]
        entry, of = entry[keep], of[keep]
        posting, of2 = _spans(self.block_at[entry], self.block_at[entry + 1] - self.block_at[entry])
        of = of[of2]
        keys, product = query[of] * self.n_rows + self.rows[posting], weight[of] * self.weights[posting]
        if len(keys) * 24 > n * self.n_rows:
            cosine = np.bincount(keys, product, minlength=n * self.n_rows)
            found = np.flatnonzero(cosine >= least)
            return found // self.n_rows, found % self.n_rows, cosine[found]
        found, number = np.unique(keys, return_inverse=True)
        cosine = np.bincount(number, product, minlength=len(found))
        near = cosine >= least
        return found[near] // self.n_rows, found[near] % self.n_rows, cosine[near]


def vote(query: np.ndarray, example: np.ndarray, cosine: np.ndarray, label: np.ndarray, mass: np.ndarray, n: int, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """(score, nearest example) per query: share of toxic votes among the k nearest, weighted by cosine to the fourth and votes."""
    order = np.lexsort((example, -cosine, query))
    query, example, cosine = query[order], example[order], cosine[order]
    first = np.searchsorted(query, query)
    near = np.arange(len(query)) - first < k
    weight = np.where(near, cosine**4 * mass[example], 0.0)
    score = np.bincount(query, weight * label[example], minlength=n) / np.maximum(np.bincount(query, weight, minlength=n), 1e-12)
    nearest = np.full(n, -1)
    nearest[query[::-1]] = example[::-1]
    return score, nearest


def isotonic(score: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities): the rising step function closest to the votes, as points to go between."""
    at, of = np.unique(score, return_inverse=True)
    weight, total = np.bincount(of).astype(float), np.bincount(of, toxic)
    blocks: list[list[float]] = []
    for x, w, t in zip(at, weight, total, strict=True):
        blocks.append([x, x, w, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, high, w, t = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + w, blocks[-1][3] + t]
    return np.array([x for b in blocks for x in b[:2]]), np.array([b[3] / b[2] for b in blocks for _ in range(2)])


@dataclass
class Model:
    terms: Terms
    idf: np.ndarray
    examples: Index
    abusive: Index
    label: np.ndarray
    n: np.ndarray
    document: np.ndarray
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    held: object = None

    def score(self, reader: Reader, texts: list[str | None], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list]:
        """(score, number of passages at or above the threshold, evidence) of each text.

        With ``own`` votes of the texts, which are then among the examples, each is scored without its own vote.
        """
        score, flagged = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        evidence: list[list[dict]] = [[] for _ in texts]
        words, passage, text_of = reader.read(texts)
        if not len(words) or not self.examples.n_rows:
            return score, flagged, evidence
        query, bucket, count = self.terms.features(words, passage)
        weight = weigh(query, bucket, count, self.idf)
        near = np.unique(self.abusive.find(query, bucket, weight)[0])
        hit = np.isin(query, near)
        number, example, cosine = self.examples.find(np.searchsorted(near, query[hit]), bucket[hit], weight[hit])
        label, n = self.label[example], self.n[example]
        if own is not None:
            alone = np.where(cosine > 1 - 1e-6, 1.0, 0.0)
            vote_of = own[text_of[near[number]]]
            label = np.where(alone > 0, np.clip((label * n - vote_of) / np.maximum(n - 1, 1e-9), 0, 1), label)
            n = n - alone
        each, _ = vote(number, np.arange(len(example)), cosine, label, np.sqrt(n), len(near))
        np.maximum.at(score, text_of[near], each)
        np.add.at(flagged, text_of[near], each >= THRESHOLD)
        if own is None and len(near):
            order = np.lexsort((near, -each, text_of[near]))
            worst = order[np.r_[True, text_of[near][order][1:] != text_of[near][order][:-1]]]
            order = np.lexsort((example, -cosine, number))
            first, last = np.searchsorted(number[order], worst), np.searchsorted(number[order], worst, side="right")
            for w, a, b in zip(worst, first, last, strict=True):
                top = order[a : min(b, a + EVIDENCE)]
                evidence[text_of[near[w]]] = [{"doc_id": int(self.document[example[i]]), "cosine": round(float(cosine[i]), 6), "toxic_share": round(float(label[i]), 6)} for i in top]
        return score, flagged, evidence


def _batches(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a batch whose texts have few characters altogether."""
    start, held, size = 0, [], 0
    for text in batch.column(column).to_pylist():
        if held and size + len(text or "") > most:
            yield start, held
            start, held, size = start + len(held), [], 0
        held.append(text)
        size += len(text or "")
    yield start, held


def frequencies(documents: DataFrame, terms: Terms) -> np.ndarray:
    """Number of passages of all documents with each term, counted in the tasks first; the last entry is the number of passages."""
    held = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        total, reader = np.zeros(known.n + 1, np.int64), Reader(known.words)
        for batch in batches:
            for _, texts in _batches(batch, 0):
                words, passage, _ = reader.read(texts)
                if len(words):
                    query, term, _ = known.features(words, passage)
                    total[: known.n] += np.bincount(term, minlength=known.n + 1)[: known.n]
                    total[known.n] += int(np.count_nonzero(np.diff(query))) + 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["term", "n"])

    rows = documents.select("text").where("text is not null").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counted = rows.toPandas()
    held.unpersist()
    total = np.zeros(terms.n + 1, np.int64)
    total[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return total


def voted(documents: DataFrame, labels: DataFrame, max_labelled: int, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``max_labelled`` voted documents, in the order of a hash of their ids, with at most ``max_characters`` together.

    The chosen ids are no more than ``max_labelled`` and go to the documents, which need no shuffle.
    """
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = cut(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")))
    sizes = sample.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    fits = sizes["n"].cumsum() <= max_characters
    if fits.all():
        return sample
    kept = sample.sparkSession.createDataFrame(pd.DataFrame({"doc_id": sizes["doc_id"][fits]}), "doc_id bigint")
    return sample.join(F.broadcast(kept), "doc_id", "left_semi")


def _training(sample: DataFrame) -> pd.DataFrame:
    """Examples of the sample, read in the tasks: distinct passages as words in order, with toxic votes, votes, the documents voted toxic and one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _batches(batch, 0):
                reader = Reader({})
                words, passage, text_of = reader.read(texts)
                spelt = np.array(list(reader.fresh), dtype=object)
                first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(words) else np.zeros(0, int)
                held = [" ".join(x) for x in np.split(spelt[words], first[1:])] if len(words) else []
                text = text_of[passage[first]] if len(words) else first
                both = pd.DataFrame({"words": held, "text": text}).drop_duplicates()
                of = pa.array(both["text"].to_numpy(dtype=int) + start)
                yield pa.RecordBatch.from_arrays([pa.array(both["words"], pa.string()), batch.column(1).take(of), batch.column(2).take(of)], ["words", "toxic", "doc_id"])

    each = sample.select("text", "toxic", "doc_id").mapInArrow(run, "words string, toxic double, doc_id bigint")
    document = F.collect_list(F.when(F.col("toxic") >= THRESHOLD, F.col("doc_id")))
    rows = each.groupBy("words").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"), document.alias("documents"), F.min("doc_id").alias("doc_id"))
    return rows.orderBy("words").toPandas()


def _vocabulary(passages: list[str]) -> tuple[Terms, np.ndarray, np.ndarray]:
    """The terms of passages (words apart by single spaces), and (word numbers, passage of each)."""
    numbers: dict[str, int] = {}
    held = [[numbers.setdefault(w, len(numbers)) for w in p.split(" ")] for p in passages]
    passage = np.repeat(np.arange(len(held)), [len(h) for h in held])
    words = np.fromiter((w for h in held for w in h), np.int64, len(passage))
    same = passage[1:] == passage[:-1]
    return Terms(numbers, np.unique((words[:-1][same] << 32) | words[1:][same])), words, passage


def _explaining(document: np.ndarray, passage: np.ndarray, kept: np.ndarray, together: np.ndarray, strange: np.ndarray, size: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Passages by which documents voted toxic are explained that have none among those kept: the only one, or the one with most strange wording."""
    _, document = np.unique(document, return_inverse=True)
    done = np.zeros(int(document.max(initial=-1)) + 1, bool)
    done[document[kept[passage]]] = True
    only = np.bincount(document)[document] == 1
    told = (together[passage] >= THRESHOLD) & (size[passage] >= TELLING)
    open_ = ~done[document] & ~against[passage] & (told | only)
    document, passage = document[open_], passage[open_]
    order = np.lexsort((passage, -(strange * size)[passage], document))
    document, passage = document[order], passage[order]
    return passage[np.r_[True, document[1:] != document[:-1]]] if len(passage) else passage


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_characters: int = MAX_CHARACTERS) -> Model:
    """Frequencies of all documents, the indexes of the labelled examples, and the curve from scores to probabilities."""
    sample = voted(documents, labels, max_labelled, max_characters)
    found = _training(sample)
    terms, words, passage = _vocabulary(found["words"].tolist())
    toxic, n = found["toxic"].to_numpy(dtype=float), found["n"].to_numpy(dtype=float)
    of = np.repeat(np.arange(len(found)), [len(x) for x in found["documents"]])
    document = np.concatenate([np.zeros(0, np.int64), *found["documents"]]).astype(np.int64)
    if not len(words):
        empty = Index.build(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return Model(terms, np.zeros(1), empty, empty, np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
    counted = frequencies(documents, terms)
    # A term that the sample does not hold is taken to be as frequent as one that it would hold once.
    unknown = counted[-1] / max(1.0, n.sum())
    idf = np.log((1 + counted[-1]) / (1 + np.r_[counted[:-1], unknown])) + 1e-3
    row, bucket, count = terms.features(words, passage)
    weight = weigh(row, bucket, count, idf)
    examples = Index.build(row, bucket, weight)
    label = toxic / n
    # An example voted toxic stays one if its neighbours agree, or if the other documents that hold the same passage do so
    # together with the neighbours against a prior at the rate of toxic votes.
    suspects = np.flatnonzero(label >= THRESHOLD)
    hit = np.isin(row, suspects)
    query, example, cosine = examples.find(np.searchsorted(suspects, row[hit]), bucket[hit], weight[hit], CLOSE)
    other = suspects[query] != example
    score, nearest = vote(query[other], example[other], cosine[other], label, np.sqrt(n), len(suspects))
    weight_near = cosine[other] ** 4 * np.sqrt(n)[example[other]]
    near, near_toxic = (np.bincount(query[other], x, minlength=len(suspects)) for x in (weight_near, weight_near * label[example[other]]))
    copies = n[suspects] - 1
    own = np.sqrt(copies)
    own_toxic = own * np.where(copies > 0, (toxic[suspects] - label[suspects]) / np.maximum(copies, 1), 0)
    rate = toxic.sum() / n.sum()
    voted_toxic, votes = near_toxic + own_toxic, near + own
    kept = np.zeros(len(n), bool)
    kept[suspects] = ((score >= THRESHOLD) & (nearest >= 0)) | ((voted_toxic + PRIOR * rate) / (votes + PRIOR) >= THRESHOLD)
    # What is left is judged with its wording as prior: the part of it that documents voted harmless don't use.
    harmless = np.bincount(bucket, (n - toxic)[row], minlength=terms.n + 1) / np.maximum(np.bincount(bucket, n[row], minlength=terms.n + 1), 1)
    strange = 1 - np.bincount(row, weight * weight * harmless[bucket], minlength=len(n))
    together, against = np.zeros(len(n)), np.ones(len(n), bool)
    together[suspects] = (voted_toxic + PRIOR * strange[suspects]) / (votes + PRIOR)
    against[suspects] = votes - voted_toxic >= voted_toxic + AGAINST
    kept[_explaining(document, of, kept, together, strange, np.bincount(passage), against)] = True
    label[suspects[~kept[suspects] & against[suspects]]] = 0.0
    silent = np.zeros(len(n), bool)
    silent[suspects] = ~kept[suspects] & ~against[suspects]
    hit, heard = kept[row], ~silent[row]
    abusive = Index.build(row[hit], bucket[hit], weight[hit])
    model = Model(terms, idf, Index.build(row[heard], bucket[heard], weight[heard]), abusive, label, n, found["doc_id"].to_numpy(dtype=np.int64))
    model.curve = _calibrated(sample, model)
    return model


def _calibrated(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The curve from scores to probabilities, from the documents of the sample, each scored without its own vote."""
    held = model.held = sample.sparkSession.sparkContext.broadcast(replace(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value.terms.words)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for start, texts in _batches(batch, 0):
                own = toxic[start : start + len(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(held.value.score(reader, texts, own)[0]), pa.array(own)], ["score", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "score double, toxic double").toPandas()
    return isotonic(np.round(rows["score"].to_numpy(), 3), rows["toxic"].to_numpy())


SCORES = "doc_id bigint, toxic_score double, probability double, flagged_passages bigint, evidence array<struct<doc_id:bigint,cosine:double,toxic_share:double>>"


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxic_score, probability, flagged_passages, evidence) of every document; evidence are the labelled documents nearest to the worst passage."""
    held = model.held or documents.sparkSession.sparkContext.broadcast(model)
    curve = model.curve
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value.terms.words)
        for batch in batches:
            for start, texts in _batches(batch, 1):
                score, flagged, evidence = held.value.score(reader, texts)
                likely = np.interp(score, *curve)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(np.round(score, 6)), pa.array(np.round(likely, 6)), pa.array(flagged), pa.array(evidence, kind)], ["doc_id", "toxic_score", "probability", "flagged_passages", "evidence"])

    rows = documents.select("doc_id", "text").mapInArrow(run, SCORES)
    worst = F.max(F.struct("toxic_score", "probability", "flagged_passages", "evidence")).alias("v")
    return rows.groupBy("doc_id").agg(worst).select("doc_id", "v.*")


def source_rates(documents: DataFrame, scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, toxic, rate) per source; a null source is a group of its own."""
    each = documents.groupBy("doc_id").agg(F.min("source").alias("source")).join(scores, "doc_id")
    flagged = F.count_if(F.col("toxic_score") >= threshold)
    return each.groupBy("source").agg(F.count("*").alias("documents"), flagged.alias("toxic"), F.round(flagged / F.count("*"), 6).alias("rate"))
