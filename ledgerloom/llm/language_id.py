"""Language identification: words by per-language log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import functools
import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, slices, table

#: Labelled documents that the model is fitted on, about: a hash of the id picks them where there are more.
TRAIN_DOCS = 8_000
#: Labelled documents that each language keeps at least, about, or all that it has: the others share the rest by their size.
LEAST_DOCS = 40
MAX_GRAM = 5
#: Length of the n-grams whose known share tells whether a text is in its predicted language at all.
TELLING = 3
#: Unseen events weigh like this many.
ALPHA = 0.5
#: Letters of a word that count; a longer run of letters is cut into words of this length.
LONGEST = 64
#: Text bytes that are scored together, for up to so many languages; fewer for more, so that scores of all tokens take bounded room.
BATCH_BYTES, BATCH_LANGS = 2 << 20, 16

UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_U64 = np.uint64


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and the marks on them; numbers, written as letters or not, are none."""
    return [run[i : i + LONGEST] for run in _WORD.findall(text.lower()) for i in range(0, len(run), LONGEST)]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between boundary marks; single letters without them."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


# events by 64-bit hash


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_WEIGHT = _mix(np.arange(1, LONGEST + 3, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)


def hash_of(event: str) -> int:
    """What stands for a word or n-gram in a model."""
    codes = np.frombuffer(event.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return int(_mix((codes * _WEIGHT[: len(codes)]).sum(keepdims=True) + _U64(len(codes)))[0])


@functools.cache
def _kinds() -> np.ndarray:
    """1 for letters, 2 for marks, 0 for all else, by code."""
    return np.fromiter(({"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


@dataclass
class Words:
    """The words of joined texts: codes, and each word's first code, length and the text that it is of."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    owner: np.ndarray

    def hashes(self) -> np.ndarray:
        within = _counted(self.size)
        part = self.codes[np.repeat(self.start, self.size) + within].astype(np.uint64) * _WEIGHT[within]
        heads = np.cumsum(self.size) - self.size
        return _mix((np.add.reduceat(part, heads) if len(part) else part) + self.size.astype(np.uint64))

    def take(self, which: np.ndarray) -> Words:
        return Words(self.codes, self.start[which], self.size[which], self.owner[which])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all n-grams, the number of the word that each is of)."""
        if n == 1:
            place = np.repeat(self.start, self.size) + _counted(self.size)
            return _mix(self.codes[place].astype(np.uint64) * _WEIGHT[0] + _U64(1)), np.repeat(np.arange(len(self.size)), self.size)
        sizes = self.size + 2
        marked = np.empty(int(sizes.sum()) + n, np.uint64)
        heads = np.cumsum(sizes) - sizes
        within = _counted(self.size)
        marked[np.repeat(heads + 1, self.size) + within] = self.codes[np.repeat(self.start, self.size) + within]
        marked[heads], marked[heads + sizes - 1], marked[int(sizes.sum()) :] = ord("<"), ord(">"), 0
        many = np.maximum(sizes - n + 1, 0)
        place = np.repeat(heads, many) + _counted(many)
        total = np.full(len(place), n, np.uint64)
        for j in range(n):
            total += marked[place + j] * _WEIGHT[j]
        return _mix(total), np.repeat(np.arange(len(many)), many)


def _counted(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of `many`."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def words_in(texts: list[str]) -> Words:
    """The words of many texts at once, as words_of gives them."""
    joined = "\n".join(texts).lower()
    if joined.count("\n") != max(0, len(texts) - 1):
        raise ValueError("texts hold line feeds")
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[codes]
    # a mark counts after a letter or another mark that counts
    ground = np.maximum.accumulate(np.where(kind != 2, np.arange(len(codes)), -1)) if (kind == 2).any() else None
    held = kind == 1 if ground is None else (kind == 1) | ((kind == 2) & (ground >= 0) & (kind[ground] == 1))
    before = np.append(False, held[:-1]) if len(held) else held
    start, stop = np.flatnonzero(held & ~before), np.flatnonzero(~held & before)
    if len(stop) < len(start):
        stop = np.append(stop, len(codes))
    size = stop - start
    line = np.flatnonzero(codes == 10)
    if len(size) and size.max() > LONGEST:
        many = -(-size // LONGEST)
        part = _counted(many)
        start, whole = np.repeat(start, many) + LONGEST * part, np.repeat(size, many)
        size = np.minimum(LONGEST, whole - LONGEST * part)
    return Words(codes, start, size, np.searchsorted(line, start))


# the model


class Events:
    """Rows of events by their hashes."""

    def __init__(self, keys: np.ndarray, base: int):
        self.keys, self.base = keys, base

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, whether the event is known)."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return self.base + at, self.keys[at] == hashes

    def get(self, event: str) -> int | None:
        rows, known = self.find(np.array([hash_of(event)], np.uint64))
        return int(rows[0]) if known[0] else None

    def __getitem__(self, event: str) -> int:
        row = self.get(event)
        if row is None:
            raise KeyError(event)
        return row

    def __contains__(self, event: str) -> bool:
        return self.get(event) is not None

    def __len__(self) -> int:
        return len(self.keys)


@dataclass
class Model:
    """events[n] gives the row of an n-gram; n = 0 are whole words. A row lists the languages that have the event, sparsely."""

    langs: list[str]
    events: dict[int, Events] = field(default_factory=dict)
    #: log frequency, for each length, of an event that a language lacks
    floor: dict[int, np.ndarray] = field(default_factory=dict)
    #: entries of row r are first[r] to first[r + 1]: a language, and by how much its log frequency lies above the floor
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    lang: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def scores(self) -> _Scores:
        return _Scores(self)

    def rows_of(self, word: str) -> list[int]:
        """The word's row; of an unseen word those of its longest n-grams of which any is known, whose mean is its score."""
        known = self.events[0].get(word) if 0 in self.events else None
        if known is not None:
            return [known]
        for n in range(MAX_GRAM, 0, -1):
            held = self.events.get(n)
            if held and (found := [r for g in grams_of(word, n) if (r := held.get(g)) is not None]):
                return found
        return []

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the entries of all rows, which of the rows each is of)."""
        many = self.first[rows + 1] - self.first[rows]
        return np.repeat(self.first[rows], many) + _counted(many), np.repeat(np.arange(len(rows)), many)

    def of_texts(self, texts: list[str], counted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores of each text without line feeds, the sum over its words; whether it has letters; and, if counted, a row for
        each: its n-grams of TELLING characters, and those of them that each language has)."""
        n, k = len(texts), len(self.langs)
        words = words_in(texts)
        score, letters = np.zeros(n * k), np.bincount(words.owner, minlength=n) > 0
        grams = self._telling(words, n) if counted else np.zeros((n, 0))
        if 0 in self.events and len(words.size):
            rows, known = self.events[0].find(words.hashes())
            self._add(score, 0, rows[known], words.owner[known], np.ones(int(known.sum())))
            words = words.take(~known)
        for length in range(MAX_GRAM, 0, -1):
            if length not in self.events or not len(words.size):
                continue
            hashes, of = words.grams(length)
            rows, known = self.events[length].find(hashes)
            rows, of = rows[known], of[known]
            many = np.bincount(of, minlength=len(words.size))
            self._add(score, length, rows, words.owner[of], 1 / many[of])
            words = words.take(many == 0)
        return score.reshape(n, k), letters, grams

    def _add(self, score: np.ndarray, length: int, rows: np.ndarray, owner: np.ndarray, share: np.ndarray) -> None:
        k = len(self.langs)
        place, of = self.entries(rows)
        score += np.bincount(owner[of] * k + self.lang[place], share[of] * self.gain[place], len(score))
        score += (np.bincount(owner, share, len(score) // k)[:, None] * self.floor[length]).ravel()

    def _telling(self, words: Words, n: int) -> np.ndarray:
        out, k = np.zeros((n, 1 + len(self.langs)), np.int64), len(self.langs)
        hashes, of = words.grams(TELLING) if len(words.size) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        owner = words.owner[of]
        out[:, 0] = np.bincount(owner, minlength=n)
        if TELLING in self.events:
            rows, known = self.events[TELLING].find(hashes)
            place, of = self.entries(rows[known])
            out[:, 1:] = np.bincount(owner[known][of] * k + self.lang[place], minlength=n * k).reshape(n, k)
        return out


class _Scores:
    """The model's rows as log frequencies in each language."""

    def __init__(self, model: Model):
        self.model = model

    def __getitem__(self, row: int) -> np.ndarray:
        m = self.model
        length = next(n for n, e in m.events.items() if e.base <= row < e.base + len(e))
        out = m.floor[length].copy()
        of = slice(m.first[row], m.first[row + 1])
        out[m.lang[of]] += m.gain[of]
        return out


def fit(counts: dict[int, dict[str, Counter]]) -> Model:
    """counts[n][lang]: occurrences of words (n = 0) and n-grams."""
    langs = sorted({lang for c in counts.values() for lang in c})
    return _fitted(langs, {n: [np.array(x, t) for x, t in zip(zip(*((hash_of(e), langs.index(lang), c) for lang, x in by_lang.items() for e, c in x.items()), strict=True), (np.uint64, np.int64, np.int64), strict=True)] for n, by_lang in counts.items()})


def _fitted(langs: list[str], counts: dict[int, list[np.ndarray]]) -> Model:
    """counts[n]: hash, language and count of each event. Log frequencies are smoothed by ALPHA over all events of that length."""
    model, firsts, at = Model(langs), [np.zeros(1, np.int64)], 0
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    entries = 0
    for n, (key, lang, count) in sorted(counts.items()):
        order = np.lexsort((lang, key))
        key, lang, count = key[order], lang[order], count[order]
        names, many = np.unique(key, return_counts=True)
        total = np.bincount(lang, count, len(langs)) + ALPHA * len(names)
        model.events[n], model.floor[n] = Events(names, at), np.log(ALPHA / total)
        firsts.append(entries + np.cumsum(many))
        parts.append((lang.astype(np.int32), np.log((count + ALPHA) / ALPHA)))
        at, entries = at + len(names), entries + len(key)
    model.first = np.concatenate(firsts)
    if parts:
        model.lang, model.gain = (np.concatenate(x) for x in zip(*parts, strict=True))
    return model


def training_rows(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int | None = TRAIN_DOCS) -> DataFrame:
    """(text, lang, id) of the rows that `train` fits on: all, or about max_docs by a hash of the id (without one, of the text)."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id")).where("text is not null and lang is not null")
    if max_docs is None:
        return rows
    langs = rows.groupBy("lang").count().collect()  # a row for each language
    if sum(r["count"] for r in langs) > max_docs:
        shares = _shares({r["lang"]: r["count"] for r in langs}, max_docs)
        bound = F.create_map(*(F.lit(x) for lang, share in sorted(shares.items()) for x in (lang, math.ceil(share * (1 << 30)))))[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64(F.coalesce("id", "text")), F.lit(1 << 30)) < bound)
    return rows


def _shares(counts: dict[str, int], max_docs: int) -> dict[str, float]:
    """The share of each language's rows to take: one share for all, but for languages that it would leave with under LEAST_DOCS."""
    least = min(LEAST_DOCS, max(1, max_docs // len(counts)))
    small: set[str] = set()
    while True:
        rest = max_docs - sum(min(least, counts[x]) for x in small)
        share = min(1.0, max(0, rest) / max(1, sum(n for x, n in counts.items() if x not in small)))
        more = {x for x, n in counts.items() if x not in small and n * share < min(least, n)}
        if not more:
            return {x: min(1.0, least / n) if x in small else share for x, n in counts.items()}
        small |= more


_COUNTS = "lang string, n int, event long, count long"


def _counted_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of (text, lang) rows, counted for each slice and language."""
    for batch in batches:
        for part in slices(batch, ["text"]):
            texts = np.array([t.replace("\n", " ") for t in part.column(0).to_pylist()], object)
            coded = part.column(1).dictionary_encode()
            for code, lang in enumerate(coded.dictionary.to_pylist()):
                words = words_in(texts[coded.indices.to_numpy() == code].tolist())
                keys, first, many = np.unique(words.hashes(), return_index=True, return_counts=True)
                found, distinct = [(0, keys, many)], words.take(first)
                for n in range(1, MAX_GRAM + 1):
                    hashes, of = distinct.grams(n)
                    grams, number = np.unique(hashes, return_inverse=True)
                    found.append((n, grams, np.bincount(number, many[of], len(grams)).astype(np.int64)))
                for n, events, count in found:
                    size = len(events)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(np.full(size, n, np.int32)), pa.array(events.view(np.int64)), pa.array(count, pa.int64())], names=["lang", "n", "event", "count"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int | None = TRAIN_DOCS) -> Model:
    """Fit on rows with text and a language, and keep all words and n-grams that they hold.

    Above max_docs rows about max_docs are taken, of each language LEAST_DOCS at least; that bounds the model, of which the driver
    gets a hash and a count for each event. None: all rows are, and the model grows with their distinct words. All languages are learned. No usable row: a model without languages; a labelled text
    without letters teaches its language's name alone.
    """
    rows = training_rows(labelled, text_col, lang_col, id_col, max_docs)
    counts = rows.select("text", "lang").mapInArrow(_counted_events, _COUNTS).groupBy("lang", "n", "event").agg(F.sum("count").alias("count"))
    found = counts.toArrow()
    if not found.num_rows:
        return Model([])
    langs = sorted(pc.unique(found.column("lang")).to_pylist())
    lang = pc.index_in(found.column("lang"), value_set=pa.array(langs, pa.string())).to_numpy()
    length, event, count = (found.column(c).to_numpy() for c in ("n", "event", "count"))
    del found
    return _fitted(langs, {n: [event[length == n].view(np.uint64), lang[length == n], count[length == n]] for n in np.unique(length).tolist()})


_FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_COUNTED = T.StructType([*_FIELDS, T.StructField("_grams", T.LongType()), T.StructField("_known", T.LongType())])


class Predictor:
    """Scores of whole columns of texts: distinct tokens of a column are scored once."""

    def __init__(self, model: Model, counted: bool = False):
        self.model, self.counted = model, counted

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray, *tuple[np.ndarray, ...]]:
        """The language and its share of the likelihood; `und` and 0 without letters or languages. Ties: the first name.

        If counted, also the text's n-grams of TELLING characters and those of them that the language has.
        """
        n, langs = len(texts), self.model.langs
        if not n or not langs:
            return [UNKNOWN] * n, np.zeros(n), *([np.zeros(n, np.int64)] * 2 if self.counted else ())
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        tokens = lists.flatten().dictionary_encode()
        scores, letters, grams = self.model.of_texts(tokens.dictionary.to_numpy(zero_copy_only=False).tolist(), self.counted)
        rows = tokens.indices.to_numpy()
        offsets = lists.offsets.to_numpy()
        owner = np.repeat(np.arange(n), np.diff(offsets))
        total = np.stack([np.bincount(owner, scores[rows, k], n) for k in range(len(langs))], 1)
        lettered = np.bincount(owner, letters[rows], n) > 0
        best = total.argmax(1)
        share = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(1)
        out = [langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0)
        if not self.counted:
            return out
        counts = [np.bincount(owner, grams[rows, column], n).astype(np.int64) for column in (0, 1 + best[owner])]
        return *out, *counts


def identify(docs: DataFrame, model: Model | Broadcast, text_col: str = "text", counted: bool = False) -> DataFrame:
    """Add lang_pred and score (the predicted language's share of the likelihood, 0 to 1); whole texts, no shuffle.

    `und` with score 0 for null, empty or letterless text, or when the model knows no language. A word none of whose letters the
    model knows adds nothing. Equal likelihoods: the first language by name. Repeated rows are judged each. Columns of docs
    called lang_pred or score are replaced.
    If counted, also _grams and _known: the text's n-grams of TELLING characters, and those of them that its language has.
    A model for several calls can be broadcast once, before them.
    """
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    limit = max(1 << 16, BATCH_BYTES * BATCH_LANGS // max(BATCH_LANGS, len(shared.value.langs)))
    return append_columns(docs, _COUNTED if counted else _FIELDS, [text_col], lambda: Predictor(shared.value, counted), limit=limit, arrow=True)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id's text, modulo 3, is 1. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
