"""Quality rules: distribution divergence.

A document's histograms of character classes and of common words are compared by Jensen-Shannon distance to
references per language. The references are summed over every document of a language, however few its words; its common
words are the most frequent of them, counted in a fixed number of hashed cells. A document is held against all languages and judged by the
nearest, so that a wrong language label costs nothing. Its own language is always among them: a rare language is not held
against others alone, and since a document is part of its own reference, few words bring the reference nearer to
it, not further away.

Documents of a null or unknown language make no reference, and may be of a language that has none. They are held
against the nearest reference in what does not depend on the script: letters, digits, stops, symbols and the rest, without blanks.

Defined results: a null or empty text has no words, fails the base rule and is not kept; texts shorter than the
guards are not judged by the histogram concerned, nor is any text without a reference; equal rows get equal
results; an empty table gives an empty result; further columns are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHED_WORDS, WordHashes, batches, discard, settle, window_hashes

#: Symbols of the base rule.
SYMBOLS = "#*$%&|<>"
#: Longest distance of each histogram from its nearest reference, and the least length at which it is judged.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.26, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.31, 40
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other letter", "other")
#: Classes of any script: letters, digits, stops, symbols and others, by class above; blanks are left out.
NEUTRAL = ((0, 1, 6), (2,), (4,), (5,), (7,))
#: Words are counted in so many cells, of which so many are a language's common words.
CELL_BITS, COMMON = 16, 16
#: Labels that say that the language is not known.
UNKNOWN = ("", "und", "unknown", "mul", "mis", "zxx")
#: Languages whose counts a worker holds at once.
HELD = 64

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()"


def _class_table() -> np.ndarray:
    """The class of each code point of the basic plane."""
    return np.array([_class_of(chr(c)) for c in range(1 << 16)], np.uint8)


def _class_of(x: str) -> int:
    if x < "\x80":
        return 0 if x.islower() else 1 if x.isupper() else 2 if x.isdigit() else 3 if x.isspace() else 4 if x in ".,;:'\"-?()" else 5
    return 6 if x.isalpha() else 7


_CLASS = _class_table()


def char_histogram(text: str) -> np.ndarray:
    """Code points of a text by class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _CLASS[np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        found, at = np.unique(points[high], return_inverse=True)
        kinds[high] = np.array([_class_of(chr(c)) for c in found], np.uint8)[at]
    return np.bincount(kinds, minlength=len(CLASSES))


class Cells(dict):
    """Cells of words, lower-cased and without punctuation at the ends, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = cell = xxhash.xxh64_intdigest(word.strip(_EDGES).lower().encode("utf-8", "surrogatepass")) >> (64 - CELL_BITS)
        return cell

    def of(self, words: list[str]) -> np.ndarray:
        """The cells of words, in order."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of distribution p from each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


def base_counts(text: str, words: list[str], hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line and _SPACE.fullmatch(line) is None:
            seen.add(line)
    repeat = 0
    if len(words) > 5:
        runs = window_hashes(hashes.of(w.encode("utf-8", "surrogatepass") for w in words), 5)
        order = np.sort(runs)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            steps = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(np.isin(runs, twice))
            np.add.at(steps, at, 1)
            np.add.at(steps, at + 5, -1)
            repeat = int((np.cumsum(steps) > 0).sum())
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """The base rule: too short, or mostly repetition."""
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def _words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


class References:
    """Distributions of each language: character classes, and common words with all others in the last place."""

    def __init__(self, rows: list[tuple[str, np.ndarray, list[tuple[int, int]], int]]) -> None:
        """From (language, characters by class, (cell, count) of common words, all words), in order of languages."""
        self.chars = np.array([c / c.sum() for _, c, _, _ in rows if c.any()]).reshape(-1, len(CLASSES))
        self.neutral = np.array([neutral(c) for _, c, _, _ in rows if neutral(c) is not None]).reshape(-1, len(NEUTRAL))
        with_words = [(top, n) for _, _, top, n in rows if n]
        self.words = np.zeros((len(with_words), COMMON + 1))
        self.place = np.full((len(with_words), 1 << CELL_BITS), COMMON, np.uint8)
        for i, (top, n) in enumerate(with_words):
            for k, (cell, count) in enumerate(top):
                self.place[i, cell], self.words[i, k] = k, count / n
            self.words[i, COMMON] = 1 - sum(count for _, count in top) / n


def neutral(chars: np.ndarray) -> np.ndarray | None:
    """The distribution of NEUTRAL classes; None if there are only blanks."""
    x = np.array([chars[list(c)].sum() for c in NEUTRAL], float)
    return x / x.sum() if x.any() else None


def references(docs: DataFrame) -> References:
    """References of every language that is named, over all documents.

    What reaches the driver is COMMON words and a few cells for each language.
    """
    batches(docs.sparkSession)
    n_classes = len(CLASSES)

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, by = Cells(), {}

        def emitted() -> pa.RecordBatch:
            found = [(lang, np.flatnonzero(x), x[np.flatnonzero(x)]) for lang, x in by.items()]
            langs = [lang for lang, at, _ in found for _ in range(len(at))]
            at, n = (np.concatenate([x[i] for x in found] or [np.empty(0, np.int64)]) for i in (1, 2))
            by.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["lang", "cell", "n"])

        for part in parts:
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text:
                    if lang not in by:
                        if len(by) >= HELD:
                            yield emitted()
                        by[lang] = np.zeros(n_classes + (1 << CELL_BITS), np.int64)
                    x = by[lang]
                    x[:n_classes] += char_histogram(text)
                    x[n_classes:] += np.bincount(cells.of(_words(text)), minlength=1 << CELL_BITS)
        yield emitted()

    named = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~F.col("lang").isin(*UNKNOWN))
    counts = settle(named.mapInArrow(sums, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "cell"))
    words = counts.where(F.col("cell") >= n_classes)
    top = words.withColumn("rank", rank).where(F.col("rank") <= COMMON).orderBy("lang", "rank").collect()
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    chars: dict[str, np.ndarray] = {}
    for r in counts.where(F.col("cell") < n_classes).collect():
        chars.setdefault(r["lang"], np.zeros(n_classes))[r["cell"]] = r["n"]
    discard(counts)
    common: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        common.setdefault(r["lang"], []).append((r["cell"] - n_classes, r["n"]))
    return References([(lang, chars[lang], common.get(lang, []), totals.get(lang, 0)) for lang in sorted(chars)])


def distances(text: str, words: list[str], lang: str | None, cells: Cells, refs: References) -> tuple[float | None, float | None]:
    """Distances from the nearest references; None under the guards or without references."""
    near_chars = near_words = None
    known = lang is not None and lang not in UNKNOWN
    if len(text) >= MIN_CHARS and len(refs.chars):
        counts = char_histogram(text)
        own, others = (counts / len(text), refs.chars) if known else (neutral(counts), refs.neutral)
        if own is not None and len(others):
            near_chars = float(js_distance(own, others).min())
    if known and len(words) >= MIN_WORDS and len(refs.words):
        found = cells.of(words)
        own = np.array([np.bincount(place[found], minlength=COMMON + 1) for place in refs.place]) / len(words)
        near_words = float(js_distance(own, refs.words).min())
    return near_chars, near_words


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def verdict(text: str | None, lang: str | None, hashes: WordHashes, cells: Cells, refs: References) -> tuple:
    """All that SCHEMA has after doc_id, for one text of a language."""
    text = text or ""
    words = _words(text)
    base = base_counts(text, words, hashes)
    failed = base_failed(base[0], base[4])
    far = distances(text, words, lang, cells, refs)
    kept = not failed and (far[0] is None or far[0] <= MAX_CHAR_DISTANCE) and (far[1] is None or far[1] <= MAX_WORD_DISTANCE)
    return *base, failed, kept, *far


def judge(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(references(docs))  # 64 KB for each language

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = WordHashes(), Cells()
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        for part in parts:
            rows = [verdict(text, lang, hashes, cells, sent.value) for text, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, SCHEMA)


_HASHES, _CELLS = WordHashes(), Cells()


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The verdict is taken in the same pass over the rows, batch by batch, so that no text is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(references(docs))

    @F.arrow_udf("boolean")
    def good(text: pa.Array, lang: pa.Array) -> pa.Array:
        return pa.array([verdict(t, x, _HASHES, _CELLS, sent.value)[6] for t, x in zip(text.to_pylist(), lang.to_pylist(), strict=True)], pa.bool_())

    return docs.where(good(F.col("text").cast("string"), F.col("lang").cast("string")))
