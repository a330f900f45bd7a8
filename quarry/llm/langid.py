"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of lower-cased letters (everything else counts as one space) are hashed to 2^15 cells.
Document frequencies are counted over all documents that may be learned from. The classifier is fitted on a bounded
sample, drawn by hash at a rate per language, by follow-the-regularised-leader with elastic-net penalties, of which the
first makes weights exactly 0; only cells with a weight are kept and sent. The temperature is then set on a part of
the sample that the classifier has not seen, by the least log loss against targets that grant each other language one
more document (Platt's), so that a part without errors still has a finite best temperature.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from, every
text is; a null id counts as an empty one when documents are held out; equal texts get equal predictions; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches

BITS = 15
CELLS = 1 << BITS
#: The classifier is fitted on about so many documents at most, shared evenly among languages.
SAMPLE = 3200
#: One in so many sampled documents sets the temperature.
CALIBRATION = 5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 1e-2
UNKNOWN = "und"

_SPACE = 0x20


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


_LETTER = _letters()


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a text's n-grams and how often each occurs; empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        kinds, at = np.unique(points[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in kinds])[at]
    if not letter.any():
        return np.empty(0, np.int32), np.empty(0, np.int32)
    points = np.where(letter, points, _SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    x = np.concatenate([[_SPACE], points[keep], [_SPACE]]).astype(np.uint32)
    with np.errstate(over="ignore"):
        one = x * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
        all_of = np.concatenate([one, two, three])
        all_of = (all_of ^ (all_of >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    count = np.bincount(all_of >> np.uint32(32 - BITS), minlength=CELLS)
    cells = np.flatnonzero(count)
    return cells.astype(np.int32), count[cells].astype(np.int32)


def weigh(cells: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = (1 + np.log(counts)) * idf[cells]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(z: np.ndarray) -> np.ndarray:
    """Probabilities of scores along the last axis."""
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, a column for each class; the last row is the intercept."""

    def __init__(self, classes: int) -> None:
        self.z = np.zeros((CELLS + 1, classes))
        self.n = np.zeros((CELLS + 1, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """Weights of some rows, those within the L1 penalty being 0."""
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, cells: np.ndarray, x: np.ndarray, label: int) -> None:
        """One step on one document."""
        at = np.append(cells, CELLS)
        x = np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
        self.n[at] = new


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm in a bracket that grows as needed."""
    if not len(labels):
        return 1.0
    n, k = scores.shape
    wanted = np.full((n, k), 1 / (n + k))
    wanted[np.arange(n), labels] = (n + 1) / (n + k)

    def loss(t: float) -> float:
        z = scores / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - (wanted * z).sum(1)).mean())

    low, high, r = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(6):
        a, b = low, high
        for _ in range(40):
            c, d = b - r * (b - a), a + r * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        best = (a + b) / 2
        if low + 0.01 < best < high - 0.01:
            break
        low, high = (low - 3, high) if best <= low + 0.01 else (low, high + 3)
    return float(np.exp(best))


class Model:
    """Languages, idf, the weights of the cells that have any, intercepts and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float) -> None:
        self.languages, self.idf, self.heat = languages, idf, heat
        used = np.flatnonzero((weights[:CELLS] != 0).any(1))
        self.row = np.full(CELLS, -1, np.int32)
        self.row[used] = np.arange(len(used))
        self.weights, self.intercepts = weights[used], weights[CELLS]

    def scores(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A score for each language."""
        x, row = weigh(cells, counts, self.idf), self.row[cells]
        held = row >= 0
        return x[held] @ self.weights[row[held]] + self.intercepts

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a whole text and its probability."""
        cells, counts = grams(text)
        if not len(cells) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.scores(cells, counts) / self.heat)
        best = int(p.argmax())
        return self.languages[best], min(1.0, float(p[best]))


def held_out(doc_id: Column) -> Column:
    """Whether a document may not be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame) -> Model:
    """Learn from the documents that are labelled and not held out.

    What reaches the driver is 2^15 document frequencies and the grams of the sample.
    """
    spark = docs.sparkSession
    batches(spark)
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def frequencies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CELLS + 1, np.int64)
        for part in parts:
            for text in part.column(0).to_pylist():
                cells, _ = grams(text)
                found[cells] += 1
                found[CELLS] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["cell", "n"])

    df = np.zeros(CELLS + 1)
    for cell, n in usable.select("text").mapInArrow(frequencies, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        df[cell] = n
    idf = np.log((1 + df[CELLS]) / (1 + df[:CELLS])) + 1

    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((CELLS + 1, 0)), 1.0)
    each = max(1, SAMPLE // len(languages))
    rate = F.create_map(*(F.lit(v) for lang in languages for v in (lang, min(1.0, each / sizes[lang]))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)

    def sampled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [grams(text) for text in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int32()))], ["doc_id", "lang", "cells", "counts"]
            )

    rows = usable.where(draw < rate[F.col("lang")]).select(F.xxhash64("doc_id", F.lit("order")).alias("doc_id"), "lang", "text")
    sample = rows.mapInArrow(sampled, "doc_id long, lang string, cells array<int>, counts array<int>").toArrow().to_pydict()
    held = zip(*(sample[k] for k in ("doc_id", "lang", "cells", "counts")), strict=True)
    data = [(i, languages.index(lang), np.array(c, np.int32), np.array(n, np.int32)) for i, lang, c, n in sorted(held) if c]
    learned = [r for k, r in enumerate(data) if k % CALIBRATION]
    judged = [r for k, r in enumerate(data) if k % CALIBRATION == 0]
    machine = Ftrl(len(languages))
    features = [weigh(c, n, idf) for _, _, c, n in learned]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(learned)):
            machine.learn(learned[k][2], features[k], learned[k][1])
    model = Model(languages, idf, machine.weights(slice(None)), 1.0)
    if judged and len(languages) > 1:
        model.heat = temperature(np.array([model.scores(c, n) for _, _, c, n in judged]), np.array([y for _, y, _, _ in judged]))
    return model


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row of SCHEMA for each document; only the text decides."""
    batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^15 rows at most of as many weights as languages

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [sent.value.predict(text) for text in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on docs, then predict all of them."""
    return predict(docs, fit(docs))
