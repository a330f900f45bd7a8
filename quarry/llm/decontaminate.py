"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a seed, an equal run of five words, are tiled: the longest equal run of words that
neither side has marked is found by Karp-Rabin hashes, which roll along both whole texts, and marked; then the longest
of what is left unmarked, and so on down to TILE words. A document is contaminated by an item if the tiles together
cover enough of the item, in whatever order its passages stand.

While the benchmark's texts are under BLOCK_BYTES, an index of its seeds goes to the executors and documents pass it
once. Beyond that, seeds are joined: a filter of fixed size lets through the documents' seeds that any item may have,
these meet the items' seeds in a shuffle, and each document goes to the items that it shares one with. Memory is the
same for a benchmark of any size, and so are the results.

Words are runs of letters, digits and underscores, lower-cased. Defined results: a null or short text, or an item
under five words, never matches; equal items are both reported, in order of their ids; an item without id counts and
is reported as null; equal rows get equal results; an empty table of documents gives an empty result and an empty
benchmark leaves all documents clean; further columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WordHashes, batches, discard, settle, skew_join, small, unused, window_hashes

SEED = 5
#: Shortest tile.
TILE = 3
#: Part of an item that tiles must cover.
COVERAGE = 0.8
#: Bytes of test items whose index is sent whole.
BLOCK_BYTES = 16 << 20
#: Cells of the filter of seeds: 8 MB.
FILTER_BITS = 26
#: Items that one document is held against in a row.
PARTNERS = 256

_WORDS = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str | None) -> list[str]:
    """Lower-cased words."""
    return _WORDS.findall((text or "").lower())


def hashed(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of a text's words; a word counts as equal to another of the same 64 bits."""
    return hashes.of(w.encode("utf-8", "surrogatepass") for w in words(text))


class Rolling:
    """Karp-Rabin hashes of all runs of a sequence: a run's hash is a difference of sums, shifted to its place."""

    def __init__(self, x: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(x), _BASE)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(x), _INVERSE)]), dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(x * powers[:-1], dtype=np.uint64)])

    def runs(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs of n words at some places."""
        with np.errstate(over="ignore"):
            return (self.sums[at + n] - self.sums[at]) * self.back[at]


def _room(free: np.ndarray) -> np.ndarray:
    """For each place, how many free ones follow each other from there."""
    n = len(free)
    ends = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)


class Tiles:
    """A document's words, prepared for tiling against many items."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.grams = window_hashes(x, TILE)
        self.known = np.unique(self.grams)

    def covered(self, item: np.ndarray, least: float = 0.0) -> int:
        """Words of an item that greedy tiles cover; if fewer than ``least`` can be, a bound below it.

        Only words in a run of TILE words that the other side has can be in a tile, so both sides are cut to these.
        Runs of equal length go by place in the item, then in the document.
        """
        grams = window_hashes(item, TILE)
        if not len(grams) or not len(self.known):
            return 0
        own = _marked(np.flatnonzero(np.isin(grams, self.known)), TILE, len(item))
        if not own.any() or own.sum() < least:
            return int(own.sum())
        there = _marked(np.flatnonzero(np.isin(self.grams, grams)), TILE, len(self.x))
        a, free_a = _stretches(self.x, there)
        b, free_b = _stretches(item, own)
        roll_a, roll_b = Rolling(a), Rolling(b)
        total, top = 0, len(b)
        while True:
            room_a, room_b = _room(free_a), _room(free_b)
            top = min(top, int(room_a.max()), int(room_b.max()))
            n, low, high = 0, TILE, top
            while low <= high:  # a common run of n words holds one of n - 1
                half = (low + high + 1) // 2
                if np.isin(roll_b.runs(np.flatnonzero(room_b >= half), half), roll_a.runs(np.flatnonzero(room_a >= half), half)).any():
                    n, low = half, half + 1
                else:
                    high = half - 1
            if not n:
                return total
            total += n * self._mark(a, b, free_a, free_b, roll_a, roll_b, np.flatnonzero(room_a >= n), np.flatnonzero(room_b >= n), n)
            top = n - 1

    @staticmethod
    def _mark(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, roll_a: Rolling, roll_b: Rolling, at_a: np.ndarray, at_b: np.ndarray, n: int) -> int:
        """Mark all tiles of n words, no longer ones being left; returns how many."""
        of_a, of_b = roll_a.runs(at_a, n), roll_b.runs(at_b, n)
        order = np.argsort(of_a, kind="stable")
        of_a, at_a = of_a[order], at_a[order]
        first, end = np.searchsorted(of_a, of_b), np.searchsorted(of_a, of_b, "right")
        next_of: dict[int, int] = {}
        done = clear = 0
        for j, k, last in zip(at_b.tolist(), first.tolist(), end.tolist(), strict=True):
            if j < clear or k == last:
                continue
            p = next_of.get(k, k)
            while p < last:
                i = int(at_a[p])
                p += 1
                # tiles of this round have one length, so an overlap shows at an end
                if free_a[i] and free_a[i + n - 1] and (a[i : i + n] == b[j : j + n]).all():
                    free_a[i : i + n] = free_b[j : j + n] = False
                    done, clear = done + 1, j + n
                    break
            next_of[k] = p
        return done


def _marked(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether each place lies in a run of n from some start."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps)[:size] > 0


def _stretches(x: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is kept of a sequence, with a place that is not free wherever something was left out."""
    at = np.flatnonzero(keep)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(x[at], gaps, 0), np.insert(np.ones(len(at), bool), gaps, False)


def tile(text: list[str], item: list[str]) -> int:
    """Words of an item that greedy tiles of a text cover."""
    hashes = WordHashes()
    return Tiles(hashes.of(w.encode("utf-8", "surrogatepass") for w in text)).covered(hashes.of(w.encode("utf-8", "surrogatepass") for w in item))


class Block:
    """Test items with an index of their seeds."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]]) -> None:
        self.ids: list[int | None] = []
        self.items: list[np.ndarray] = []
        hashes, owner, runs = WordHashes(), [], []
        for item, text in items:
            x = hashed(text, hashes)
            h = window_hashes(x, SEED)
            if len(h):
                owner.append(np.full(len(h), len(self.ids)))
                runs.append(h)
                self.ids.append(item)
                self.items.append(x)
        h = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.seeds = h[order]
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, np.int64)

    def matches(self, x: np.ndarray) -> list[tuple[int | None, float]]:
        """(item, coverage) of the items that contaminate a document of word hashes."""
        h = np.unique(window_hashes(x, SEED))
        first, end = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, "right")
        hit = np.flatnonzero(first < end)
        if not len(hit):
            return []
        near = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(first[hit].tolist(), end[hit].tolist(), strict=True)]))
        tiles, out = Tiles(x), []
        for k in near.tolist():
            least = COVERAGE * len(self.items[k])
            covered = tiles.covered(self.items[k], least)
            if covered >= least:
                out.append((self.ids[k], covered / len(self.items[k])))
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def _block(benchmark: DataFrame) -> Block | None:
    """The index of a benchmark of at most BLOCK_BYTES, nothing for a larger one."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BLOCK_BYTES:
        return None
    rows = items.toArrow()  # of a checked size
    return Block(sorted(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))


def _key(doc_id: str, text: str) -> list:
    """Two hashes of a row's id and text, which stand for it."""
    i, t = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return [F.xxhash64(i, t), F.xxhash64(t, F.lit(1), i)]


def _joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Settled (k1, k2, item_ids, coverage) of the contaminated among documents (k1, k2, text), by a join of seeds."""
    spark = docs.sparkSession
    items = settle(_items(benchmark).withColumn("nr", F.monotonically_increasing_id()))

    def seeds_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            found = [np.unique(window_hashes(hashed(text, hashes), SEED)) for text in part.column(1).to_pylist()]
            nr = np.repeat(part.column(0).to_numpy(), [len(h) for h in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)), pa.array(nr, pa.int64())], ["seed", "nr"])

    seeds = settle(items.select("nr", "text").mapInArrow(seeds_of, "seed long, nr long"))
    cell = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")
    rows = seeds.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2^20 rows at most
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(bits.view(np.uint64))

    def seeds_in(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            out = []
            for k1, k2, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                h = np.unique(window_hashes(hashed(text, hashes), SEED))
                at = h >> np.uint64(64 - FILTER_BITS)
                h = h[(sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                if len(h):
                    out.append((h.view(np.int64), np.full(len(h), k1), np.full(len(h), k2)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["seed", "k1", "k2"])

    hits = settle(docs.select("k1", "k2", "text").mapInArrow(seeds_in, "seed long, k1 long, k2 long"))
    pairs = settle(skew_join(hits, seeds, ["seed"], ["k1"]).select("k1", "k2", "nr").distinct())
    discard(seeds, hits)
    many = pairs.groupBy("k1", "k2").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = settle(skew_join(pairs, many, ["k1", "k2"], ["nr"]).withColumn("part", F.pmod(F.xxhash64("nr"), F.col("parts"))))
    discard(pairs)
    wanted = settle(dealt.groupBy("k1", "k2").agg(F.collect_set("part").alias("ps")))
    size = wanted.agg(F.sum(F.lit(48) + 8 * F.size("ps"))).first()[0] or 0
    texts = docs.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, ["k1", "k2"])
    one = texts.select("k1", "k2", F.explode("ps").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("nr"), F.lit(None).cast("long").alias("item_id"), "text")
    other = skew_join(dealt, items, ["nr"], ["k1"]).select("k1", "k2", "part", F.lit(1).alias("kind"), "nr", "item_id", "text")

    def hold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, tiles = WordHashes(), None, None
        for part in parts:
            out = []
            for k1, k2, kind, item, text in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == 0:
                    if at != (k1, k2):
                        at, tiles = (k1, k2), Tiles(hashed(text, hashes))
                    continue
                x = hashed(text, hashes)
                covered = tiles.covered(x, COVERAGE * len(x))
                if covered >= COVERAGE * len(x):
                    out.append((k1, k2, item, covered / len(x)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["k1", "k2", "item_id", "coverage"])

    rows = one.unionByName(other).repartition("k1", "k2", "part").sortWithinPartitions("k1", "k2", "part", "kind", "nr").select("k1", "k2", "kind", "item_id", "text")
    found = rows.mapInArrow(hold, "k1 long, k2 long, item_id long, coverage double").groupBy("k1", "k2")
    # a null id keeps its place in a list only as a struct
    ids = F.transform(F.sort_array(F.collect_list(F.struct(F.col("item_id").isNull().alias("none"), "item_id"))), lambda x: x["item_id"])
    out = settle(found.agg(ids.alias("item_ids"), F.max("coverage").alias("coverage")))
    discard(items, dealt, wanted)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (of the items that it leaks) and coverage (the greatest) of each document."""
    spark = docs.sparkSession
    batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    block = _block(benchmark)
    if block is None:
        k1, k2 = _key("doc_id", "text")
        keyed = rows.withColumns({"k1": k1, "k2": k2})
        found = _joined(keyed, benchmark)
        judged = skew_join(settle(keyed.drop("text")), found, ["k1", "k2"], ["doc_id"], "left")
        none = F.array().cast("array<bigint>")
        return judged.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    sent = spark.sparkContext.broadcast(block)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            found = [sent.value.matches(hashed(text, hashes)) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([bool(x) for x in found], pa.bool_()),
                    pa.array([[i for i, _ in x] for x in found], pa.list_(pa.int64())),
                    pa.array([max((c for _, c in x), default=0.0) for x in found], pa.float64()),
                ],
                ["doc_id", "contaminated", "item_ids", "coverage"],
            )

    return rows.mapInArrow(run, "doc_id long, contaminated boolean, item_ids array<bigint>, coverage double")


_HASHES = WordHashes()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns; texts are not shuffled while the index is sent whole."""
    spark = docs.sparkSession
    batches(spark)
    block = _block(benchmark)
    if block is None:
        names = unused(docs, "quarry_k1", "quarry_k2")
        keys = _key("doc_id", "text")
        rows = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.col("text").cast("string").alias("text"))
        found = _joined(rows, benchmark)
        gone = settle(found.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])))
        return docs.withColumns(dict(zip(names, keys, strict=True))).join(small(gone, 32), names, "left_anti").select(*docs.columns)
    sent = spark.sparkContext.broadcast(block)

    @F.arrow_udf("boolean")
    def clear(text: pa.Array) -> pa.Array:
        return pa.array([not sent.value.matches(hashed(t, _HASHES)) for t in text.to_pylist()], pa.bool_())

    return docs.where(clear(F.col("text").cast("string"))) if block.ids else docs
