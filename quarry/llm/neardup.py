"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is sketched in 128 buckets. Each holds the least hash that fell into it, compressed
to its count of leading zeros and ten mantissa bits; an empty bucket borrows another's register by a fixed probing
order. Bands of compressed registers are candidate keys. A candidate pair goes on if its Jaccard similarity, estimated
from equal registers and corrected for those that collide by chance, comes near the threshold, and is linked if
the full shingle sets reach it.

Equal sets are one class from the start. In each bucket of a band, every class is first held against the least
class. After these links' components are known, buckets that still hold several components are searched again for
pairs across them, so that no link is lost to the choice of the least class: in small buckets every member meets
every other. Members of larger ones meet where they share one of their rarest shingles: of two sets that reach the
threshold, so many of the rarest must hold a common one, by the sizes of both (the prefix filter), and what a whole
family of texts shares is not rare. Large groups go to tasks block by block with their full sets, and a task names no more
links than it takes to join its members' components. Pairs within a component are not listed.

Defined results: a null, empty or blank text has the empty set, links with nothing and is kept; a row without id
cannot name a component: its component is null, it links with nothing and is kept; rows of equal id are rows of their
own, linked by their texts alone; equal texts link; an empty table gives an empty result; further columns are ignored
by ``duplicates`` and kept by ``dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WordHashes, batches, components, discard, mix, settle, skew_join, small, unused, window_hashes

BUCKETS, ZERO_BITS, MANTISSA = 128, 6, 10
#: Candidates pass within so many standard deviations of the estimate below the threshold.
DEVIATIONS = 5
#: All members of groups up to this size meet; larger groups are split.
SMALL = 64
#: Members of one large group are held against each other in blocks of this size, with their full sets.
BLOCK = 512
#: A large group's members are numbered in so many parts, squared, at once.
PARTS = 16
#: Partners that one set is held against in a row.
PARTNERS = 256
#: Ids of which a worker remembers that it has emitted their sets.
REMEMBERED = 100_000


class Rule:
    """Shingle length and threshold in hundredths; bands are so wide that a pair at the threshold misses all of them with a chance under 1e-6."""

    def __init__(self, words: int, percent: int) -> None:
        self.words, self.percent = words, percent
        self.rows = next(r for r in range(8, 0, -1) if (1 - (percent / 100) ** r) ** (BUCKETS // r) < 1e-6)
        self.bands = BUCKETS // self.rows

    def linked(self, both: int, union: int) -> bool:
        """The contract's test on full sets."""
        return 100 * both >= self.percent * union


CONTRACT = Rule(3, 85)
#: The pipeline's stage.
STAGE = Rule(5, 80)


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = hashes.of(ws)
    if len(h) < words:
        with np.errstate(over="ignore"):
            return mix(window_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(window_hashes(h, words))


def _probes() -> np.ndarray:
    rng = np.random.default_rng(11)
    return np.array([[j, *rng.permutation([k for k in range(BUCKETS) if k != j])] for j in range(BUCKETS)])


_PROBES = _probes()


def registers(h: np.ndarray) -> np.ndarray:
    """The sketch of sorted shingle hashes: leading zeros and mantissa of each bucket's least, in 16 bits."""
    bits = BUCKETS.bit_length() - 1
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = h[first] << np.uint64(bits)
    # the top 53 bits are exact as a double
    exponent = np.frexp((rest & np.uint64(0xFFFFFFFFFFFFF800)).astype(np.float64))[1]
    zeros = np.where(rest < np.uint64(1 << 11), 53, 64 - exponent).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(BUCKETS, np.uint16)
    full = np.zeros(BUCKETS, bool)
    out[bucket[first]] = (zeros << np.uint64(MANTISSA)) | mantissa
    full[bucket[first]] = True
    return out if full.all() else out[_PROBES[np.arange(BUCKETS), full[_PROBES].argmax(1)]]


@lru_cache(4096)
def chance(a: int, b: int) -> float:
    """Probability that registers of two disjoint sets agree, by their sizes as quarters of a logarithm."""
    zeros = np.arange(1 << ZERO_BITS)[:, None]
    low = (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) * 2.0 ** -(zeros + 1.0)
    high = low + 2.0 ** -(zeros + 1.0 + MANTISSA)
    p = [(1 - low) ** c - (1 - high) ** c for c in (max(1.0, 2 ** (k / 4) / BUCKETS) for k in (a, b))]
    return float((p[0] * p[1]).sum())


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, without those that agree by chance."""
    quarters = lambda n: np.round(4 * np.log2(np.maximum(1, n))).astype(int)
    by_chance = np.array([chance(*sorted(x)) for x in zip(quarters(n_a).tolist(), quarters(n_b).tolist(), strict=True)])
    return (equal / BUCKETS - by_chance) / (1 - by_chance)


def least_estimate(percent: int, n: np.ndarray) -> np.ndarray:
    """The estimate below which a pair is no candidate; small sets fill few buckets, so theirs vary more."""
    j = percent / 100
    filled = BUCKETS * -np.expm1(-np.maximum(1, n) / BUCKETS)
    return j - DEVIATIONS * np.sqrt(j * (1 - j) / filled)


def near(rule: Rule, regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches are candidates; sets of too different sizes cannot be."""
    small_n, large_n = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    out = 100 * small_n >= rule.percent * large_n
    at = np.flatnonzero(out)
    equal = (regs_a[at] == regs_b[at]).sum(1)
    out[at] = estimate(equal, n_a[at], n_b[at]) >= least_estimate(rule.percent, small_n[at])
    return out


def sketch(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, t, n, d1, d2, regs) of (doc_id, t, text): size, 128-bit digest and sketch of each set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            n, d1, d2, regs = [], [], [], []
            for text in part.column(2).to_pylist():
                h = shingles(text, rule.words, hashes)
                with np.errstate(over="ignore"):
                    digest = np.array([mix(h).sum(), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).view(np.int64)
                n.append(len(h))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                regs.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "t", "n", "d1", "d2", "regs"]
            )

    return docs.mapInArrow(run, "doc_id long, t long, n long, d1 long, d2 long, regs binary")


def _grid(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _candidates(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of (a, b, n_a, n_b, regs_a, regs_b) whose estimate passes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                n_a, n_b = (part.column(i).to_numpy() for i in (2, 3))
                yield part.select([0, 1]).filter(pa.array(near(rule, _grid(part.column(4)), _grid(part.column(5)), n_a, n_b)))

    return pairs.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Settled pairs (a, b) with both sketches."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    first = skew_join(pairs, side("a"), ["a"], ["b"])
    return first.join(side("b"), "b")


def _sets(docs: DataFrame, wanted: DataFrame, row_bytes: int, rule: Rule, use, schema: str) -> DataFrame:
    """Rows that ``use`` makes of the sets of wanted classes (doc_id, t, id, ...), each from its whole text.

    Texts are not shuffled while the wanted rows are small. ``use`` takes sets and the wanted rows' further columns; of
    repeated rows a worker uses one.
    """
    fields = [c for c in wanted.columns if c not in ("doc_id", "t")]
    joined = docs.join(F.broadcast(wanted) if row_bytes <= BROADCAST_BYTES else wanted, ["doc_id", "t"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: WordHashes = WordHashes()
        seen: set[int] = set()
        for part in parts:
            rows = part.to_pylist()
            fresh = []
            for r in rows:
                if r["id"] not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(r["id"])
                    fresh.append(r)
            if fresh:
                yield from use([shingles(r["text"], rule.words, hashes) for r in fresh], fresh)

    return joined.select("text", *fields).mapInArrow(run, schema)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Settled pairs (a, b) of settled ones whose full sets, made from their whole texts, are linked.

    Each set is made once and goes once to each of its partners' groups; a set with many partners goes once to every
    PARTNERS of them, and comes before them in its task.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = settle(skew_join(pairs, many, ["a"], ["b"]).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))))
    role = lambda x, kind: dealt.select(F.col(x).alias("id"), F.struct("a", "part", F.lit(kind).alias("kind")).alias("role"))
    roles = role("b", 1).unionByName(role("a", 0).distinct()).groupBy("id").agg(F.collect_list("role").alias("roles"))
    wanted = settle(roles.join(classes.select("id", "doc_id", "t"), "id"))
    size = wanted.agg(F.sum(F.lit(48) + 24 * F.size("roles"))).first()[0] or 0

    def deal(sets: list[np.ndarray], rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for h, r in zip(sets, rows, strict=True):
            k = len(r["roles"])
            cells = [pa.array([x[f] for x in r["roles"]], t) for f, t in (("a", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()))]
            for at in range(0, k, PARTNERS):
                cut = slice(at, min(k, at + PARTNERS))
                m = cut.stop - at
                yield pa.RecordBatch.from_arrays([*(c[cut] for c in cells), pa.array([r["id"]] * m, pa.int64()), pa.array([h.tobytes()] * m, pa.binary())], ["a", "part", "kind", "b", "packed"])

    def hold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for part in parts:
            good = []
            for a, kind, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                other = np.frombuffer(packed, np.uint64)
                if kind == 0:
                    at, own = a, other
                    good.append(False)
                    continue
                assert at == a
                spot = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int((own[spot] == other).sum())
                good.append(rule.linked(both, len(own) + len(other) - both))
            yield part.select([0, 2]).filter(pa.array(good, pa.bool_()))

    packed = _sets(docs, wanted, size, rule, deal, "a long, part long, kind int, b long, packed binary")
    sorted_sets = packed.repartition("a", "part").sortWithinPartitions("a", "part", "kind", "b").select("a", "kind", "b", "packed")
    out = settle(sorted_sets.mapInArrow(hold, "a long, b long").distinct())
    discard(dealt, wanted)
    return out


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Number a group's members by parts of components and ids, then by component, and cut the order into blocks.

    A member's number is the count of the parts before, plus its place in its own part; no task sees a whole group.
    """
    parts = rows.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(PARTS)) * PARTS + F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = parts.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("component", "id")) - 1
    return parts.withColumn("place", place).join(counts, ["key", "part"]).withColumn("block", ((F.col("before") + F.col("place")) / BLOCK).cast("int")).drop("part", "place", "before")


PAIRS = "a long, b long, sure boolean"


def _across(ids: np.ndarray, comp: np.ndarray, pos: np.ndarray, n: np.ndarray, regs: np.ndarray, rule: Rule, x: int, ys: np.ndarray) -> np.ndarray:
    """Of members ys of a group, those in other components than x whose sketches come near that of x.

    ``pos`` is the place of the group's shingle among a member's, rarest first (-1: not known). Sets that reach the
    threshold share at least so many, and so one of the others that are left from their first shared one on.
    """
    ys = ys[comp[ys] != comp[x]]
    shared = -(-rule.percent * (n[ys] + n[x]) // (100 + rule.percent))
    ys = ys[(pos[x] <= n[x] - shared) & (pos[ys] <= n[ys] - shared)]
    return ys[near(rule, np.broadcast_to(regs[x], (len(ys), BUCKETS)), regs[ys], np.full(len(ys), n[x]), n[ys])] if len(ys) else ys


def _pairs(a: list[int], b: list[int], sure: bool) -> dict[str, pa.Array]:
    return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array([sure] * len(a), pa.bool_())}


def _meet(groups: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Settled pairs (a, b, sure) across components in settled groups (key, id, component, pos) that hold several.

    Groups up to SMALL pass through a task in order, and pairs whose estimate passes are not sure. Larger ones go in
    blocks, of which pairs with one and the same component are left out; their links are counted on full sets.
    """
    shape = groups.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "members")
    rows = settle(skew_join(groups, shape, ["key"], ["id"]))
    sketches = classes.select("id", "n", "regs")

    def pass_by(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def pairs() -> pa.RecordBatch:
            ids, comp, pos, n = (np.array([r[i] for r in held], np.int64) for i in (1, 2, 3, 4))
            regs = np.frombuffer(b"".join(r[5] for r in held), np.uint16).reshape(-1, BUCKETS)
            a, b = [], []
            for x in range(len(held) - 1):
                ys = _across(ids, comp, pos, n, regs, rule, x, np.arange(x + 1, len(held)))
                a += np.minimum(ids[ys], ids[x]).tolist()
                b += np.maximum(ids[ys], ids[x]).tolist()
            return pa.RecordBatch.from_pydict(_pairs(a, b, False))

        for part in parts:
            for row in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != key:
                    if len(held) > 1:
                        yield pairs()
                    key, held = row[0], []
                held.append(row)
        if len(held) > 1:
            yield pairs()

    few = rows.where(F.col("members") <= SMALL).select("key", "id", "component", "pos").join(sketches, "id")
    out = few.repartition("key").sortWithinPartitions("key", "id").select("key", "id", "component", "pos", "n", "regs").mapInArrow(pass_by, PAIRS)
    large = rows.where(F.col("members") > SMALL).select("key", "id", "component", "pos")
    if large.isEmpty():
        found = settle(out.distinct())
        discard(rows)
        return found

    def pack(sets: list[np.ndarray], rows: list[dict]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["id", "packed"])

    wanted = settle(large.select("id").distinct().join(classes.select("id", "doc_id", "t"), "id"))
    packed = settle(_sets(docs, wanted, wanted.count() * 48, rule, pack, "id long, packed binary").dropDuplicates(["id"]).join(sketches, "id"))
    numbered = settle(_in_blocks(large))
    ends = numbered.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left, right = (ends.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high"))) for x in "ij")
    tasks = settle(left.join(right, "key").where("block_i <= block_j and not (low_i = high_i and low_j = high_j and low_i = low_j)").select("key", "block_i", "block_j"))
    both = tasks.select("key", "block_i", "block_j", F.col("block_i").alias("block")).unionByName(tasks.where("block_i < block_j").select("key", "block_i", "block_j", F.col("block_j").alias("block")))
    members = skew_join(numbered, both, ["key", "block"], ["id"]).join(packed, "id")

    def run(table: pa.Table) -> pa.Table:
        ids, comp, pos, n, block = (table.column(c).to_numpy() for c in ("id", "component", "pos", "n", "block"))
        regs = _grid(table.column("regs").combine_chunks())
        sets = [np.frombuffer(x, np.uint64) for x in table.column("packed").to_pylist()]
        i, j = (table.column(c)[0].as_py() for c in ("block_i", "block_j"))
        rows_i, rows_j = np.flatnonzero(block == i), np.flatnonzero(block == j)
        comp = comp.copy()  # becomes that of the links found so far
        a, b = [], []
        for x in rows_i:
            ys = _across(ids, comp, pos, n, regs, rule, x, rows_j if i != j else rows_j[ids[rows_j] > ids[x]])
            if not len(ys):
                continue
            others, sizes = np.concatenate([sets[y] for y in ys]), n[ys]
            spot = np.minimum(np.searchsorted(sets[x], others), len(sets[x]) - 1)
            shared = np.add.reduceat((sets[x][spot] == others).astype(np.int64), np.cumsum(sizes) - sizes)
            for y in ys[100 * shared >= rule.percent * (n[x] + sizes - shared)]:
                if comp[y] != comp[x]:
                    comp[comp == comp[y]] = comp[x]
                    a.append(int(min(ids[x], ids[y])))
                    b.append(int(max(ids[x], ids[y])))
        return pa.table(_pairs(a, b, True))

    found = settle(out.unionByName(members.groupBy("key", "block_i", "block_j").applyInArrow(run, PAIRS)).distinct())
    discard(rows, wanted, packed, numbered, tasks)
    return found


def _rarest(members: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Settled (key, id, component, pos): settled members (id, component) under each of their rarest shingles that another has.

    A set of n needs its n - ceil(t * n) + 1 rarest; shingles are as rare as few members have them, and all members
    rank them alike.
    """

    def spread(sets: list[np.ndarray], rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for h, r in zip(sets, rows, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), r["id"], np.int64)), pa.array(h.view(np.int64))], ["id", "key"])

    wanted = settle(members.select("id").join(classes.select("id", "doc_id", "t"), "id"))
    held = settle(_sets(docs, wanted, wanted.count() * 48, rule, spread, "id long, key long").distinct())
    counts = held.groupBy("key").agg(F.count("*").alias("uses")).where("uses > 1")
    used = skew_join(held, counts, ["key"], ["id"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("uses", "key"))).alias("by"))
    n, p = F.col("n"), F.lit(rule.percent)
    alone = n - F.size("by")  # shingles that no other member has come first in every order
    prefix = n - F.ceil(n * p / 100) + 1 - alone
    keys = used.join(classes.select("id", "n"), "id").withColumn("prefix", prefix.cast("int")).where("prefix > 0")
    keyed = keys.select("id", alone.alias("alone"), F.posexplode(F.slice("by", F.lit(1), F.col("prefix"))).alias("i", "x")).select("id", F.col("x.key").alias("key"), (F.col("alone") + F.col("i")).alias("pos"))
    out = settle(keyed.join(members, "id").select("key", "id", "component", "pos"))
    discard(wanted, held)
    return out


def _crossing(rows: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Settled linked pairs (a, b) across components in settled buckets (key, id, component, members).

    Of the links between two components, one at least is named.
    """
    few = settle(rows.where(F.col("members") <= SMALL).select("key", "id", "component", F.lit(-1).cast("long").alias("pos")))
    out = _meet(few, classes, docs, rule)
    many = settle(rows.where(F.col("members") > SMALL).select("id", "component").distinct())
    if not many.isEmpty():
        shared = _rarest(many, classes, docs, rule)
        more = _meet(shared, classes, docs, rule)
        both = settle(out.unionByName(more).distinct())
        discard(shared, out, more)
        out = both
    likely = settle(out.where("not sure").select("a", "b").distinct())
    found = verified(likely, docs, classes, rule)
    links = settle(found.unionByName(out.where("sure").select("a", "b")).distinct())
    discard(few, many, out, likely, found)
    return links


def clustered(docs: DataFrame, rule: Rule) -> DataFrame:
    """Settled (doc_id, t, n, d1, d2, component, least) of rows (doc_id, t, text), in any order.

    ``component`` numbers the linked rows that have an id and words, and is null for others; ``least`` is the
    component's least doc_id.
    """
    batches(docs.sparkSession)
    sets = settle(sketch(docs, rule).withColumn("rid", F.monotonically_increasing_id()))
    named = sets.where("doc_id is not null and n > 0")
    known = settle(named.groupBy("n", "d1", "d2").agg(F.min("rid").alias("id"), F.min("doc_id").alias("least")))
    classes = settle(sets.join(known.select("id"), F.col("rid") == F.col("id")).select("id", "doc_id", "t", "n", "regs"))

    width = 2 * rule.rows
    band = F.posexplode(F.array(*(F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(rule.bands))))
    bands = settle(classes.select("id", band.alias("band", "key")))
    shared = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("first")).where("members > 1")
    buckets = settle(skew_join(bands, shared, ["key"], ["id"]).select("key", "id", "members", "first"))
    discard(bands)
    pairs = settle(buckets.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    passed = settle(_candidates(_sketched(pairs, classes), rule))
    edges = verified(passed, docs, classes, rule)
    tied = components(edges)
    discard(pairs, passed)

    wide = settle(buckets.where("members > 2").select("key", "id", "members"))
    placed = settle(wide.join(tied, "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_rows = settle(skew_join(placed, mixed, ["key"], ["id"]))
    discard(buckets, wide, placed)
    crossing = _crossing(open_rows, classes, docs, rule)
    discard(open_rows)
    if not crossing.isEmpty():
        both = settle(edges.unionByName(crossing))
        discard(edges, tied)
        edges, tied = both, components(both)
    discard(crossing, edges)

    each = settle(known.join(tied, "id", "left").withColumn("component", F.coalesce("component", "id")))
    whole = each.groupBy("component").agg(F.min("least").alias("least"))
    ends = settle(skew_join(each.drop("least"), whole, ["component"], ["id"]).select("n", "d1", "d2", "component", "least"))
    rows = settle(named.select("doc_id", "t", "n", "d1", "d2", "rid"))
    tagged = skew_join(rows, ends, ["n", "d1", "d2"], ["rid"])
    alone = sets.where("doc_id is null or n = 0").select("doc_id", "t", "n", "d1", "d2", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("least"))
    out = settle(tagged.select(*alone.columns).unionByName(alone))
    discard(sets, known, classes, tied, each, ends, rows)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def duplicates(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    found = clustered(_texts(docs), rule)
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("least"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), kept.alias("kept"))


def dedup(docs: DataFrame, rule: Rule = STAGE) -> DataFrame:
    """The documents that are kept, one row of each component, with all their columns.

    The row of the least (doc_id, text digest) stays; of rows that agree in both, the one whose columns hash to the
    least. What to drop is joined to the texts without a shuffle of texts while it is small.
    """
    found = clustered(_texts(docs), rule)
    linked = found.where("component is not null")
    by_text = settle(linked.groupBy("component", "doc_id", "t").agg(F.count("*").alias("copies")))
    first = by_text.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    judged = settle(skew_join(by_text, first, ["component"], ["doc_id", "t"]).withColumn("stays", F.struct("doc_id", "t") == F.col("first")).select("doc_id", "t", "copies", "stays"))
    key_id, key_t = unused(docs, "quarry_id", "quarry_t")
    keyed = docs.withColumns({key_id: F.col("doc_id").cast("long"), key_t: F.xxhash64(F.col("text").cast("string"))})
    named = lambda rows: settle(rows.select(F.col("doc_id").alias(key_id), F.col("t").alias(key_t)))
    dropped, repeated = named(judged.where("not stays")), named(judged.where("stays and copies > 1"))
    discard(found, by_text, judged)
    kept = keyed.join(small(dropped, 32), [key_id, key_t], "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = kept.join(small(repeated, 32), [key_id, key_t], "left_semi").groupBy(key_id, key_t)
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    return kept.join(small(repeated, 32), [key_id, key_t], "left_anti").select(*docs.columns).unionByName(again.agg(row).select("row.*"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n na ON na.doc_id = x.doc_id JOIN n nb ON nb.doc_id = y.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach(node, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), c AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON d.doc_id = c.node
"""
