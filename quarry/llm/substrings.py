"""Substring dedup by relative Lempel-Ziv parsing.

All documents stand in one space of addresses, each at the hash of its row and its windows of W words one after the
other. Every document is cut into blocks at content-defined anchors: of each window, the run of Q words with the least hash is
its anchor, and consecutive windows of one anchor form a block, so that each window is in one block. The blocks are
indexed as references, by anchor and whole content, with the least address at which each stands.

A document is parsed into factors greedily: a factor starts at a block that the index holds elsewhere and takes
block after block while the next one stands next in the same reference; where it does not, a new factor begins. Blocks hold
whole windows, so a factor has W words or more, and its words become a duplicate span. Factors end at blocks that stand nowhere else as a
whole. Where such a block's anchor is known, its windows are checked one by one against those of all references with
that anchor, and those found extend the factors.

Equal windows have equal anchors at equal places, so each repeated window is found, wherever the block around it
ends, and each is found by content (two independent 64-bit hashes must agree).

Defined results: a null, empty or short text loses nothing; windows that repeat within one document count; equal
rows of W words or more lose all words; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WordHashes, batches, discard, settle, skew_join, window_hashes

W, Q = 35, 8


def blocks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's word hashes: anchors' hashes, blocks' hashes, first and last windows, and anchors' places."""
    if len(h) < W:
        none = np.empty(0, np.int64)
        return h[:0], h[:0], none, none, none
    grams, windows = window_hashes(h, Q), window_hashes(h, W)
    at = np.lib.stride_tricks.sliding_window_view(grams, W - Q + 1).argmin(1) + np.arange(len(windows))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place = at[first]
    with np.errstate(over="ignore"):
        shape = ((place - first) * 64 + (last - first)).astype(np.uint64)
        whole = (windows[first] * np.uint64(0x9E3779B97F4A7C15) ^ windows[last]) * np.uint64(0xC2B2AE3D27D4EB4F) + shape
        whole ^= whole >> np.uint64(32)
    return grams[place], whole, first, last, place


def pack(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A block's place in its document as one integer."""
    return (first << 16) | ((last - first) << 8) | (place - first)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def index(docs: DataFrame) -> DataFrame:
    """(anchor, block, rid, pos) of all blocks of (rid, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            found = []
            for rid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if len(words) >= W:
                    anchor, block, first, last, place = blocks(hashes.of(words))
                    found.append((anchor, block, np.full(len(anchor), rid, np.int64), pack(first, last, place)))
            if found:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(x)) for x in zip(*found, strict=True)], ["anchor", "block", "rid", "pos"])

    return docs.mapInArrow(run, "anchor long, block long, rid long, pos long")


def boundary_windows(docs: DataFrame) -> DataFrame:
    """(anchor, window, n, rid, at) of the windows in blocks to check, of (rid, text, single, repeated)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            found = []
            for rid, text, single, repeated in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                h = hashes.of((text or "").encode("utf-8", "surrogatepass").split())
                windows, grams = window_hashes(h, W), window_hashes(h, Q)
                places = np.array([*(single or ()), *(repeated or ())], np.int64)
                first, sizes = places >> 16, (places >> 8 & 255) + 1
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) - np.repeat(ends - sizes - first, sizes)
                n = np.repeat(np.where(np.arange(len(places)) < len(single or ()), 1, 2), sizes)
                found.append((np.repeat(grams[first + (places & 255)], sizes), windows[at], n, np.full(len(at), rid), at))
            if found:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(x)) for x in zip(*found, strict=True)], ["anchor", "window", "n", "rid", "at"])

    return docs.mapInArrow(run, "anchor long, window long, n long, rid long, at long")


def _with_texts(docs: DataFrame, marks: DataFrame, row_bytes: int, how: str) -> DataFrame:
    """Join texts with settled marks, without a shuffle of texts if the marks are small."""
    return docs.join(F.broadcast(marks) if row_bytes <= BROADCAST_BYTES else marks, "rid", how)


def factors(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy factors (first window, last window, reference) of a document's blocks that stand elsewhere, in order.

    A factor goes on as long as the document's next block is the next one and stands next in the reference as well.
    """
    out: list[tuple[int, int, int]] = []
    for first, last, ref in blocks:
        if out:
            begun, end, where = out[-1]
            if first == end + 1 and ref - where == first - begun:
                out[-1] = (begun, last, where)
                continue
        out.append((first, last, ref))
    return out


def parsed(rows: DataFrame) -> DataFrame:
    """(rid, runs): factors of (rid, blocks) and single windows of (rid, ..., windows), merged, as first << 32 | last."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for blocks, windows in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                found = factors(sorted((b["first"], b["last"], b["ref"]) for b in blocks))
                merged: list[list[int]] = []
                for first, last in sorted([*((f, e) for f, e, _ in found), *((w, w) for w in windows)]):
                    if merged and first <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], last)
                    else:
                        merged.append([first, last])
                out.append([first << 32 | last for first, last in merged])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], ["rid", "runs"])

    return rows.select("rid", "blocks", "windows").mapInArrow(run, "rid long, runs array<bigint>")


def spans(docs: DataFrame) -> DataFrame:
    """(rid, runs): for documents (rid, text) with duplicates, runs of duplicated windows as first << 32 | last.

    Lists of blocks and windows are sets of one document's, however many equal rows it has.
    """
    found = settle(index(docs))
    refs = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    near = settle(skew_join(found, refs, ["anchor"], ["rid", "pos"]))
    discard(found)
    first = F.shiftright("pos", 16)
    address = F.col("rid") + first
    blocks_of = near.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(address).alias("least"), F.max(address).alias("most"))
    varied = blocks_of.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").withColumn("varied", F.lit(True)).drop("k")
    whole = blocks_of.where("n > 1").drop("n").join(varied, "anchor", "left")
    judged = settle(skew_join(near, whole, ["anchor", "block"], ["rid", "pos"], "left").select("rid", "pos", "least", "most", "varied"))
    discard(near)
    last = first + F.shiftright("pos", 8).bitwiseAND(F.lit(255))
    ref = F.when(F.col("least") == address, F.col("most")).otherwise(F.col("least"))
    dup = judged.where("least is not null").select("rid", F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), ref.alias("ref")).alias("block"), F.lit(None).cast("long").alias("at"))
    check = settle(
        judged.where(F.col("least").isNull() | (F.col("varied") & (F.col("least") == address)))
        .groupBy("rid")
        .agg(F.collect_set(F.when(F.col("least").isNull(), F.col("pos"))).alias("single"), F.collect_set(F.when(F.col("least").isNotNull(), F.col("pos"))).alias("repeated"))
    )
    size = check.agg(F.sum(F.lit(64) + 8 * (F.size("single") + F.size("repeated")))).first()[0] or 0
    windows = settle(boundary_windows(_with_texts(docs, check, size, "inner").select("rid", "text", "single", "repeated")))
    discard(check)
    twice = windows.groupBy("anchor", "window").agg(F.sum("n").alias("all")).where("`all` > 1").drop("all")
    once = settle(windows.where("n = 1").drop("n"))
    more = skew_join(once, twice, ["anchor", "window"], ["rid", "at"]).select("rid", F.lit(None).cast(dup.schema["block"].dataType).alias("block"), "at")
    grouped = dup.unionByName(more).groupBy("rid").agg(F.collect_set("block").alias("blocks"), F.collect_set("at").alias("windows"))
    out = settle(parsed(grouped))
    discard(judged, windows, once)
    return out


def covered(n: int, runs: list[int]) -> np.ndarray:
    """Whether each of n words is in a duplicated window."""
    x = np.array(runs, np.int64)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, x >> 32, 1)
    np.add.at(steps, (x & 0xFFFFFFFF) + W, -1)
    return np.cumsum(steps)[:n] > 0


def _prepared(docs: DataFrame) -> DataFrame:
    # the address of a document: half the range, so that no window's address leaves it
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.shiftright(F.xxhash64(F.col("doc_id").cast("long"), text), 1).alias("rid"))


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row of SCHEMA for each document; without texts, kept_text is null."""
    batches(docs.sparkSession)
    rows = _prepared(docs)
    marks = spans(rows.select("rid", "text"))
    size = marks.agg(F.sum(F.lit(64) + 8 * F.size("runs"))).first()[0] or 0

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept = words
                if runs:
                    kept = [w for w, gone in zip(words, covered(len(words), runs).tolist(), strict=True) if not gone]
                body = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body.decode("utf-8", "surrogatepass") if texts else None))
            columns = [[r[i] for r in out] for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], [x.split()[0] for x in SCHEMA.split(", ")]
            )

    return _with_texts(rows, marks, size, "left").select("doc_id", "text", "runs").mapInArrow(run, SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    return remove(docs, texts=False).drop("kept_text")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), twice AS (
  SELECT s FROM win GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (s))
), words AS (
  SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), kept AS (
  SELECT w.rid, count(*) AS n, string_agg(word, ' ' ORDER BY w.p) AS body FROM words w ANTI JOIN gone g ON w.rid = g.rid AND w.p = g.p GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
