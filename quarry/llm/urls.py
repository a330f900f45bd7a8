"""URL filters over a sorted array of digests.

Rules are kept in one file: their 64-bit xxhash keys in order, then offsets and the full strings. The file is written to
the shared folder, goes to every executor by Spark's file distribution and is memory-mapped there, so that its pages
are read as probes need them. A batch of urls is probed at once by binary search, for as many labels of a host as rules
have, and each hit is confirmed on the stored string.

A rule is a host and the start of a path, as ``example.com/en/``. It fits its host and all subdomains. The longest
rule that fits wins; a url that none fits is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; ports and user
names stay in the host; of equal rules the last counts; equal rows get equal verdicts; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, scratch

# The rules of the registered query.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
DEFAULT = "allow"
MAGIC = b"quarryu2"

_HOST = re.compile(r"://([^/?#]*)([^?#]*)")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(url: str | None) -> tuple[str, str]:
    """Host, lower-cased in A-Z, and path."""
    m = _HOST.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def build(rules: Iterable[tuple[str, str]]) -> bytes:
    """The index file: header, keys in order, offsets, path lengths and label counts in use, verdicts, strings."""
    last = dict(rules)
    keyed = sorted((xxhash.xxh64_intdigest(r), r.encode(), v) for r, v in last.items())
    keys = np.array([k for k, _, _ in keyed], np.uint64)
    block = np.array([v == "block" for _, _, v in keyed], np.uint8)
    offsets = np.cumsum([0, *(len(r) for _, r, _ in keyed)]).astype(np.uint64)
    lengths = np.array(sorted({len(r.partition("/")[2]) + 1 for r in last}), np.uint64)
    labels = np.array(sorted({r.partition("/")[0].count(".") + 1 for r in last}), np.uint64)
    head = np.array([len(keys), len(lengths), len(labels)], np.uint64)
    return MAGIC + head.tobytes() + keys.tobytes() + offsets.tobytes() + lengths.tobytes() + labels.tobytes() + block.tobytes() + b"".join(r for _, r, _ in keyed)


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        if bytes(raw[:8]) != MAGIC:
            raise ValueError(f"{path} is no url index")
        n, m, k = (int(x) for x in raw[8:32].view(np.uint64))
        cut = np.cumsum([32, 8 * n, 8 * (n + 1), 8 * m, 8 * k, n])
        self.keys, self.offsets, self.lengths, self.labels = (raw[a:b].view(np.uint64) for a, b in zip(cut[:4], cut[1:5], strict=True))
        self.block, self.strings = raw[cut[4] : cut[5]], raw[cut[5] :]

    def rules(self, probes: list[str]) -> list[int]:
        """The number of the rule that equals each probe, or -1."""
        if not probes or not len(self.keys):
            return [-1] * len(probes)
        want = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        first, end = np.searchsorted(self.keys, want), np.searchsorted(self.keys, want, "right")
        out = np.full(len(probes), -1)
        for i in np.flatnonzero(first < end):
            x = probes[i].encode("utf-8", "surrogatepass")
            out[i] = next((k for k in range(first[i], end[i]) if self.text(k) == x), -1)
        return out.tolist()

    def text(self, k: int) -> bytes:
        """The stored string of a rule."""
        return self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes()

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """Host, path, rule and verdict of each url of a batch."""
        parsed, probes, owner = [parse(u) for u in urls], [], []
        lengths, counts = self.lengths.tolist(), self.labels.tolist()
        for i, (host, path) in enumerate(parsed):
            if host and counts:
                labels = host.rsplit(".", counts[-1])  # what is left of these, no rule names
                whole = len(labels) if len(labels) <= counts[-1] else counts[-1]
                starts = [path[: int(n)] for n in lengths if n <= len(path)]
                for k in counts:
                    if k <= whole:
                        suffix = ".".join(labels[-k:])
                        probes += [suffix + s for s in starts]
                        owner += [i] * len(starts)
        best: dict[int, tuple[int, int]] = {}
        for i, p, k in zip(owner, probes, self.rules(probes), strict=True):
            if k >= 0:
                best[i] = max(best.get(i, (-1, -1)), (len(p), k))
        return [(*x, self.text(best[i][1]).decode(), "block" if self.block[best[i][1]] else "allow") if i in best else (*x, None, DEFAULT) for i, x in enumerate(parsed)]


_sent: dict[tuple[str, str], str] = {}


def distribute(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Hand the index to all executors, present and future; returns its name there."""
    body = build(rules)
    name = f"quarry-urls-{hashlib.sha256(body).hexdigest()[:24]}.bin"
    app = spark.sparkContext.applicationId
    if (app, name) not in _sent:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/{name}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        for i in range(0, len(body), 1 << 20):
            out.write(bytearray(body[i : i + (1 << 20)]))
        out.close()
        spark.sparkContext.addFile(at.toString())
        _sent[app, name] = at.toString()
    return name


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def verdicts(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """One row of SCHEMA for each page."""
    batches(pages.sparkSession)
    name = distribute(pages.sparkSession, rules)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for part in parts:
            rows = index.judge(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in range(4))], [x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, SCHEMA)


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM parts
), rules(rule, host_r, path_r, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
)
SELECT s.page_id, s.host, s.path, arg_max(r.rule, length(r.rule)) AS rule, coalesce(arg_max(r.verdict, length(r.rule)), 'allow') AS verdict
FROM (SELECT *, row_number() OVER () AS nr FROM split) s
LEFT JOIN rules r ON (s.host = r.host_r OR ends_with(s.host, '.' || r.host_r)) AND starts_with(s.path, r.path_r)
GROUP BY s.nr, s.page_id, s.host, s.path
"""
