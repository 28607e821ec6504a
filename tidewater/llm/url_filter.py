"""URL filters: a sorted array of 64-bit xxhash digests, memory-mapped by executors and probed by binary search."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import LOWER, raw, slices

#: The production rules (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: An index over this many bytes isn't shipped to executors.
MAX_INDEX_BYTES = 512 << 20


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z folded) and path; both empty without `://`."""
    _, mark, rest = (url or b"").partition(b"://")
    if not mark:
        return b"", b""
    end = min((i for i in (rest.find(c) for c in (b"/", b"?", b"#")) if i >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((i for i in (tail.find(c) for c in (b"?", b"#")) if i >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:cut]


class DigestIndex:
    """Rules by digest of `host path`: three memory-mapped arrays and the rules' full strings.

    A probe is one vectorised binary search; a hit counts only if the stored host and path equal the probe's, so
    two strings with one digest can't be confused (equal digests stand side by side and are all looked at).
    """

    def __init__(self, folder: str, prefix: str):
        at = lambda part: os.path.join(folder, f"{prefix}.{part}")
        self.digests = np.memmap(at("digests"), np.uint64, "r")
        self.offsets = np.memmap(at("offsets"), np.int64, "r")
        self.strings = np.memmap(at("strings"), np.uint8, "r")
        self.lengths = np.fromfile(at("lengths"), np.int64)

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]], folder: str, prefix: str) -> list[str]:
        """Write the arrays; the last rule for a host and path wins. Returns the files' paths."""
        kept: dict[bytes, bytes] = {}
        lengths: set[int] = set()
        for verdict, host, path in rules:
            kept[host.encode().translate(LOWER) + b" " + path.encode()] = verdict.encode()
            lengths.add(len(path.encode()))
        keyed = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in kept.items())
        blobs = [v + b" " + k for _, k, v in keyed]
        parts = {
            "digests": np.array([d for d, _, _ in keyed] or [0], np.uint64),
            "offsets": np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64),
            "strings": np.frombuffer(b"".join(blobs) or b" ", np.uint8),
            "lengths": np.array(sorted(lengths), np.int64),
        }
        paths = []
        for part, values in parts.items():
            paths.append(os.path.join(folder, f"{prefix}.{part}"))
            values.tofile(paths[-1])
        return paths

    def lookup(self, keys: list[bytes]) -> list[bytes | None]:
        """The verdict of each key `host path`, or None."""
        out: list[bytes | None] = [None] * len(keys)
        n = len(self.offsets) - 1
        if not keys or not n:
            return out
        probes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests[:n], probes)
        for i in np.flatnonzero(self.digests[np.minimum(at, n - 1)] == probes):
            j = int(at[i])
            while j < n and self.digests[j] == probes[i]:
                verdict, _, stored = self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes().partition(b" ")
                if stored == keys[i]:
                    out[i] = verdict
                    break
                j += 1
        return out


def probes_of(host: bytes, path: bytes, lengths) -> list[bytes]:
    """All `host path` keys that a rule for this url can have, the longest rule first (ties: the longer host)."""
    if not host:
        return []
    ends = [host]
    while b"." in ends[-1]:
        ends.append(ends[-1].partition(b".")[2])
    keys = [(len(h) + n, len(h), h + b" " + path[:n]) for h in ends for n in lengths if n <= len(path)]
    return [k for _, _, k in sorted(keys, reverse=True)]


def judge_batch(urls: list[bytes | None], index: DigestIndex) -> list[tuple]:
    parts = [split_url(u) for u in urls]
    distinct = {p: None for p in parts}
    lengths = [int(n) for n in index.lengths]
    spans, keys = {}, []
    for p in distinct:
        mine = probes_of(*p, lengths)
        spans[p] = (len(keys), len(keys) + len(mine))
        keys += mine
    verdicts = index.lookup(keys)
    for p, (a, b) in spans.items():
        hit = next((i for i in range(a, b) if verdicts[i] is not None), None)
        distinct[p] = (None, "allow") if hit is None else (keys[hit].replace(b" ", b"", 1).decode("utf-8", "replace"), verdicts[hit].decode())
    return [(h.decode("utf-8", "replace"), q.decode("utf-8", "replace"), *distinct[h, q]) for h, q in parts]


SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_ARROW = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))])


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: host, path, the longest rule that fits, and the verdict.

    Null urls and urls without `://` have an empty host and path, no rule and the default verdict. Where no rule
    fits, the default verdict holds. Null ids and repeated rows stay. Very long urls are probed whole. Rules of one length (a
    tie) go to the one with the longer host. Extra columns play no part, whatever their names. An empty table: no rows. The index (checked against MAX_INDEX_BYTES)
    goes to every executor once, through Spark's file distribution, and is memory-mapped there; the pass is narrow.
    """
    spark: SparkSession = pages.sparkSession
    rules = tuple(rules)
    size = sum(len(h) + len(p) + 32 for _, h, p in rules)
    if size > MAX_INDEX_BYTES:
        raise ValueError(f"the rules take {size} bytes; an index may have {MAX_INDEX_BYTES}")
    prefix = "urlindex-" + hashlib.sha256(repr(rules).encode()).hexdigest()[:16]
    for path in DigestIndex.build(rules, tempfile.mkdtemp(prefix="tidewater-"), prefix):
        if os.path.basename(path) not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
            spark.sparkContext.addFile(path)

    def run(batches):
        index = DigestIndex(SparkFiles.getRootDirectory(), prefix)
        for batch in slices(batches):
            rows = judge_batch(raw(batch.column(1)), index)
            columns = list(zip(*rows)) if rows else [[]] * 4
            verdicts = [default if r is None else v for r, v in zip(columns[2], columns[3])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in (*columns[:3], verdicts))], schema=_ARROW)

    from pyspark.sql import functions as F

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, SCHEMA)
