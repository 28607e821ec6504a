"""SimHash near-dedup: fingerprints by numpy bit sums, then an exact tiled comparison of distinct fingerprints.

A tile holds fingerprints with the same population counts in each of a few parts of the word. Fingerprints of two tiles
differ in as many bits as these counts do, at least: so a pair of tiles whose counts differ by more than the radius in
all is skipped, and all other pairs are compared by exclusive-or and bit counts.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import LOWER, documents_of, raw, routed, slices, stash
from tidewater.llm.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a tile, about; tiles of more are parted by a hash.
TILE = 4096
#: Parts of the word whose bits are counted. More parts skip more pairs of tiles, and pay once tiles are full: a division
#: is used when there are so many distinct fingerprints. The links are the same under each.
PARTS = ((0, 2), (50_000, 4), (2_000_000, 6), (50_000_000, 8))

_U = np.uint64
#: Shingles whose bits are summed at a time, and cells of a tile pair that are compared at a time.
_SUMMED, _CELLS = 1 << 15, 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the lower-cased text's word shingles, repeats included: a bit is set if it is in over half of the
    shingles' XXH64. Fewer words than a shingle: the whole sequence; none: 0."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), _SUMMED):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[at : at + _SUMMED], last[at : at + _SUMMED])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            values = np.array([fingerprint(t, shingle, seed) for t in raw(batch.column(1))], _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], schema=schema)

    return run


def part_counts(values: np.ndarray, parts: int) -> np.ndarray:
    """The population counts of parts of each word, of the same number of bits or one more, a byte for each part."""
    out = np.zeros(len(values), _U)
    for i in range(parts):
        low, high = 64 * i // parts, 64 * (i + 1) // parts
        out |= np.bitwise_count((values >> _U(low)) & _U((1 << high - low) - 1)).astype(_U) << _U(8 * i)
    return out


def _counted(parts: int):
    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part_counts(values, parts).view(np.int64))], names=["fp", "counts"])

    return run


def steps(parts: int, radius: int) -> list[int]:
    """The differences between the counts of two tiles that aren't skipped, one of each pair of opposite ones, as numbers
    to be added. A byte that would fall below 0 or rise too far makes a number that no tile has."""
    one = range(-radius, radius + 1)
    near: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        near = [(*d, x) for d, x in product(near, one) if sum(map(abs, d)) + abs(x) <= radius]
    whole = ((sum(x << (8 * i) for i, x in enumerate(d)) + (1 << 63)) % (1 << 64) - (1 << 63) for d in near if d >= (0,) * parts)
    return sorted(whole)


def linked(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what fingerprints of two tiles at a distance of at most `radius` join: every pair is compared,
    but each fingerprint is only linked with the least one of its component here, so there are no more links than rows."""
    values = np.concatenate([left, right])
    label = np.arange(len(values))
    for at in range(0, len(left), step := max(1, _CELLS // max(1, len(right)))):
        hits = np.flatnonzero(np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius)
        i, j = hits // len(right) + at, hits % len(right) + len(left)
        while len(i) and (odd := label[i] != label[j]).any():
            i, j = i[odd], j[odd]
            low = np.minimum(label[i], label[j])
            high = np.maximum(label[i], label[j])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero((label != np.arange(len(values))) & (values != values[label]))
    return values[moved], values[label[moved]]


def _compared(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            a, b = [np.empty(0, _U)], [np.empty(0, _U)]
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = linked(left.values.to_numpy().view(_U), right.values.to_numpy().view(_U), radius)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], schema=schema)

    return run


def links(fingerprints: DataFrame, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """a, b: links between the distinct fingerprints of a written table (column fp), whose components are those of all
    pairs at a distance of at most `radius`.

    Each pair of tiles that isn't skipped is a row with both tiles' fingerprints, and a task's unit of work: at most
    about tile * tile comparisons, whatever the tiles' counts have in common. Tiles meet by equality of counts, so no
    cross join arises.
    """
    n = fingerprints.count()
    parts = parts or max(p for least, p in PARTS if n >= least)
    placed = stash(fingerprints.select("fp").mapInArrow(_counted(parts), "fp long, counts long"), "sim-counts")
    sizes = placed.groupBy("counts").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("shares"))
    shared = placed.join(sizes, "counts").withColumn("share", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int"))
    tiles = stash(shared.groupBy("counts", "share").agg(F.collect_list("fp").alias("fps")), "sim-tiles")
    near = F.explode(F.array(*(F.lit(s) for s in steps(parts, radius))).cast("array<long>"))
    left = tiles.select(F.col("counts").alias("own"), F.col("share").alias("own_share"), F.col("fps").alias("left"), near.alias("step"))
    left = left.select("own", "own_share", "left", F.try_add("own", "step").alias("counts"))
    pairs = left.join(tiles.withColumnRenamed("fps", "right"), "counts").filter("counts <> own or share >= own_share").select("left", "right")
    return pairs.mapInArrow(_compared(radius), "a long, b long")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable over links), for every
    input row. Fingerprints link at `radius` or fewer differing bits.

    Documents of one fingerprint are counted once, with partial aggregation; distinct ones are compared tile by tile
    (see links). Each comparison links a fingerprint at most once, so copies and dense groups aren't expanded into
    pairs. Components come back to the documents by a join that only documents with company enter, and that can be split.

    Null or empty texts, and texts without words, have fingerprint zero and are linked like others. Rows without an id
    have a fingerprint, are linked with nothing and have no component_id. Rows that share an id count as linked, each
    with the links of its own fingerprint. Ties (a bit in just half of the shingles) give 0. Very long texts are
    taken whole. Extra columns play no part, whatever their names. An empty table gives none.
    """
    base = stash(documents_of(docs, id_col, text_col).mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long"), "sim-base")
    named = base.filter("doc_id is not null")
    classes = stash(named.groupBy("fp").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "sim-classes")
    ids = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("other")).filter("a < other").select("doc_id", "a")
    same_id = named.join(ids, "doc_id").select("a", F.col("fp").alias("b")).filter("a <> b")
    found = stash(links(classes.select("fp"), radius, parts, tile).unionByName(same_id).distinct(), "sim-links")
    comp = connected_components(found)
    joined = classes.join(comp.select(F.col("node").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = joined.groupBy("comp").agg(F.min("low").alias("component_id"), F.max("high").alias("high")).filter("component_id < high")
    marks = stash(joined.join(least.select("comp", "component_id"), "comp").select("fp", "component_id"), "sim-marks")
    out = routed(base, marks, "fp")
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", fp.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
