"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

The sketch is that of Dahlgaard, Knudsen and Thorup (Fast Similarity Sketching, 2017): in round i every element is
thrown into a random bin with value i + h(x), a bin keeps its least value, and from round t on all elements go to
bin i - t, so that every coordinate is filled after 2t rounds at the latest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import documents_of, hashed_words, mix, raw, routed, row_key, run_hashes, slices, stash
from tidewater.llm.components import connected_components

SHINGLE = 5
THRESHOLD = (3, 4)
#: 40 bands of 5 coordinates: a pair with similarity 0.75 shares no band with a probability of 2e-5.
BANDS, ROWS = 40, 5
#: Hubs of a block of documents that share a rare shingle: in the first round, and times so many in each later one.
FIRST_HUBS, MORE_HUBS = 64, 16
#: Classes of shingles, by hash, whose counts bound what two documents can share.
CLASSES = 32

_U = np.uint64
_ROUND = _U(0x9E3779B97F4A7C15)
_LOW = _U(0xFFFFFFFF)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the lower-cased text; with fewer words, of the whole sequence."""
    words = hashed_words(text, lower=True)
    return np.unique(run_hashes(words, min(shingle, len(words)))) if len(words) else words


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of distinct hashes: t values, round number over hash."""
    out = np.full(t, np.iinfo(np.uint64).max, _U)
    done, step = 0, max(1, -(-3 * t // len(items)))
    while done < t:
        rounds = np.arange(done, min(t, done + step), dtype=_U)
        z = mix(items[None, :] + (rounds * _ROUND)[:, None])
        bins = ((z >> _U(32)) * _U(t)) >> _U(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((z & _LOW) | (rounds << _U(32))[:, None]).ravel())
        done += len(rounds)
        if (out >> _U(32) < _U(done)).all():
            return out
    for b in np.flatnonzero(out >> _U(32) >= _U(t)):
        out[b] = (_U(t + int(b)) << _U(32)) | (mix(items + _U((t + int(b)) * int(_ROUND) % (1 << 64))) & _LOW).min()
    return out


def band_keys(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = sketch(items, bands * rows).reshape(bands, rows)
    key = np.arange(bands, dtype=_U) * _ROUND
    for r in range(rows):
        key = mix(key ^ values[:, r]) + _ROUND
    return key


def _describe(bands: int, rows: int, shingle: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches):
            n, f1, f2, keys = [], [], [], []
            for text in raw(batch.column(2)):
                items = shingle_set(text, shingle)
                n.append(len(items))
                f1.append(int(mix(items).sum(dtype=_U).astype(np.int64)) if len(items) else None)
                f2.append(int(np.bitwise_xor.reduce(mix(items ^ _ROUND)).astype(np.int64)) if len(items) else None)
                keys.append(band_keys(items, bands, rows).view(np.int64) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def _similar(threshold: tuple[int, int], shingle: int):
    """Of pairs with both texts: the ids and components of those that are similar, judged on the full sets."""
    up, down = threshold

    def run(batches):
        last, last_set = None, None
        for batch in slices(batches):
            linked = []
            for left, right in zip(raw(batch.column(4)), raw(batch.column(5))):
                if right != last:
                    last, last_set = right, shingle_set(right, shingle)
                mine = shingle_set(left, shingle)
                shared = len(np.intersect1d(mine, last_set, assume_unique=True))
                linked.append(down * shared >= up * (len(mine) + len(last_set) - shared) and shared > 0)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(linked, pa.bool_()))

    return run


def _shingles(shingle: int):
    """(row, comp, text) -> a row for each shingle of the text."""
    schema = pa.schema([("row", pa.int64()), ("comp", pa.int64()), ("item", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, shingle) for t in raw(batch.column(2))]
            rows, comps = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), [len(x) for x in sets]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(comps, pa.int64()), pa.array(np.concatenate([np.empty(0, _U), *sets]).view(np.int64))], schema=schema)

    return run


class _Search:
    """Links between the documents of a table of texts (row, text), found among candidate pairs.

    A document is named by row (a hash of its id and text), so that rows that share an id keep texts of their own; its
    id is `rep`. Pairs are (a, b, comp_a, comp_b, row_a, row_b).
    """

    def __init__(self, texts: DataFrame, threshold: tuple[int, int], shingle: int):
        self.texts, self.threshold, self.shingle = texts, threshold, shingle
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None

    def sizes_fit(self, n: str, m: str):
        up, down = self.threshold
        return (F.col(n) * down >= F.col(m) * up) & (F.col(m) * down >= F.col(n) * up)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Compare the pairs that weren't yet; the new links, as (a, b, comp_a, comp_b)."""
        swap = F.col("row_a") < F.col("row_b")
        pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
        pairs = pairs.select(*(pick(f"{c}_{s}", f"{c}_{o}").alias(f"{c}_{s}") for c in ("id", "comp", "row") for s, o in ("ab", "ba"))).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["row_a", "row_b"], "left_anti")
        pairs = stash(pairs, "near-pairs")
        text = lambda side: self.texts.select(F.col("row").alias(f"row_{side}"), F.col("text").alias(f"text_{side}"))
        both = pairs.join(text("a"), "row_a").join(text("b"), "row_b").select("id_a", "id_b", "comp_a", "comp_b", "text_a", "text_b")
        found = stash(both.mapInArrow(_similar(self.threshold, self.shingle), "id_a long, id_b long, comp_a long, comp_b long"), "near-links").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "comp_a", "comp_b")
        seen = pairs.select("row_a", "row_b")
        self.tested = seen if self.tested is None else self.tested.unionByName(seen)
        self.links = found if self.links is None else self.links.unionByName(found)
        return found

    def relabelled(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """rows with comp after new links between components."""
        if not found.limit(1).count():
            return rows
        comp = connected_components(found.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
        return rows.join(comp.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")

    def by_hubs(self, buckets: DataFrame) -> DataFrame:
        """Compare the rows of each bucket with its hub. Returns the documents (row, rep, n, comp) of the buckets that still
        have several components."""
        ends = [F.col("rep").alias("id_a"), F.col("rep").alias("comp_a"), F.col("row").alias("row_a"), F.col("hub.rep").alias("id_b"), F.col("hub.rep").alias("comp_b"), F.col("hub.row").alias("row_b")]
        found = self.confirm(buckets.filter(F.col("row") != F.col("hub.row")).filter(self.sizes_fit("n", "hub.n")).select(*ends))
        rows = stash(self.relabelled(buckets.select("key", "row", "rep", "n", F.col("rep").alias("comp")), found), "near-comp")
        mixed = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
        return rows.join(mixed, "key", "left_semi").select("row", "rep", "n", "comp").distinct()

    def by_shared_items(self, docs: DataFrame) -> None:
        """Link docs (row, rep, n, comp) across components, exactly: no pair that is similar is left out.

        Only shingles that occur in several components can be shared across them. A document with m of them, of n in
        all, is out if m < n * threshold. What is left shares one of its rarest shingles with each similar document
        (prefix filter), and meets only documents of sizes that n and m allow.
        """
        up, down = self.threshold
        docs = stash(docs, "near-rest")
        items = stash(docs.select("row", "comp").join(self.texts, "row").select("row", "comp", "text").mapInArrow(_shingles(self.shingle), "row long, comp long, item long"), "near-items")
        live = stash(items.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("item", "df"), "near-live")
        held = items.join(live, "item").groupBy("row").agg(F.count(F.lit(1)).alias("m"), F.collect_list(F.struct("df", "item")).alias("items"))
        held = docs.join(held, "row").filter(F.col("m") * down >= F.col("n") * up)
        # Two documents share no more of a class of shingles than either has of it.
        parts = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.size(F.filter("items", lambda x: F.pmod(x["item"], F.lit(CLASSES)) == c)))
        held = held.withColumn("parts", parts)
        need = F.ceil(F.col("n") * up / down).cast("int")
        # The first shingle that two documents share, in the order of rarity, is followed by all others that they share:
        # so m counts from each shingle onwards.
        ordered = F.slice(F.array_sort("items"), 1, (F.col("m") - need + 1).cast("int"))
        prefix = held.select("row", "rep", "n", "comp", "parts", F.col("m").alias("of"), F.posexplode(ordered).alias("at", "item")).select("row", "rep", "n", "comp", "parts", (F.col("of") - F.col("at")).alias("m"), F.col("item.item").alias("item"))
        # Sizes are dealt into bins of a tenth; a row meets the bins of all sizes that a similar document can have.
        bin_of = lambda x: F.floor(F.log(x.cast("double")) / F.log(F.lit(1.1)))
        n, m = F.col("n"), F.col("m")
        most = F.least(n * down / up, (m * (up + down) - n * up) / up)
        wide = prefix.withColumn("own", bin_of(n)).withColumn("low", bin_of(F.ceil(n * up / down))).withColumn("high", bin_of(F.greatest(most, F.lit(1))))
        wide = wide.filter("low <= high").withColumn("other", F.explode(F.sequence("low", "high")))
        blocks = wide.select(F.xxhash64("item", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "row", "rep", "n", "comp", "m", "parts")
        hubs = FIRST_HUBS
        while True:
            main = F.min_by("comp", F.xxhash64("row", "key")).alias("main")
            mixed = blocks.groupBy("key").agg(main, F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key", "main")
            rows = stash(blocks.join(mixed, "key"), "near-blocks")
            if not rows.limit(1).count():
                return
            # Of the d rows outside a block's main component, each is a hub with probability hubs / d; every row of
            # another component is compared with it. When all of them have been hubs, the block is done.
            outside = rows.filter("comp <> main").groupBy("key").agg(F.count(F.lit(1)).alias("d"))
            share = F.shiftrightunsigned(F.xxhash64("row", "key"), 11) / F.lit(float(1 << 53))
            rows = rows.join(outside, "key").withColumn("is_hub", (F.col("comp") != F.col("main")) & (share * F.col("d") < hubs))
            hub = rows.filter("is_hub").select("key", F.struct("row", "rep", "n", "comp", "m", "parts").alias("hub"))
            shared = F.aggregate(F.zip_with("parts", "hub.parts", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
            both = rows.join(hub, "key").filter(F.col("comp") != F.col("hub.comp")).filter(self.sizes_fit("n", "hub.n")).filter(F.least(F.least("m", "hub.m"), shared) * (up + down) >= (F.col("n") + F.col("hub.n")) * up)
            found = self.confirm(both.select(F.col("rep").alias("id_a"), F.col("comp").alias("comp_a"), F.col("row").alias("row_a"), F.col("hub.rep").alias("id_b"), F.col("hub.comp").alias("comp_b"), F.col("hub.row").alias("row_b")))
            blocks = self.relabelled(rows.filter("not is_hub").drop("is_hub", "d", "main"), found)
            hubs *= MORE_HUBS


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept, for every input row.

    1. Documents with one shingle set collapse to one row (a grouping by 128 bits of the set).
    2. Each band's documents are compared with one of them, the hub.
    3. The documents of bands that still have several components are compared across these if they share a rare
       shingle and their sizes allow it (a prefix filter, exact). Hubs are drawn in each such block, FIRST_HUBS at first
       and MORE_HUBS times as many in each round, until no block has several components.

    So n copies cost n comparisons in each step, documents that share a template but are no near copies cost none
    in the third, and no similar pair of different components that shares a band goes unseen. Links are confirmed on full sets.

    Null or empty texts, and texts without words, have no shingles and are linked with nothing. Rows without an id
    are linked with nothing, and have no component_id and kept null. Rows that share an id count as linked, each with
    the links of its own text. Ties need no rule: the result depends on links alone. Very long texts are sets like
    others, whole. Extra columns play no part, whatever their names. An empty table gives an empty result.
    """
    named_docs = documents_of(docs, id_col, text_col).select(row_key().alias("row"), "doc_id", "text")
    base = stash(named_docs.mapInArrow(_describe(bands, rows, shingle), "row long, doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "near-base")
    named = base.filter("n_shingles > 0 and doc_id is not null")
    classes = stash(named.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("f1", "f2", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("first_row")), "near-classes")
    members = stash(named.join(classes, ["f1", "f2"]).select("doc_id", F.col("n_shingles").alias("n"), "rep", F.col("first_row").alias("row"), F.expr("CASE WHEN row = first_row THEN bands END").alias("bands")), "near-members")

    banded = members.filter("bands is not null").select("row", "rep", "n", F.explode("bands").alias("key"))
    hubs = stash(banded.groupBy("key").agg(F.min(F.struct("row", "rep", "n")).alias("hub"), F.max("row").alias("most")).filter("hub.row < most").select("key", "hub"), "near-hubs")
    buckets = stash(banded.join(hubs, "key").select("key", "row", "rep", "n", "hub"), "near-buckets")
    wanted = stash(buckets.select("row").distinct(), "near-wanted")
    texts = stash(routed(named_docs.select("row", "text"), wanted, "row", "left_semi").dropDuplicates(["row"]), "near-texts")

    search = _Search(texts, threshold, shingle)
    search.by_shared_items(search.by_hubs(buckets))
    shared_ids = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    comp = connected_components(stash(search.links.select("a", "b").unionByName(shared_ids), "near-links"))
    final = comp.select(F.col("node").alias("doc_id"), "comp")
    return base.join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), (F.coalesce("comp", "doc_id") == F.col("doc_id")).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, that near_duplicates keeps: one per group of linked documents. Rows
    without an id all stay. Of rows that share a kept id, one stays: that whose text has the least hash, then the one
    whose columns come first as JSON."""
    judged = near_duplicates(docs, id_col, text_col).filter("doc_id is not null")
    marks = stash(judged.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n_rows")).filter("not kept or n_rows > 1"), "near-marks")
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), rest.alias("rest"))
    left = routed(rows, marks, "doc_id").filter("kept is null or kept")
    out = left.filter("n_rows is null").select("rest")
    if marks.filter("kept and n_rows > 1").limit(1).count():
        several = left.filter("n_rows > 1")
        out = out.unionByName(several.groupBy("doc_id").agg(F.min_by("rest", F.struct(F.xxhash64(F.col(f"rest.`{text_col}`")), F.to_json("rest"))).alias("rest")).select("rest"))
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
