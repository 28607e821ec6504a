"""Benchmark decontamination: spaced seeds join test and training tokens, overlaps with substitutions are verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import LOWER, checked, documents_of, in_bits, marked_rows, membership_bits, mix, raw, row_key, sequence_hash, slices, stash, word_bounds, word_hashes

#: A window of tokens is contaminated if at most SUBSTITUTIONS of them differ from a test item's at the same places.
WINDOW, SUBSTITUTIONS = 16, 3
#: Token positions that each seed looks at. Together they hit every window with at most three substitutions.
MASKS = ((0, 1, 4, 6, 9, 11), (0, 2, 6, 7, 10, 11), (0, 1, 5, 6, 10, 11))
#: Items with fewer tokens than this have a single seed: they must match whole and exactly. Items from here up to a
#: window must match whole, with an eighth of their tokens substituted, and have a seed for each half.
HALVED = 8

_U = np.uint64
_SPAN = 1 + max(map(max, MASKS))
_PARTS = np.ones(256, bool)
_PARTS[48:58] = _PARTS[97:123] = False
_PARTS[128:] = False
_FACTORS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)]


def tokens_of(text: bytes | None) -> np.ndarray:
    """Hashes of the runs of letters, digits and bytes over 0x7F of the lower-cased text."""
    if not text:
        return np.empty(0, _U)
    data = np.frombuffer(text.translate(LOWER), np.uint8)
    return word_hashes(data, *word_bounds(data, _PARTS))


def _seed(tokens: np.ndarray, offsets: tuple[int, ...], span: int, salt: int) -> np.ndarray:
    """Hashes of the tokens at `offsets` from each place that has `span` tokens."""
    n = len(tokens) - span + 1
    if n <= 0:
        return np.empty(0, _U)
    total = np.full(n, salt, _U)
    for i, o in enumerate(offsets):
        total += tokens[o : o + n] * (_FACTORS[i % 6] + _U(2 * (i // 6)))
    return mix(total)


def _halves(n: int) -> tuple[tuple[int, int], ...]:
    return ((0, n // 2), (n // 2, n - n // 2)) if n >= HALVED else ((0, n),)


def seeds_of(tokens: np.ndarray, lengths: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all seeds: the masks, and contiguous runs of the given lengths (halves of short items)."""
    hashes = [_seed(tokens, m, _SPAN, 1000 + i) for i, m in enumerate(MASKS)]
    hashes += [_seed(tokens, tuple(range(n)), n, n) for n in lengths]
    return np.concatenate([np.arange(len(h)) for h in hashes]), np.concatenate(hashes)


def matched(doc: np.ndarray, item: np.ndarray, shift: int) -> np.ndarray:
    """Whether each token of doc lies in a window that matches item, where doc[p] is held against item[p - shift]."""
    out = np.zeros(len(doc), bool)
    low, high = max(0, shift), min(len(doc), shift + len(item))
    window = min(WINDOW, len(item))
    if high - low < window:
        return out
    need = WINDOW - SUBSTITUTIONS if len(item) >= WINDOW else len(item) - len(item) // 8
    sums = np.concatenate([[0], np.cumsum(doc[low:high] == item[low - shift : high - shift])])
    for s in np.flatnonzero(sums[window:] - sums[:-window] >= need):
        out[low + s : low + s + window] = True
    return out


def _item_seeds(batches):
    schema = pa.schema([("item", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("tokens", pa.binary()), ("short", pa.int32()), ("places", pa.list_(pa.int32())), ("seeds", pa.list_(pa.int64()))])
    for batch in slices(batches):
        rows = []
        for ids, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            t = tokens_of(text)
            if not len(t):
                continue
            if len(t) >= WINDOW:
                places, hashes = seeds_of(t)
            else:
                places = np.array([a for a, _ in _halves(len(t))])
                hashes = np.array([_seed(t[a : a + n], tuple(range(n)), n, n)[0] for a, n in _halves(len(t))], _U)
            rows.append((sequence_hash(t)[0], ids, t.tobytes(), len(t) if len(t) < WINDOW else None, places.astype(np.int32), hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)


def _doc_seeds(lengths: tuple[int, ...], wanted):
    schema = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("seed", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            keys, places, seeds = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), raw(batch.column(2))):
                at, h = seeds_of(tokens_of(text), lengths)
                perhaps = np.flatnonzero(in_bits(wanted.value, h))
                h, at = h[perhaps], at[perhaps]
                keys.append(np.full(len(h), key, np.int64))
                places.append(at.astype(np.int32))
                seeds.append(h.view(np.int64))
            join = lambda x, kind: pa.array(np.concatenate([np.empty(0, kind), *x]))
            yield pa.RecordBatch.from_arrays([join(keys, np.int64), join(places, np.int32), join(seeds, np.int64)], schema=schema)

    return run


def _verify(batches):
    for batch in slices(batches):
        n_words, n_hit, items = [], [], []
        for text, hits in zip(raw(batch.column(1)), batch.column(2).to_pylist()):
            doc = tokens_of(text)
            covered, found = np.zeros(len(doc), bool), set()
            for hit in hits or []:
                item = np.frombuffer(hit["tokens"], _U)
                for shift in hit["shifts"]:
                    mine = matched(doc, item, shift)
                    if mine.any():
                        covered |= mine
                        found.update(hit["item_ids"])
            n_words.append(len(doc))
            n_hit.append(int(covered.sum()))
            items.append(sorted(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=["rest", "n_words", "n_contaminated", "items"])


def _verified(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """rest (the row), and what was found in it."""
    named = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    texts = named.filter("text is not null").groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select("item_ids", "text")
    items = stash(texts.mapInArrow(_item_seeds, "item long, item_ids array<long>, tokens binary, short int, places array<int>, seeds array<long>"), "bench-items")
    lengths = tuple(sorted({n for row in items.select("short").filter("short is not null").distinct().collect() for _, n in _halves(row["short"])}))
    seeds = stash(items.select("item", F.explode(F.arrays_zip("places", "seeds")).alias("s")).select("item", F.col("s.places").alias("item_place"), F.col("s.seeds").alias("seed")), "bench-seeds")
    wanted = membership_bits(seeds.select("seed"))
    source = documents_of(docs, id_col, text_col).select(row_key().alias("key"), "doc_id", "text")
    hits = source.mapInArrow(_doc_seeds(lengths, wanted), "key long, place int, seed long").join(checked(seeds), "seed")
    lines = hits.groupBy("key", "item").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts"))
    facts = items.select("item", "item_ids", "tokens")
    per_doc = stash(lines.join(facts, "item").groupBy("key").agg(F.collect_list(F.struct("shifts", "item_ids", "tokens")).alias("hits")), "bench-hits")
    rows = marked_rows(docs, per_doc, id_col, text_col).select("rest", "text", "hits")
    out = T.StructType([T.StructField("rest", rows.schema["rest"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_contaminated", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(_verify, out)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_contaminated (words in matching windows) and items (ids, sorted), for every input row.

    A window of WINDOW tokens of a document matches if at most SUBSTITUTIONS differ from an item's tokens at the same
    places; an item with fewer tokens must match as a whole, with an eighth of them substituted (below 8: none).
    Spaced seeds find the places (their masks miss no such window; halves serve short items), a join with the items'
    seeds names the items, and tokens around each hit are then compared. Equal items are looked up once.

    A map of bits of the items' seeds, of one size for any number of them, reaches the tasks; the places that it lets
    through meet the seeds in the join. Only documents with hits are shuffled to them, by row, so no passage and no item gathers its documents in
    one task; an item's tokens go once to each document that it may be in.

    Null or empty texts: no words, no hits. Null ids stay; null item ids are left out of `items`, but their texts
    count. Repeated rows each have their result. Very long texts are taken whole. Ties need no rule. Extra columns play
    no part. Empty tables: no rows, or no hits.
    """
    rows = _verified(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return rows.select(F.col(f"rest.`{id_col}`").cast("long").alias("doc_id"), "n_words", "n_contaminated", "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, in which find_contamination finds nothing. Null and empty texts stay, and
    null or empty items match nothing; very long texts are searched whole; repeated rows share their fate; there are no
    ties. Extra columns keep their values, whatever their names. Empty tables: no rows, or all rows."""
    rows = _verified(docs, benchmark, id_col, text_col, item_col, item_text_col).filter("n_contaminated = 0")
    return rows.select(*(F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
