"""Substring dedup by level-wise doubling: word runs that repeat at one length are looked at again at twice that length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import documents_of, hashed_words, in_bits, membership_bits, mix, parted, raw, row_key, run_hashes, sequence_hash, slices, stash

WINDOW = 35
#: Words of the runs of the first level.
START = 9
#: Shares of a window hash in the join that brings repeated windows back to their places.
SALTS = 4

_U = np.uint64
_PLACE = _U((1 << 21) - 1)
#: The place that stands for a whole document.
WHOLE = -1


def seed_places(runs: np.ndarray, reach: int) -> np.ndarray:
    """For each `reach` consecutive runs, the place of the least hash (by its upper 43 bits, the first of equals): a
    choice that depends on the words of that window alone, so equal windows choose equal seeds at equal offsets."""
    n = len(runs) - reach + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    for at in range(0, n, 1 << 20):
        part = runs[at : at + (1 << 20) + reach - 1]
        least = (part & ~_PLACE) | np.arange(len(part), dtype=_U)
        span = 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        mine = len(part) - reach + 1
        out[at : at + mine] = (np.minimum(least[:mine], least[reach - span : reach - span + mine]) & _PLACE).astype(np.int64) + at
    return out


def levels_of(window: int, start: int = START) -> list[int]:
    """Lengths of the levels before the whole window: start, twice that, and so on, up to half a window at least."""
    out = [min(start, -(-window // 2))]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return out


_SEED = (("key", np.int64), ("place", np.int32), ("h", np.int64), ("g", np.int32), ("c", np.int32))
_SEED_SQL = "key long, place int, h long, g int, c int"


def _rows(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, k), *c]).astype(k, copy=False)) for c, (_, k) in zip(columns, _SEED)], names=[n for n, _ in _SEED])


def _counted(hashes: np.ndarray) -> np.ndarray:
    """How often each value stands in a document: at its first place, and 0 at the others."""
    out = np.zeros(len(hashes), np.int32)
    _, first, count = np.unique(hashes, return_index=True, return_counts=True)
    out[first] = count
    return out


def _seeds(window: int, length: int, before: tuple[int, object] | None):
    """The seeds of one level, and a row for each document that has a window. before: the length of the level before
    and the bits of its repeated hashes; windows whose seed isn't among these are passed over."""

    def run(batches):
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in _SEED]
            for key, text in zip(batch.column(0).to_pylist(), raw(batch.column(2))):
                words = hashed_words(text, lower=False)
                runs = run_hashes(words, length)
                at = seed_places(runs, window - length + 1)
                if not len(at):
                    continue
                if before is not None:
                    shorter = run_hashes(words, before[0])
                    at = at[in_bits(before[1].value, shorter[seed_places(shorter, window - before[0] + 1)])]
                at = np.unique(at)
                h = runs[at]
                whole, check = sequence_hash(words)
                n = len(at) + 1
                values = (np.full(n, key), np.append(at, WHOLE), np.append(h.view(np.int64), whole), np.append(np.zeros(n - 1, np.int32), np.int32(check >> 32)), np.append(_counted(h), 1))
                for column, value in zip(out, values):
                    column.append(value)
            yield _rows(out)

    return run


def _windows(window: int, length: int):
    def run(batches):
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in _SEED]
            for key, text, seeds in zip(batch.column(0).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist()):
                words = hashed_words(text, lower=False)
                places = np.flatnonzero(np.isin(seed_places(run_hashes(words, length), window - length + 1), np.array(seeds)))
                h, g = run_hashes(words, window)[places], run_hashes(mix(words + _U(1)), window)[places] >> _U(32)
                for column, value in zip(out, (np.full(len(places), key), places, h.view(np.int64), g.astype(np.uint32).view(np.int32), _counted(h))):
                    column.append(value)
            yield _rows(out)

    return run


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, places in zip(raw(batch.column(2)), batch.column(3).to_pylist()):
                words = (text or b"").split()
                n_words.append(len(words))
                if places and WHOLE in places:
                    words = []
                elif places:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, np.array(places), 1)
                    np.add.at(cover, np.array(places) + window, -1)
                    free = np.cumsum(cover[:-1]) == 0
                    words = [w for w, f in zip(words, free) if f]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, start: int = START) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by blanks), for every input row.

    A word goes if it lies in a window of `window` words whose sequence also starts anywhere else. Each window has a
    seed at each level: a run of 9, 18, ... words, chosen by the window's own words (about a tenth of all places are
    seeds). Seeds that occur once end their windows' part in the search; the others are extended to twice the length,
    until none is left or the length is that of the window, where windows are judged by 96 bits of their words. No
    longer level is needed: the words of a longer repeat are the words of its windows.

    From one level to the next go the repeated hashes, in a map of fixed size (more of them only let more windows
    through); before the last step the places that are left are found exactly, and only documents that have some are
    shuffled, once. Documents with one word sequence lose all words, and one of them stands for all.

    Counts are made within each document, then with partial aggregation before the shuffle, and found places come
    back by joins that are salted and can be split, so a passage in a third of all rows, or a word repeated in one
    text, isn't gathered anywhere. Null or empty text, or texts shorter than a window: nothing goes. Very long texts
    are taken whole. Null ids stay. Rows that repeat an id and a text are places of their own: each repeats the
    other. Ties of hashes need no rule. Extra columns play no part. An empty table gives none.
    """
    source = documents_of(docs, id_col, text_col).select(row_key().alias("key"), "doc_id", "text")
    whole_schema = "doc_id long, n_words long, n_removed long, kept string"
    before = None
    for length in levels_of(window, start):
        seeds = source.mapInArrow(_seeds(window, length, before), _SEED_SQL)
        again = stash(seeds.filter("c > 0").groupBy("h", "g").agg(F.sum("c").alias("n"), F.min(F.when(F.col("place") == WHOLE, F.col("key"))).alias("first")).filter("n > 1").select("h", "g", "first"), f"sub-repeats-{length}")
        if not again.limit(1).count():
            return source.withColumn("places", F.lit(None).cast("array<int>")).mapInArrow(_remove(window), whole_schema)
        before = (length, membership_bits(again.select("h")))
    whole = F.max(F.col("place") == WHOLE).alias("whole")
    copy = F.coalesce(F.max((F.col("place") == WHOLE) & (F.col("key") != F.col("first"))), F.lit(False)).alias("copy")
    left = stash(seeds.join(again, ["h", "g"]).groupBy("key").agg(F.collect_set(F.when(F.col("place") != WHOLE, F.col("place"))).alias("seeds"), whole, copy), "sub-seeds")

    marked, rest = parted(source, left, "key")
    windows = marked.join(left.filter("not copy").select("key", "seeds"), "key").select("key", "doc_id", "text", "seeds").mapInArrow(_windows(window, before[0]), _SEED_SQL)
    twice = windows.filter("c > 0").groupBy("h", "g").agg(F.sum("c").alias("n")).filter("n > 1")
    salted = twice.select("h", "g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = windows.withColumn("salt", F.pmod("place", F.lit(SALTS))).join(salted, ["h", "g", "salt"]).select("key", "place")
    places = found.unionByName(left.filter("whole").select("key", F.lit(WHOLE).alias("place"))).groupBy("key").agg(F.collect_set("place").alias("places"))
    return marked.join(places, "key", "left").unionByName(rest, allowMissingColumns=True).mapInArrow(_remove(window), whole_schema)


def with_digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
