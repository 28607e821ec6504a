"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling; later copies of repeated runs go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import documents_of, in_bits, marked_rows, membership_bits, raw, routed, row_key, slices, stash, word_bounds

#: The shortest run, in lines, whose later copies go. A power of two, so that it is one level of the doubling.
MIN_LINES = 2
#: The least number of words of a line whose later copies go on their own, where that is asked for.
LONG_LINE = 35

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[10] = True


def line_bounds(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of words of each line that has more than white space, white space around it left out."""
    data = np.frombuffer(text or b"", np.uint8)
    starts, ends = word_bounds(data, _BREAK)
    word_starts, word_ends = word_bounds(data)
    first, after = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    full = after > first
    return word_starts[first[full]], word_ends[after[full] - 1], (after - first)[full]


def line_ids(text: bytes | None, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The XXH3 of the bytes of each line, in a row of two 64-bit halves."""
    text = text or b""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), _U).reshape(-1, 2)


def _counts(batches):
    """(h, g, n): how often each line stands in a slice of texts."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("n", pa.int64())])
    for batch in slices(batches):
        ids = np.concatenate([np.empty((0, 2), _U), *(line_ids(text, *line_bounds(text)[:2]) for text in raw(batch.column(2)))])
        once, n = np.unique(ids.view([("h", _U), ("g", _U)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(once["h"].view(np.int64)), pa.array(once["g"].view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)


def _lines(long_line: int | None, repeated):
    """The lines that a map of repeated ones doesn't rule out."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("long", pa.bool_())])

    def run(batches):
        for batch in slices(batches):
            n, ids, pos, long = [], [np.empty((0, 2), _U)], [np.empty(0, np.int32)], [np.empty(0, bool)]
            for text in raw(batch.column(2)):
                starts, ends, words = line_bounds(text)
                mine = line_ids(text, starts, ends)
                perhaps = np.flatnonzero(in_bits(repeated.value, mine[:, 0]))
                n.append(len(perhaps))
                ids.append(mine[perhaps])
                pos.append(perhaps.astype(np.int32))
                long.append(words[perhaps] >= long_line if long_line is not None else np.zeros(len(perhaps), bool))
            keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)
            docs = batch.column(1).take(pa.array(np.repeat(np.arange(len(n)), n)))
            both = np.concatenate(ids).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), docs, pa.array(np.concatenate(pos)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.concatenate(long))], schema=schema)

    return run


def _named(rows: DataFrame, by: list[str], level: int, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The suffixes whose prefix of 2**level lines occurs more than once, with its rank, and the intervals themselves.

    A rank is the place of the prefix among all repeated ones in sorted order (ids rise along a range-sorted table),
    so ranks of level k compare as the prefixes do, and pairs of them as the prefixes of level k + 1. n_rows: how many
    rows have this id and text; a prefix in such a row occurs as often.
    """
    place = F.struct(F.col("doc_id").alias("first_doc"), F.col("key").alias("first_key"), F.col("pos").alias("first_pos"))
    groups = rows.groupBy(*by).agg(F.sum("n_rows").alias("copies"), F.min(place).alias("first")).filter("copies > 1")
    intervals = stash(groups.orderBy(*by).select(*by, F.monotonically_increasing_id().alias("rank"), "copies", "first.*"), f"line-intervals-{level}")
    ranked = rows.join(intervals.select(*by, "rank", "first_key", "first_pos"), by)
    later = ~((F.col("key") == F.col("first_key")) & (F.col("pos") == F.col("first_pos")))
    ranked = ranked.select("key", "doc_id", "pos", "rank", "n_rows", *also, later.alias("later"))
    if not level:
        ranked = ranked.groupBy(*(c for c in ranked.columns if c != "n_rows")).agg(F.sum("n_rows").alias("n_rows"))
    return stash(ranked, f"line-suffixes-{level}"), intervals


def suffix_levels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_line: int | None = None) -> list[tuple[int, DataFrame, DataFrame]]:
    """Levels of the suffix array: (lines, suffixes, intervals) for prefixes of 1, 2, 4, ... lines.

    suffixes: key, doc_id, pos, rank, n_rows, later (whether an equal prefix starts at an earlier place, places being
    ordered by doc_id, row and line), and at the first level long (at least `long_line` words). intervals: the
    longest-common-prefix intervals of at least that length, with rank, copies and first place. A suffix that is
    unique, or ends with its document, goes no further; doubling stops when none is left. So the work follows what
    repeats, and the rounds the logarithm of the longest repeated run. Lines are told apart by 128 bits; a first pass
    counts them, and those that a bounded map of the repeated ones rules out aren't written at all.
    """
    source = documents_of(docs, id_col, text_col).select(row_key().alias("key"), "doc_id", "text")
    repeated = stash(source.mapInArrow(_counts, "h long, g long, n long").groupBy("h", "g").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "line-repeated")
    lines = source.mapInArrow(_lines(long_line, membership_bits(repeated)), "key long, doc_id long, pos int, h long, g long, long boolean").withColumn("n_rows", F.lit(1).cast("long"))
    levels = [(1, *_named(stash(lines, "line-ids"), ["h", "g"], 0, ("long",)))]
    while True:
        length, suffixes, _ = levels[-1]
        ahead = suffixes.select("key", (F.col("pos") - length).alias("pos"), F.col("rank").alias("next_rank"))
        pairs = suffixes.select("key", "doc_id", "pos", "n_rows", F.col("rank").alias("this_rank")).join(ahead, ["key", "pos"])
        found = _named(pairs, ["this_rank", "next_rank"], len(levels))
        if not found[1].limit(1).count():
            return levels
        levels.append((2 * length, *found))


_FACTS = (("n_lines", "long"), ("n_removed", "long"), ("n_runs", "long"), ("kept", "string"))
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _rewrite(min_lines: int, long_line: int | None):
    def run(batches):
        for batch in slices(batches):
            out: list[list] = [[] for _ in _FACTS]
            for text, starts, singles, repeat in zip(raw(batch.column(2)), *(batch.column(c).to_pylist() for c in (3, 4, 5))):
                text = text or b""
                a, b, words = line_bounds(text)
                gone = np.zeros(len(a), bool)
                for s in starts or []:
                    gone[s : s + min_lines] = True
                gone[singles or []] = True
                if repeat and len(a) >= min_lines:
                    gone[:] = True
                elif repeat and long_line is not None:
                    gone |= words >= long_line
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = text
                if runs:
                    kept = b"\n".join(text[x:y] for x, y in zip(a[~gone].tolist(), b[~gone].tolist()))
                for column, value in zip(out, (len(a), int(gone.sum()), runs, kept.decode("utf-8"))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, _ARROW[t]) for c, (_, t) in zip(out, _FACTS))], names=["key", "rest", *(n for n, _ in _FACTS)])

    return run


def _rewritten(docs: DataFrame, id_col: str, text_col: str, min_lines: int, long_line: int | None) -> tuple[DataFrame, DataFrame]:
    """Every row (key, rest) with what line dedup makes of it, and the longest repeat by key.

    Only rows that lose lines are shuffled to their marks; the texts of the others stay where they are read.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    marks, repeats = None, None
    for length, suffixes, _ in suffix_levels(docs, id_col, text_col, long_line):
        start = F.when(F.lit(length == min_lines) & F.col("later"), F.col("pos"))
        single = F.when(F.col("later") & F.col("long"), F.col("pos")) if length == 1 else F.lit(None).cast("int")
        one = suffixes.select("key", start.alias("start"), single.alias("single"), F.when(F.col("n_rows") > 1, F.col("n_rows")).alias("n_rows"))
        long = suffixes.select("key", F.lit(length).cast("long").alias("longest_repeat"))
        marks = one if marks is None else marks.unionByName(one)
        repeats = long if repeats is None else repeats.unionByName(long)
    marks = marks.filter("start is not null or single is not null or n_rows is not null")
    found = stash(marks.groupBy("key").agg(F.collect_set("start").alias("starts"), F.collect_set("single").alias("singles"), F.max("n_rows").alias("n_rows")), "line-marks")
    rows = marked_rows(docs, found, id_col, text_col)
    plain = ["key", "rest", "text", "starts", "singles"]
    once = rows.filter("n_rows is null").select(*plain, F.lit(False).alias("repeat"))
    if found.filter("n_rows is not null").limit(1).count():
        # Of rows that repeat an id and a text, the first written one is the first place, the others are copies of it.
        several = stash(rows.filter("n_rows is not null").select(*plain, F.monotonically_increasing_id().alias("nth")), "line-repeats")
        first = stash(several.groupBy("key").agg(F.min("nth").alias("first")), "line-firsts")
        once = once.unionByName(several.join(first, "key").select(*plain, (F.col("nth") > F.col("first")).alias("repeat")))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("rest", rows.schema["rest"].dataType), *(T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in _FACTS)])
    return once.mapInArrow(_rewrite(min_lines, long_line), schema), repeats.groupBy("key").agg(F.max("longest_repeat").alias("longest_repeat"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_line: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, longest_repeat and kept (the text that is left), for every input row.

    Lines are parted by \\n and compared without white space around them; blank lines are no lines. A line goes if it
    lies in a run of `min_lines` lines that also starts at an earlier place (smaller doc_id, then row, then line
    number). Such runs cover just the later copies of all maximal repeated runs of at least that length. With
    `long_line`, a line of so many words also goes if it stands at an earlier place, whatever its neighbours are. A
    text that loses nothing stays byte for byte; one that loses lines has the others joined by \\n. longest_repeat: the
    largest of 1, 2, 4, ... for which so many consecutive lines of the document also stand elsewhere; 0 if no line does.

    Null or empty texts have no lines and are kept as empty ones. Null ids come first in the order. Of rows that
    repeat an id and a text one counts as first, the others as its copies (texts without lines stay). Very long texts
    are taken whole. An empty table gives an empty result. Extra columns play no part, whatever their names. Hot
    lines and runs are counted with partial aggregation; joins on them can be split.
    """
    facts, repeats = _rewritten(docs, id_col, text_col, min_lines, long_line)
    rows = routed(facts, stash(repeats, "line-longest"), "key")
    return rows.select(F.col(f"rest.`{id_col}`").cast("long").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.coalesce("longest_repeat", F.lit(0).cast("long")).alias("longest_repeat"), "kept")


def digest_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_line: int | None = None) -> DataFrame:
    """dedup_lines with the SHA-256 of kept in its place, so that kept texts needn't meet longest_repeat."""
    facts, repeats = _rewritten(docs, id_col, text_col, min_lines, long_line)
    narrow = facts.select("key", F.col(f"rest.`{id_col}`").cast("long").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return narrow.join(repeats, "key", "left").select("doc_id", "n_lines", "n_removed", "n_runs", F.coalesce("longest_repeat", F.lit(0).cast("long")).alias("longest_repeat"), "kept_sha256")


def without_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_lines: int = MIN_LINES, long_line: int | None = LONG_LINE) -> DataFrame:
    """The rows of docs with their own columns: the text is what dedup_lines keeps (later copies of long single lines
    go too), chars_col (if there is one) its length. A row that had lines and lost all of them goes; one that was
    empty or null before stays as it is, and so does a row without an id. Of rows that repeat an id and a text, one
    stays if they have lines."""
    rows = _rewritten(docs, id_col, text_col, min_lines, long_line)[0].filter("n_removed < n_lines or n_lines = 0")
    changed = {text_col: F.when(F.col("n_removed") > 0, F.col("kept").cast(docs.schema[text_col].dataType)).otherwise(F.col(f"rest.`{text_col}`"))}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"rest.`{chars_col}`"))
    return rows.select(*(changed.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
