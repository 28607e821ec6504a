"""Small helpers that the operators share: table access, shared scratch tables, byte tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.scratch import shared_dir, stash  # noqa: F401  (for the operators)

#: Upper-case ASCII to lower case, byte by byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side of a join with more rows (or more array elements in them) than this isn't broadcast.
BROADCAST_ROWS = 300_000


def checked(side: DataFrame, elements: str | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most `rows` rows, or elements of the array column
    `elements`; else Spark shuffles both sides."""
    n = side.agg(F.sum(F.greatest(F.lit(1), F.size(elements))).alias("n")).first()["n"] or 0 if elements else side.count()
    return F.broadcast(side) if n <= rows else side


#: Hash slots of a membership map, as a power of two: 16 MB of bits at most, whatever the number of keys.
MAP_BITS = 27
#: Tasks that make a membership map; each row of it has 32,768 slots.
MAP_TASKS, MAP_ROW = 8, 15


def _bitmaps(placed: DataFrame) -> DataFrame:
    """(bucket, place) -> bucket, bitmap."""
    return placed.repartition(MAP_TASKS, "bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))


def membership(keys: DataFrame, column: str, bits: int = MAP_BITS) -> DataFrame:
    """bucket, bitmap: the hash slots that the values of a column take, 2 ** bits of them at most."""
    slot = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    return _bitmaps(keys.select(F.shiftright(slot, MAP_ROW).alias("bucket"), slot.bitwiseAND((1 << MAP_ROW) - 1).alias("place")))


def _perhaps(rows: DataFrame, column: str, keys: DataFrame, bits: int) -> DataFrame:
    """rows with perhaps_: false only if a row's value is surely not among the keys. The map has a fixed greatest
    size, so it is broadcast; where it fills up, more rows count as perhaps, and nothing else changes."""
    slot = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    keyed = rows.withColumns({"bucket_": F.shiftright(slot, MAP_ROW), "place_": slot.bitwiseAND((1 << MAP_ROW) - 1)})
    maps = membership(keys, column, bits).withColumnRenamed("bucket", "bucket_")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(place_ div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col("place_") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return keyed.join(F.broadcast(maps), "bucket_", "left").select(*rows.columns, F.coalesce(bit, F.lit(False)).alias("perhaps_"))


def parted(rows: DataFrame, marks: DataFrame, column: str, bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose value in a column may be among those of a written table, and the rows where it surely isn't."""
    flagged = _perhaps(rows, column, marks.select(column), bits)
    return flagged.filter("perhaps_").drop("perhaps_"), flagged.filter("not perhaps_").drop("perhaps_")


def routed(rows: DataFrame, marks: DataFrame, column: str, how: str = "left", bits: int = MAP_BITS) -> DataFrame:
    """rows joined on a column with a written table of marks, which only part of the rows have.

    Rows that a bounded map of the marked values rules out don't enter the shuffle of the join: wide rows without a
    mark stay where they are. how: left (those rows have nulls), left_semi or inner (they go), left_anti.
    """
    perhaps, rest = parted(rows, marks, column, bits)
    joined = perhaps.join(marks, column, how)
    return joined if how in ("inner", "left_semi") else joined.unionByName(rest, allowMissingColumns=True)


def membership_bits(hashes: DataFrame, bits: int = MAP_BITS):
    """A broadcast map of a written column of 64-bit hashes for in_bits, 2 ** bits bits at most."""
    column = hashes.columns[0]
    slot = F.shiftrightunsigned(column, 64 - bits)
    out = np.zeros(1 << max(bits - 3, 0), np.uint8)
    maps = _bitmaps(hashes.select(F.shiftright(slot, MAP_ROW).alias("bucket"), slot.bitwiseAND((1 << MAP_ROW) - 1).alias("place"))).toArrow()
    for bucket, bitmap in zip(maps.column(0).to_pylist(), maps.column(1).to_pylist()):
        out[bucket << (MAP_ROW - 3) :][: len(bitmap)] = np.frombuffer(bitmap, np.uint8)[: len(out) - (bucket << (MAP_ROW - 3))]
    return hashes.sparkSession.sparkContext.broadcast(out)


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of a map: never false for one that is."""
    slot = hashes >> _U(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 == 1


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; any other column stays out of its way."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """A key of a document row: rows with one id and text share it, rows that share only the id (or have none) don't."""
    doc = F.col(id_col).cast("long")
    return F.xxhash64(F.coalesce(doc, F.lit(-1)), doc.isNull(), F.col(text_col).cast("string"))


def with_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, text and rest (all columns in one struct): names that clash with an operator's own stay inside rest."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))


def marked_rows(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """with_rest, joined on key with a written table of marks (see routed). The text goes through the shuffle once, in rest."""
    return routed(with_rest(docs, id_col, text_col).drop("text"), marks, "key").withColumn("text", F.col(f"rest.`{text_col}`").cast("string"))


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batches, max_bytes: int = 4 << 20):
    """Arrow batches cut into slices of bounded bytes (one row at least), so that work arrays stay small."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, max_bytes // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


# ---------------------------------------------------------------- hashing of words and word runs

_U = np.uint64
#: Words over so many bytes are hashed one by one with XXH3; shorter ones together, eight bytes at a time.
_LONG_WORD = 64
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, vectorised; constants are those of the published generator."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array; separator: for each byte value whether it parts words."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~separator[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _then(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs, in order. The shifts between the products keep it from being linear, so sequences that mirror
    each other have no hash in common by construction."""
    x = left * _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(32)
    x += right
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes are mixed in at a time (a bijection of the state for each), after the length;
    words over _LONG_WORD bytes have their XXH3."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = mix(_then(size.astype(_U), eight[starts] & _KEEP[np.minimum(size, 8)]))
    longer, at = np.flatnonzero(size > 8), 8
    while len(longer) and at < _LONG_WORD:
        left = size[longer]
        out[longer] = mix(_then(out[longer], eight[starts[longer] + at] & _KEEP[np.minimum(left - at, 8)]))
        at += 8
        longer = longer[left > at]
    for i in longer.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words (empty if there are fewer), put together from runs of 1, 2, 4, ..."""
    count = len(words) - n + 1
    if count <= 0 or not n:
        return np.empty(0, _U)
    out, have, power, size = None, 0, words, 1
    while True:
        if n & size:
            out = power[:count] if out is None else _then(out, power[have : have + count])
            have += size
        if 2 * size > n:
            return mix(out + _U(n))
        power = _then(power[:-size], power[size:])
        size *= 2


def sequence_hash(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of the XXH3 of a whole sequence of word hashes, as signed numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(words.tobytes()), np.int64).tolist())


def hashed_words(text: bytes | None, lower: bool) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text."""
    if not text:
        return np.empty(0, _U)
    data = np.frombuffer(text.translate(LOWER) if lower else text, np.uint8)
    return word_hashes(data, *word_bounds(data))
