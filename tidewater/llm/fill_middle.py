"""Fill-in-middle by overlapping-chunk decomposition: whether a token starts at a character follows from it and the one
before it, so chunks that overlap by one character are counted side by side; prefix sums of the counts tell which chunk
holds each cut, and only those chunks are read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import raw, row_key, slices, stash

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, how many stay plain, and of 100 others, how many have the suffix first.
PLAIN, SPM = 10, 20
#: Bytes of the chunks that a task counts at a time, and characters of those that longer texts are dealt into.
CHUNK, LONG_TEXT = 64 << 10, 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FACTS = (("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()))
_FACTS_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def token_starts(data: np.ndarray, overlap: int) -> np.ndarray:
    """Whether a token starts at each byte after the first `overlap` (0 or 1) ones: at the first byte of a character,
    unless it and the byte before are letters. Without overlap the first byte starts one."""
    letter = _LETTER[data]
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts[overlap:]


def counted(data: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Tokens that start in the chunks up to each one."""
    overlap = lambda at: int(at > 0)
    return np.cumsum([0, *(int(np.count_nonzero(token_starts(data[at - overlap(at) : at + chunk], overlap(at)))) for at in range(0, len(data), chunk))])


def located(data: np.ndarray, sums: np.ndarray, rank: int, chunk: int = CHUNK) -> int:
    """The byte at which the token of this rank starts (the end for the number of tokens): its chunk is read again."""
    if rank >= sums[-1]:
        return len(data)
    owner = int(np.searchsorted(sums, rank, side="right")) - 1
    at = owner * chunk
    overlap = int(at > 0)
    return at + int(np.flatnonzero(token_starts(data[at - overlap : at + chunk], overlap))[rank - int(sums[owner])])


def chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _is_plain(text: bytes, h3: int) -> bool:
    return not text or h3 % 100 >= 100 - PLAIN or PREFIX in text or SUFFIX in text or MIDDLE in text


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(_FACTS), _FACTS)], names=[n for n, _ in _FACTS])


def _arranged(doc_id, text: bytes, n: int, form: str, cuts: tuple[int, int] | None) -> tuple:
    if cuts is None:
        return doc_id, n, form, None, None, text.decode()
    data = np.frombuffer(text, np.uint8)
    a, b = cuts
    head, middle, tail = text[:a], text[a:b], text[b:]
    out = [PREFIX, head, SUFFIX, tail, MIDDLE, middle] if form == "psm" else [SUFFIX, tail, PREFIX, head, MIDDLE, middle]
    return doc_id, n, form, chars(data[:a]), chars(data[a:b]), b"".join(out).decode()


def _form(text: bytes, h3: int, h4: int) -> str:
    return "plain" if _is_plain(text, h3) else "spm" if h4 % 100 < SPM else "psm"


def _whole(chunk: int):
    """(doc_id, text, h1 .. h4) of texts that one task counts."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text, h1, h2, h3, h4 in zip(batch.column(0).to_pylist(), raw(batch.column(1)), *(batch.column(c).to_pylist() for c in range(2, 6))):
                text = text or b""
                data = np.frombuffer(text, np.uint8)
                sums = counted(data, chunk)
                n, form, cuts = int(sums[-1]), _form(text, h3, h4), None
                if form != "plain":
                    cuts = tuple(located(data, sums, r, chunk) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                rows.append(_arranged(doc_id, text, n, form, cuts))
            yield _rows(rows)

    return run


def _chunk_counts(batches):
    """(key, chunk, overlap, piece) -> (key, chunk, n, bytes): the piece has one character of the chunk before it, if any."""
    for batch in slices(batches):
        n, size = [], []
        for overlap, piece in zip(batch.column(2).to_pylist(), raw(batch.column(3))):
            data = np.frombuffer(piece, np.uint8)
            skip = _first(piece) if overlap else 0
            n.append(_after(data, skip))
            size.append(len(data) - skip)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["key", "chunk", "n", "bytes"])


def _first(piece: bytes) -> int:
    """Bytes of the first character."""
    return len(piece[:4].decode("utf-8", "ignore")[:1].encode())


def _after(data: np.ndarray, skip: int) -> int:
    """Tokens that start after the first `skip` bytes, which are one character."""
    return int(np.count_nonzero(token_starts(data[max(0, skip - 1) :], int(skip > 0))))


def _cut_places(batches):
    """(key, cut, rank, before_bytes, overlap, piece) -> (key, cut, place): the byte of the whole text."""
    for batch in slices(batches):
        at = []
        for rank, before, overlap, piece in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), raw(batch.column(5))):
            skip = _first(piece) if overlap else 0
            starts = token_starts(np.frombuffer(piece, np.uint8)[max(0, skip - 1) :], int(skip > 0))
            at.append(before + int(np.flatnonzero(starts)[rank]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())], names=["key", "cut", "place"])


def _placed(batches):
    """(doc_id, text, form, n, low, high) -> the rows of texts whose cuts were found chunk by chunk."""
    for batch in slices(batches):
        rows = []
        for doc_id, text, form, n, low, high in zip(batch.column(0).to_pylist(), raw(batch.column(1)), *(batch.column(c).to_pylist() for c in range(2, 6))):
            low, high = (len(text) if x is None else x for x in (low, high))
            rows.append(_arranged(doc_id, text, n, form, None if form == "plain" else (low, high)))
        yield _rows(rows)


def _long_texts(source: DataFrame, long_text: int) -> DataFrame:
    """Texts of over `long_text` characters, dealt into overlapping chunks over the tasks."""
    docs = stash(source.withColumn("key", row_key()).filter(F.length("text") > long_text).select("key", "doc_id", "text", "h1", "h2", "h3", "h4"), "fim-long")
    texts = docs.dropDuplicates(["key"])
    at = F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / long_text).cast("int")))
    piece = F.expr(f"substring(text, greatest(chunk * {long_text}, 1), {long_text} + least(chunk, 1))")
    chunks = stash(texts.select("key", "text", at.alias("chunk")).select("key", "chunk", (F.col("chunk") > 0).alias("overlap"), piece.alias("piece")).repartition("key", "chunk"), "fim-chunks")
    counts = stash(chunks.select("key", "chunk", "overlap", "piece").mapInArrow(_chunk_counts, "key long, chunk int, n long, bytes long"), "fim-counts")
    so_far = W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    summed = counts.select("key", "chunk", "n", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"), F.coalesce(F.sum("bytes").over(so_far), F.lit(0)).alias("before_bytes"))
    totals = counts.groupBy("key").agg(F.sum("n").alias("n_tokens"))
    marks = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marks = marks | F.col("text").contains(mark.decode())
    form = F.when(marks | (F.col("h3") % 100 >= 100 - PLAIN), "plain").when(F.col("h4") % 100 < SPM, "spm").otherwise("psm")
    ranked = docs.join(totals, "key").withColumns({"form": form, "a": F.col("h1") % (F.col("n_tokens") + 1), "b": F.col("h2") % (F.col("n_tokens") + 1)})
    ranked = stash(ranked.select("key", "doc_id", "form", F.col("n_tokens").alias("n"), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")), "fim-ranks")
    wanted = ranked.dropDuplicates(["key"]).filter("form <> 'plain'").select("key", F.inline(F.array(*(F.struct(F.lit(i).alias("cut"), F.col(c).alias("rank")) for i, c in enumerate(("low", "high"))))))
    routed = wanted.join(summed, "key").filter("rank >= before and rank < before + n").select("key", "chunk", "cut", (F.col("rank") - F.col("before")).alias("rank"), "before_bytes")
    again = routed.join(chunks, ["key", "chunk"]).select("key", "cut", "rank", "before_bytes", "overlap", "piece")
    places = again.mapInArrow(_cut_places, "key long, cut int, place long").groupBy("key").agg(F.max(F.when(F.col("cut") == 0, F.col("place"))).alias("low"), F.max(F.when(F.col("cut") == 1, F.col("place"))).alias("high"))
    facts = ranked.dropDuplicates(["key"]).select("key", "form", "n").join(places, "key", "left")
    return docs.select("key", "doc_id", "text").join(facts, "key").select("doc_id", "text", "form", "n", "low", "high").mapInArrow(_placed, _FACTS_SQL)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:", chunk: int = CHUNK, long_text: int = LONG_TEXT) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars and output, for every input row.

    Tokens are runs of letters A-Z and a-z, and every other character. Two cuts between tokens, drawn from a hash of
    `seed` and the id, part the text. psm: prefix, suffix, middle, each after its mark; spm: the suffix first. Texts that
    hold a mark, are empty, or are drawn for it stay plain.

    Most texts are counted, cut and put together where they are read, in one narrow pass, chunk by chunk. Texts of over
    `long_text` characters are dealt into overlapping chunks that tasks count side by side; prefix sums over a text's
    chunks (a row of numbers each) route its cuts to the chunks that hold them, and only those are read again. Both
    ways give the same.

    Null text: empty. A null id is hashed as an empty one. Rows that repeat an id have the same draws. Cuts in one place
    (a tie) leave an empty middle. Extra columns play no part, whatever their names. An empty table gives none.
    """
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = {f"h{i + 1}": F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("digest", digest).withColumns(draws).select("doc_id", "text", "h1", "h2", "h3", "h4")
    short = source.filter(F.length("text") <= long_text).mapInArrow(_whole(chunk), _FACTS_SQL)
    if not source.filter(F.length("text") > long_text).limit(1).count():
        return short
    return short.unionByName(_long_texts(source, long_text))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone: a text that is cut holds none of the marks."""
    p, s, m = (F.locate(x.decode(), output) for x in (PREFIX, SUFFIX, MIDDLE))
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    middle = F.substring(output, m + 3, F.length(output))
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def with_digests(cut: DataFrame) -> DataFrame:
    """fill_in_middle's rows with the SHA-256 of the output and of the text restored from it, in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
