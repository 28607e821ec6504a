"""Best-fit packing: partitions pack locally, nearly full bins leave, underfull ones meet again in later rounds."""

from __future__ import annotations

import base64
import json
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import documents_of, slices, stash

CAPACITY = 2048
END_ID = 0
#: Bins that a task of a later round gets together; the rest goes to more tasks.
TASK_BINS = 50_000
#: Free places up to which a bin counts as nearly full: in the first round, and times STEP in each later one.
SLACK, STEP = 16, 4
VOCABULARY = "byte_bpe_50k.tiktoken"

_encoders: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """text -> ids, those of tokenizers on byte_bpe_50k.json: the ranks in the .tiktoken file are its vocabulary, and its
    added tokens (<|endoftext|>) are matched in the text before anything else."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(public_tokenizers.path(vocabulary.replace(".tiktoken", ".json")), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        _encoders[vocabulary] = lambda text: coder.encode(text, allowed_special="all")
    return _encoders[vocabulary]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: whole sequences at the end, what is left over first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the items of each bin. A bit set of free places finds the tightest bin."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = there >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                there &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if left := free - size:
            by_free[left].append(b)
            there |= 1 << left
    return bins


_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_BIN = pa.schema([("done", pa.bool_()), ("sequence_id", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(_MEMBER))])
BIN_SCHEMA = "done boolean, sequence_id long, fill int, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


def _bins_out(bins: list[list[dict]], slack: int, number, capacity: int) -> pa.RecordBatch:
    fills = []
    for b in bins:
        at = 0
        for m in b:
            m["offset"] = at
            at += m["length"]
        fills.append(at)
    return pa.RecordBatch.from_arrays([pa.array([capacity - f <= slack for f in fills], pa.bool_()), pa.array([next(number) for _ in bins], pa.int64()), pa.array(fills, pa.int32()), pa.array(bins, _BIN.field("members").type)], schema=_BIN)


def _numbers(round_no: int):
    """Sequence numbers that no other task of this or another round gives."""
    n = (round_no << 58) | (TaskContext.get().partitionId() << 32)
    while True:
        yield n
        n += 1


def _local_round(capacity: int, vocabulary: str):
    def run(batches):
        encode, number, members = encoder(vocabulary), _numbers(0), []

        def out():
            packed = best_fit([m["length"] for m in members], capacity)
            return _bins_out([[members[i] for i in b] for b in packed], SLACK, number, capacity)

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = array("I", encode(text or ""))
                ids.append(END_ID)
                data = memoryview(ids.tobytes())
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    members.append({"doc_id": doc, "piece": k, "start": start, "length": length, "ids_crc32": zlib.crc32(data[4 * start : 4 * (start + length)])})
            if len(members) > TASK_BINS:
                yield out()
                members.clear()
        if members:
            yield out()

    return run


def _merge_round(capacity: int, round_no: int, slack: int):
    def run(batches):
        number, held = _numbers(round_no), []

        def out():
            whole = best_fit([sum(m["length"] for m in b) for b in held], capacity)
            merged = [[m for i in b for m in held[i]] for b in whole]
            pieces = [m for b in held for m in b]
            again = best_fit([m["length"] for m in pieces], capacity)
            return _bins_out([[pieces[i] for i in b] for b in again] if len(again) < len(merged) else merged, slack, number, capacity)

        for batch in batches:
            held += batch.column(3).to_pylist()
            if len(held) > TASK_BINS:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents, each with its sequence and its place there.

    Round 0 tokenises and packs within each input partition (best-fit decreasing). Bins with at most SLACK free
    places leave; the others are the items of the next round, which deals them to fewer tasks and packs whole bins
    by best fit, or their pieces again where that needs fewer bins. The slack grows by STEP each round, so that
    what is passed on shrinks; the last round takes what one task can hold. A task never holds more than TASK_BINS
    bins (or pieces, in round 0) at once. Every round is written to the shared folder.

    Null text is empty: one piece that holds the end id alone. Null ids and repeated rows stay, each with pieces of
    its own. Pieces of one length (ties) may stand in any order. Extra columns play no part, whatever their names. An
    empty table gives no rows. Texts over `capacity` ids are cut; the first piece may be shorter.
    """
    state = stash(documents_of(docs, id_col, text_col).mapInArrow(_local_round(capacity, vocabulary), BIN_SCHEMA), "pack-0")
    done, round_no, slack = [state.filter("done")], 0, SLACK
    while True:
        left = state.filter("not done").count()
        if not left:
            break
        round_no, slack = round_no + 1, slack * STEP
        tasks = -(-left // TASK_BINS)
        last = tasks == 1 or slack >= capacity
        state = stash(state.filter("not done").repartition(tasks).mapInArrow(_merge_round(capacity, round_no, capacity if last else slack), BIN_SCHEMA), f"pack-{round_no}")
        done.append(state.filter("done"))
        if last:
            break
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
