"""Conversation prefix trie: paths of turns are range-sorted, neighbours' common prefixes are swept into nodes with a
stack, and the stacks that are open at the ends of partitions are stitched together.

A path is one binary value: for each turn a block of 16 bytes of the SHA-256 of its role and text, then 8 bytes with
the length of its text. So paths sort as their sequences of turns do, a prefix before what goes on from it, and the
common prefix of two paths is a number of equal blocks. Texts themselves are read once and never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import stash

ID, BLOCK = 16, 24
#: Bytes of a list of members that travel together, where a node's own members stand in several partitions.
CHUNK = 64 << 10
_ROOT = b"\x00" * ID
_SPINE = "array<struct<n: long, low: long, kids: long, leaves: long, saved: long, ends: binary>>"
_STATS = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
_SWEPT = f"node binary, parent binary, {_STATS}, chunk long, data binary, first_path binary, first_conv long, last_path binary, shared long, before {_SPINE}, after {_SPINE}"


def turn_block(role: Column | str, text: Column | str) -> Column:
    """The block of a turn, in hexadecimal digits; null role or text counts as empty."""
    role, text = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (role, text))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.upper(F.concat(F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * ID), F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (BLOCK - ID), "0")))


def turn_paths(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, path: the turns of each conversation in order of turn (null first; equal turns by their blocks)."""
    turns = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), turn_block(F.col(f"`{role_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).alias("block")).filter("conv_id is not null")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "block")))
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda t: t["block"]), "")).alias("path"))


def spliced(paths: DataFrame, every: int = 5, longest: int = 9) -> DataFrame:
    """conv_id, path of rebuilt conversations: the first h turns are those of conversation conv_id - conv_id % every
    (all if it has fewer, none if it is absent), the others are its own after its first h, where h is the CRC-32 of the
    decimal conv_id modulo longest. Shared starts of a dialogue tree, as sampled continuations have them."""
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest * BLOCK).cast("int")
    own = paths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("from"), taken.alias("taken"), "path").select("conv_id", "from", "taken", F.expr("substring(path, taken + 1, length(path))").alias("rest"))
    heads = paths.select(F.col("conv_id").alias("from"), F.expr(f"substring(path, 1, {(longest - 1) * BLOCK})").alias("head"))
    whole = F.concat(F.expr("substring(coalesce(head, X''), 1, taken)"), F.col("rest"))
    return own.join(heads, "from", "left").select("conv_id", whole.alias("path"))


def common_blocks(a: bytes, b: bytes) -> int:
    """The number of blocks at the start of both."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // BLOCK
    odd = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(odd.argmax()) // BLOCK


def _text_bytes(path: bytes, depth: int) -> int:
    return int.from_bytes(path[depth * BLOCK - BLOCK + ID : depth * BLOCK], "big") if depth else 0


class _Stack:
    """The open nodes on the way from the root to the path that was read last, the root first. Of each: its key, what it
    holds without the child that is open ([members, least member, children, childless nodes, saved bytes]), the digest
    of its own members if that is final."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.sums: list[list] = []
        self.ends: list[bytes | None] = []
        self.path = b""

    def go(self, path: bytes) -> None:
        """Open the nodes of a path below those that are open."""
        for d in range(len(self.keys), len(path) // BLOCK + 1):
            self.keys.append(hashlib.sha256(self.keys[-1] + path[d * BLOCK - BLOCK : d * BLOCK]).digest()[:ID] if d else _ROOT)
            self.sums.append([0, None, 0, 0, 0])
            self.ends.append(None)
        self.path = path

    def shut(self) -> tuple:
        """Close the deepest node: its row; the node above it takes up what it holds."""
        key, (n, low, kids, leaves, saved), ends = self.keys.pop(), self.sums.pop(), self.ends.pop()
        depth = len(self.keys)
        leaves, saved = leaves or 1, saved + (n - 1) * _text_bytes(self.path, depth)
        if depth:
            add(self.sums[-1], (n, low, 1, leaves, saved))
        return key, self.keys[-1] if depth else None, low, depth, n, kids, leaves, saved, ends


def add(sums: list, more) -> None:
    low = more[1] if sums[1] is None else sums[1] if more[1] is None else min(sums[1], more[1])
    sums[:] = [sums[0] + more[0], low, sums[2] + more[2], sums[3] + more[3], sums[4] + more[4]]


def _spine(sums, ends) -> list[dict]:
    return [dict(zip(("n", "low", "kids", "leaves", "saved", "ends"), (*s, e))) for s, e in zip(sums, ends)]


class _Out:
    """Rows of several kinds, gathered into batches of bounded size."""

    names = [c.split()[0] for c in "node parent conv_id depth n_convs n_children n_leaves saved_tokens ends chunk data first_path first_conv last_path shared before after".split()]
    spine = pa.list_(pa.struct([(c, pa.int64()) for c in ("n", "low", "kids", "leaves", "saved")] + [("ends", pa.binary())]))
    types = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), spine, spine]

    def __init__(self, n: int = 17):
        self.rows, self.n = [], n

    def put(self, **values) -> None:
        self.rows.append(tuple(values.get(c) for c in self.names[: self.n]))

    def batch(self):
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows) if self.rows else [[]] * self.n, self.types)], names=self.names[: self.n])
        self.rows = []
        return out


def sweep(batches):
    """Sorted (path, conv_id) rows of one partition -> its finished nodes, what its first and last paths leave open
    (one row), and the members of nodes whose own members reach to an end of the partition, in chunks."""
    out, stack, first = _Out(), _Stack(), None
    left: list[tuple[list, bytes | None]] = []  # the nodes of the first path that were closed, deepest first
    shared = 0  # blocks that all rows so far have in common with the first
    digest, members, size, sent, at_first = None, [], 0, 0, False

    def send() -> None:
        nonlocal members, size, sent
        out.put(node=stack.keys[-1], chunk=sent, data=",".join(members).encode(), first_path=first[0], first_conv=first[1])
        members, size, sent = [], 0, sent + 1

    def next_path(path: bytes) -> None:
        nonlocal digest, members, size, sent, at_first, shared
        if members:  # the end of a run of equal paths
            if at_first:
                send()
            else:
                digest.update(",".join(members).encode())
                stack.ends[-1] = digest.digest()
        common = common_blocks(stack.path, path)
        while len(stack.keys) > common + 1:
            depth = len(stack.keys) - 1
            if depth <= shared:  # on the first path: what stood before the partition may belong to it
                left.append((stack.sums.pop(), stack.ends.pop()))
                stack.keys.pop()
            else:
                out.put(**dict(zip(out.names, stack.shut())))
        shared = min(shared, common)
        stack.go(path)
        digest, members, size, sent, at_first = hashlib.sha256(), [], 0, 0, False

    for batch in batches:
        for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if first is None:
                first, shared = (path, conv), len(path) // BLOCK
                stack.go(path)
                at_first, digest = True, hashlib.sha256()
            elif path != stack.path:
                next_path(path)
            add(stack.sums[-1], (1, conv, 0, 0, 0))
            members.append(str(conv))
            size += 20
            if size >= CHUNK:
                # A run at an end of the partition goes on as chunks; which run is the last isn't known yet, so a long
                # run is written in chunks anyway.
                send()
                at_first = True
            if len(out.rows) >= 4096:
                yield out.batch()
    if first is not None:
        if members:
            send()
        out.put(first_path=first[0], first_conv=first[1], last_path=stack.path, shared=shared, before=_spine(*zip(*left)) if left else [], after=_spine(stack.sums, stack.ends))
    yield out.batch()


def stitch(batches):
    """The partitions' open ends, in order -> the nodes that they leave open, finished. One row a partition comes in, and
    only the open path is held."""
    out, stack = _Out(9), _Stack()

    def shut_to(depth: int) -> None:
        while len(stack.keys) > depth + 1:
            out.put(**dict(zip(out.names, stack.shut())))

    def take(depth: int, part: dict) -> None:
        add(stack.sums[depth], [part[c] for c in ("n", "low", "kids", "leaves", "saved")])
        stack.ends[depth] = part["ends"] if part["ends"] is not None else stack.ends[depth]

    for batch in batches:
        for row in batch.to_pylist():
            if stack.keys:
                shut_to(common_blocks(stack.path, row["first_path"]))
            stack.go(row["first_path"])
            for i, part in enumerate(row["before"]):
                take(len(row["first_path"]) // BLOCK - i, part)
            shut_to(row["shared"])
            stack.go(row["last_path"])
            for depth, part in enumerate(row["after"]):
                take(depth, part)
            if len(out.rows) >= 4096:
                yield out.batch()
    shut_to(-1)
    yield out.batch()


def _digests(batches):
    """Chunks of members, sorted by node and place -> the SHA-256 of each node's list."""
    node, digest = None, None
    for batch in batches:
        nodes, ends = [], []
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != node:
                if node is not None:
                    nodes.append(node)
                    ends.append(digest.digest())
                node, digest = key, hashlib.sha256(data)
            else:
                digest.update(b"," + data)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(ends, pa.binary())], names=["node", "listed"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.digest()], pa.binary())], names=["node", "listed"])


def trie(paths: DataFrame) -> DataFrame:
    """node, parent (keys of 16 bytes), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, for each distinct prefix of the paths (conv_id, path), the empty one included.

    Paths are sorted by ranges of (path, conv_id), so that a path that a third of all conversations have is dealt to
    many tasks. Each task sweeps its rows with a stack and finishes the nodes that lie within it. Of what is left, the
    nodes on its first and last path, it writes one row; these rows, one for each task, are stitched in order. The
    members of a node that end at its depth stand together in sorted order; their digest is taken as they pass, or, at
    the ends of a task and in long runs, from chunks of 64 KiB that go to one task per node in order. (A SHA-256
    over a list has no parallel form; the task reads chunks one by one and holds none.) Parents are named by a join on
    the node's key, whose many-children side can be split.

    conv_id: the smallest member. saved_tokens: over the node's subtree, the members but one times the bytes of the
    last text. Null paths count as empty. A conversation's blocks (24 bytes a turn) must fit a row. Equal paths need no
    rule, as members are ordered by conv_id. No paths: no rows, not even the root.
    """
    rows = stash(paths.filter("conv_id is not null").select(F.coalesce("path", F.unhex(F.lit(""))).alias("path"), "conv_id"), "trie-paths")
    swept = stash(rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(sweep, _SWEPT), "trie-swept")
    stats = ["node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    summaries = swept.filter("after is not null").select("first_path", "first_conv", "last_path", "shared", "before", "after")
    stitched = summaries.repartition(1).sortWithinPartitions("first_path", "first_conv").mapInArrow(stitch, f"node binary, parent binary, {_STATS}")
    finished = stash(swept.filter("conv_id is not null").select(*stats).unionByName(stitched), "trie-nodes")
    chunks = swept.filter("data is not null").select("node", "data", "first_path", "first_conv", "chunk")
    listed = chunks.repartition("node").sortWithinPartitions("node", "first_path", "first_conv", "chunk").select("node", "data").mapInArrow(_digests, "node binary, listed binary")
    above = finished.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = F.lower(F.hex(F.coalesce("listed", "ends", F.unhex(F.lit(hashlib.sha256(b"").hexdigest())))))
    out = finished.join(listed, "node", "left").withColumn("ends_sha256", ends).join(above, "parent", "left")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie (see there) of the conversations as they are.

    Null turns come first, equal ones (repeated rows too: each is a turn) in the order of their blocks. Null role or
    text is empty. Rows without a conv_id belong to no conversation. Very long texts count whole, as 16 bytes of their
    SHA-256. Extra columns play no part, whatever their names. An empty table gives no rows.
    """
    return trie(turn_paths(conversations, conv_col, turn_col, role_col, text_col))


def spliced_trie(conversations: DataFrame, every: int = 5, longest: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of rebuilt conversations (see spliced); cases as in conversation_trie."""
    return trie(spliced(stash(turn_paths(conversations, conv_col, turn_col, role_col, text_col), "trie-turns"), every, longest))
