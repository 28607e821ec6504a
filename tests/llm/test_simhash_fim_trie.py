"""SimHash, fill-in-middle and the prefix trie against plain versions of their definitions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from tidewater.llm import fill_middle, prefix_trie, simhash
from tidewater.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
LONG = "wort " * 40_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], DOCS)


def documents():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=3):
    """(id, fingerprint) -> the least id of each id's component."""
    comp = {i: i for i, _ in rows}
    find = lambda i: i if comp[i] == i else find(comp[i])
    for n, (i, f) in enumerate(rows):
        for j, g in rows[:n]:
            if (f ^ g).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: find(i) for i in comp}


@pytest.mark.parametrize(("parts", "tile"), [(None, simhash.TILE), (4, 8), (6, 3)])
def test_simhash_of_the_documents(spark, parts, tile):
    rows = [(i, plain_fingerprint(t)) for i, t in documents()]
    comp = plain_components(rows)
    got = simhash.simhash_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), parts=parts, tile=tile).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", comp[i]) for i, f in rows)
    assert len(set(comp.values())) < len(comp)


@pytest.mark.parametrize("parts", [1, 2, 4, 6, 8])
def test_tiles_lose_no_link(spark, parts):
    """Words that are drawn around a few centres, so that many lie at distances of 0 to 6 bits."""
    rng = np.random.default_rng(parts)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 6)] + [0, (1 << 64) - 1]
    near = {c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for c in centres for _ in range(25)}
    rows = [(x - (1 << 64) if x >> 63 else x, x) for x in sorted(near)]
    frame = spark.createDataFrame([(s,) for s, _ in rows], "fp long")
    found = simhash.links(frame, parts=parts, tile=16).collect()
    comp = {s: s for s, _ in rows}
    find = lambda i: i if comp[i] == i else find(comp[i])
    for a, b in found:
        assert ((a ^ b) & ((1 << 64) - 1)) and a in comp and b in comp
        low, high = sorted((find(a), find(b)))
        comp[high] = low
    assert {s: find(s) for s in comp} == plain_components(rows)


def test_links_of_a_dense_tile_are_no_more_than_its_rows():
    words = np.array([sum(1 << b for b in (i, j) if b >= 0) for i in range(-1, 20) for j in range(i)], np.uint64)
    a, b = simhash.linked(words, words, 3)
    assert len(a) <= 2 * len(words) and len(np.unique(np.concatenate([a, b]))) == len(np.unique(words))


def test_simhash_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One TWO three"), (5, "one two\nthree"), (6, "one two"), (None, "one two three"), (7, LONG), (7, "one two three"), (8, LONG), (9, "a b a b"), (9, "a b a b")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_duplicates(docs(spark, rows)).collect()), key=str)
    hexed = lambda t: f"{plain_fingerprint(t):016x}"
    same = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, None: None, 7: 4, 8: 4, 9: 9}
    assert got == sorted(((i, hexed(t), same[i]) for i, t in rows), key=str)
    assert simhash.simhash_duplicates(docs(spark, [])).collect() == []
    odd = spark.createDataFrame([(1, "x y z", 5, "a"), (2, "x y z", 6, "b")], "doc_id long, text string, fp long, component_id string")
    assert sorted(r.component_id for r in simhash.simhash_duplicates(odd).collect()) == [1, 1]


# ------------------------------------------------------------------ fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, middle, tail = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}"
    return doc_id, n, "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}"


ODD = ["", None, "a", "é", "aé", "日本語 text", "no<P>mark", "x<M>", "tail<S>", "ab" * 300, "12 34", "\r\n\t x", "áb", "😀😀 ok 😀", "<P", "<<S", LONG]


@pytest.mark.parametrize(("chunk", "long_text"), [(fill_middle.CHUNK, fill_middle.LONG_TEXT), (1, 5), (3, 1), (7, 64)])
def test_fill_in_middle(spark, chunk, long_text):
    texts = [t for t in ODD if long_text > 5 or t is None or len(t) < 1000]
    rows = [(i, t) for i, t in enumerate(texts * 8)] + [(None, "no id"), (3, "ab cd"), (3, "ab cd"), (3, "other")] + (documents()[:60] if long_text > 5 else [])
    want = sorted((plain_fim(i, t) for i, t in rows), key=str)
    found = fill_middle.fill_in_middle(docs(spark, rows), chunk=chunk, long_text=long_text)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    back = found.withColumn("text", fill_middle.restored(found.output, found.form)).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*plain_fim(i, t)[:5], sha(plain_fim(i, t)[5]), sha(t or "")) for i, t in documents()]
    assert sorted((tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, SF).collect()), key=str) == sorted(want, key=str)


def test_fill_in_middle_cases(spark):
    assert fill_middle.fill_in_middle(docs(spark, [])).collect() == []
    odd = spark.createDataFrame([(1, "x y z", 5, "a")], "doc_id long, text string, h1 long, digest string")
    assert fill_middle.fill_in_middle(odd).first().doc_id == 1


# ------------------------------------------------------------------ prefix trie


def plain_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c].sort(key=lambda t: (t[:2], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()))
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(t[2:] for t in own.get(c - c % 5, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in sorted(built.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    rows = []
    for node, m in members.items():
        under = [x for x in members if x[: len(node)] == node]
        ends = ",".join(str(c) for c in m if built[c] == node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        rows.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), sum(x not in kids or not kids[x] for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(spark, turns, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = prefix_trie.spliced_trie(spark.createDataFrame(turns, TURNS)).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted((tuple(r) for r in rows), key=str)


def random_turns(seed, n, hot):
    """Conversations over few different turns, so that they share starts; hot: the share that has one content."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        same = rng.random() < hot
        for t in range(3 if same else int(rng.integers(0, 14))):
            out.append((c, t, "ab"[t % 2], f"hot {t}" if same else f"t{int(rng.integers(0, 2))}"))
    return out


@pytest.mark.parametrize(("seed", "n", "hot", "partitions"), [(1, 60, 0.0, 1), (2, 120, 0.4, 7), (3, 300, 0.9, 23), (4, 40, 0.3, 40)])
def test_trie(spark, monkeypatch, seed, n, hot, partitions):
    monkeypatch.setattr(prefix_trie, "CHUNK", 100)
    turns = random_turns(seed, n, hot)
    assert found_trie(spark, turns, partitions) == plain_trie(turns)


def test_trie_of_the_conversations(spark):
    t = pq.read_table(f"{SF}/conversations.parquet").to_pydict()
    turns = list(zip(t["conv_id"], t["turn"], t["role"], t["text"]))
    assert sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, SF).select(*COLUMNS).collect()), key=str) == plain_trie(turns)


def swept_nodes(parts):
    """The nodes of sorted (path, conv_id) rows that are dealt into parts, without Spark."""
    rows = []
    for part in filter(None, parts):
        batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.binary()), pa.array([c for _, c in part])], names=["path", "conv_id"])
        rows += [r for b in prefix_trie.sweep([batch]) for r in b.to_pylist()]
    names = ["first_path", "first_conv", "last_path", "shared", "before", "after"]
    ends = pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in rows if r["after"] is not None])
    done = [r for r in rows if r["conv_id"] is not None] + [r for b in prefix_trie.stitch([ends]) for r in b.to_pylist()]
    chunks = defaultdict(list)
    for r in sorted((r for r in rows if r["data"] is not None), key=lambda r: (r["first_path"], r["first_conv"], r["chunk"])):
        chunks[r["node"]].append(r["data"])
    stats = ["node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return sorted(([r[c] for c in stats] + [hashlib.sha256(b",".join(chunks[r["node"]])).digest() if r["node"] in chunks else r["ends"]] for r in done), key=str)


def test_sweep_and_stitch_under_every_cut(monkeypatch):
    """Sorted paths, cut into three at every two places, give the same nodes as in one piece."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 30)
    block = lambda x: bytes([x]) * 16 + x.to_bytes(8, "big")
    paths = sorted((b"".join(map(block, p)), c) for c, p in enumerate([(), (1,), (1,), (1,), (1,), (1, 2), (1, 2, 3), (1, 2, 3), (1, 4), (2,), (2,), (3, 1), (3, 1, 1), (3, 2)]))
    whole = swept_nodes([paths])
    assert len(whole) == 10
    for i in range(len(paths) + 1):
        for j in range(i, len(paths) + 1):
            assert swept_nodes([paths[:i], paths[i:j], paths[j:]]) == whole


def test_trie_cases(spark):
    turns = [(None, 0, "a", "x"), (1, None, None, None), (1, 0, "a", "x"), (1, 0, "a", "x"), (2, 5, "a", None), (7, 0, "a", LONG), (7, 1, "a", "y"), (-3, 0, "b", "neg"), (5, 0, "b", "five")]
    expected = plain_trie([t for t in turns if t[0] is None or t[0] >= 0])
    assert found_trie(spark, [t for t in turns if t[0] is None or t[0] >= 0], 5) == expected
    assert found_trie(spark, turns, 5)  # negative ids: conv_id % 5 has the sign of conv_id
    assert found_trie(spark, [], 3) == []
    odd = spark.createDataFrame([(1, 0, "a", "x", "p", 3)], TURNS + ", path string, node int")
    assert prefix_trie.conversation_trie(odd).count() == 2
