"""Queries and operators against plain versions of their definitions."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tidewater.llm import media_clips as M
from tidewater.llm import toxicity as tox
from tidewater.llm.common import hashed_words, run_hashes
from tidewater.llm.decontaminate import find_contamination
from tidewater.llm.html_extract import GAMMA, extract_pages, style_tree
from tidewater.llm.license_scan import BASE_PHRASES, scan_licenses
from tidewater.llm.line_dedup import LONG_LINE, dedup_lines
from tidewater.llm.near_dedup import near_duplicates
from tidewater.llm.packing import encoder, pack
from tidewater.llm.queries import ORACLE_SQL, QUERIES
from tidewater.llm.substring_dedup import remove_repeats

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], DOCS)


def documents(sf=SF):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(con.sql(ORACLE_SQL[name]).columns)
    want = con.sql(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


# ------------------------------------------------------------------ plain versions


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """(id, text) rows -> component of each id; rows of one id count as linked."""
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if comp[a] > comp[b] and x and y and 100 * len(x & y) >= 75 * len(x | y):
                    old = comp[a]
                    comp = {k: comp[b] if v == old else v for k, v in comp.items()}
                    changed = True
    least = {}
    for k, v in comp.items():
        least[v] = min(k, least.get(v, k))
    return {k: least[v] for k, v in comp.items()}


def lines_kept(rows, long_line=None):
    """(id, text) rows in order of place -> kept texts, by the definition of line_dedup."""
    split = [[x for x in (y.strip("\t\n\v\f\r ") for y in (t or "").split("\n")) if x] for _, t in rows]
    seen, out = set(), []
    for (_, text), lines in zip(rows, split):
        gone = set()
        for i in range(len(lines)):
            if i + 1 < len(lines):
                if ("pair", lines[i], lines[i + 1]) in seen:
                    gone |= {i, i + 1}
                seen.add(("pair", lines[i], lines[i + 1]))
            if long_line and len(re.findall(r"[^\x20\x09-\x0D]+", lines[i])) >= long_line and lines[i] in seen:
                gone.add(i)
            seen.add(lines[i])
        out.append((len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or ""))
    return out


def tokens(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items):
    doc, hit = tokens(text), set()
    for item in map(tokens, items):
        w = min(16, len(item))
        need = 13 if len(item) >= 16 else len(item) - len(item) // 8
        for s in range(len(doc) - w + 1) if w else ():
            for q in range(len(item) - w + 1):
                if sum(a == b for a, b in zip(doc[s : s + w], item[q : q + w])) >= need:
                    hit |= set(range(s, s + w))
    return len(hit)


# ------------------------------------------------------------------ operators


@pytest.mark.parametrize("turn", [1, -1])
def test_rows_that_share_an_id_keep_their_links(spark, turn):
    base = [f"w{i}" for i in range(60)]
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(base)
    c = " ".join([*base[:30], "other", *base[31:]])
    rows = [(1, b), (1, a), (2, c), (3, "alone here")][::turn]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)} and {k: v for k, v in components(rows).items()} == {1: 1, 2: 1, 3: 3}


def test_a_family_of_a_template_and_chains_of_copies(spark):
    """Texts that share much but less than enough, with links that only some pairs have."""
    rng = np.random.default_rng(11)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[at] = f"x{i if i % 2 else int(rng.integers(6))}_{at}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows)).collect()}
    want = components(rows)
    assert got == want and len(set(want.values())) > 5


def test_line_runs_equal_a_plain_version(spark):
    rng = np.random.default_rng(2)
    pool = [f"line {i}" for i in range(30)] + [" ".join(f"v{k}{j}" for j in range(40)) for k in range(3)]
    rows = [(i, "\n".join(rng.choice(pool, int(rng.integers(0, 12))))) for i in range(40)]
    for long_line in (None, LONG_LINE):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in dedup_lines(docs(spark, rows), long_line=long_line).collect()}
        assert got == {i: k for (i, _), k in zip(rows, lines_kept(rows, long_line))}


def test_rows_that_repeat_an_id_and_a_text_are_copies(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "solo"), (2, "solo"), (3, None), (3, None)]
    got = sorted((r.doc_id, r.n_removed, r.longest_repeat, r.kept) for r in dedup_lines(docs(spark, rows)).collect())
    assert got == [(1, 0, 2, "a\nb\nc"), (1, 3, 2, ""), (1, 3, 2, ""), (2, 0, 1, "solo"), (2, 0, 1, "solo"), (3, 0, 0, ""), (3, 0, 0, "")]


@pytest.mark.parametrize("window", [3, 10, 35, 50])
def test_windows_of_any_length(spark, window):
    rng = np.random.default_rng(window)
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join([*(f"u{i}_{j}" for j in range(int(rng.integers(0, 30)))), *passage[int(rng.integers(0, 30)) : int(rng.integers(40, 90))], *(["z"] * int(rng.integers(0, 60)))])) for i in range(14)]
    rows += [(90, rows[3][1]), (91, "z " * 500), (92, None), (93, " ".join(passage))]
    seen = {}
    for i, t in rows:
        w = (t or "").split()
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((i, s))
    gone = {(i, s + k) for places in seen.values() if len(places) > 1 for i, s in places for k in range(window)}
    got = {r.doc_id: (r.n_words, r.kept) for r in remove_repeats(docs(spark, rows), window=window).collect()}
    assert got == {i: (len((t or "").split()), " ".join(w for k, w in enumerate((t or "").split()) if (i, k) not in gone)) for i, t in rows}


def test_short_items_and_repeated_words(spark):
    items = ["q1 q2 q3", "one", "a b c d e f g h", "r " * 40, " ".join(f"i{k}" for k in range(30))]
    rows = [(1, "so q1 q2 q3 there"), (2, "q1 q2 xx q3"), (3, "One"), (4, "a b c d x f g h"), (5, "a b x d x f g h"), (6, "r " * 100), (7, " ".join(f"i{k}" for k in range(4, 22))), (8, None)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.n_contaminated for r in find_contamination(docs(spark, rows), bench).collect()}
    assert got == {i: contaminated(t, items) for i, t in rows} and got[6] == 100 and got[2] == 0 and got[4] == 8


def test_licence_places_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    words = ["MIT", "License", "apache", "general", "PUBLIC", "license", "é", "x1"]
    rows = [(i, "".join(str(rng.choice(words)) + str(rng.choice([" ", "-", ". ", "\n\n", "_"])) for _ in range(int(rng.integers(0, 60))))) for i in range(50)]
    for r in scan_licenses(docs(spark, rows)).collect():
        w = tokens(rows[r.doc_id][1])
        places = [(s, label) for phrase, label in BASE_PHRASES.items() for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split()]
        at = [s for s, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_ids_of_all_small_documents_are_those_of_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    contract = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*documents(), (10**6, "a <|endoftext|> b<|endoftext|>"), (10**6 + 1, "   x\r\n\r\n  y \U0001f600́")]
    ids = {i: [*contract.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    assert all([*encoder()(t or ""), 0] == ids[i] for i, t in rows)
    pieces = pack(docs(spark, rows)).collect()
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], np.uint32).tobytes())
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    # A plain best fit over all pieces at once needs hardly fewer sequences.
    free = []
    for size in sorted((p.length for p in pieces), reverse=True):
        fits = [f for f in free if f >= size]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - size)
        else:
            free.append(2048 - size)
    assert len({p.sequence_id for p in pieces}) <= len(free) + 1


def test_style_tree_equals_counts_by_hand(spark):
    bodies = [f"<div class='m'>same</div><div class='s'>{i % 2}</div><p>text {i}</p>" for i in range(8)]
    pages = spark.createDataFrame([(i, "http://h/x", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    got = sorted((r.n_pages, round(r.presentation, 6), round(r.content, 6), round(r.importance, 6)) for r in style_tree(pages).collect())
    weight = 1 - GAMMA  # every branch has one presentation
    half = np.log(2) / np.log(8)
    by = lambda c: (8, 0.0, round(c, 6), round((1 - weight) * c, 6))
    assert got == sorted([by(1.0), by(1.0), by(0.0), by(half), by(1.0)])
    assert extract_pages(pages).filter("page_id = 3").first().text == "text 3"  # a branch with two contents on eight pages stays just below LEAST


def test_lossless_frames_of_another_maker():
    """Frames of 5 x 3 with another Huffman table and the predictor above."""
    frame = np.array([[10, 200, 0, 255, 255], [11, 11, 11, 90, 1], [7, 7, 7, 7, 8]], np.uint8)
    table = bytes([0]) + bytes([0, 0, 0, 9] + [0] * 12) + bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])
    code = {s: f"{i:04b}" for i, s in enumerate([8, 7, 6, 5, 4, 3, 2, 1, 0])}
    before = np.vstack([[128, *frame[0, :-1]], frame[:-1]]).astype(int)
    bits = ""
    for d in (frame.astype(int) - before).ravel():
        s = int(abs(d)).bit_length()
        bits += code[s] + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
    scan = M.Scan(3, 5, 2, table, np.packbits([int(b) for b in bits + "1" * (-len(bits) % 8)]).tobytes())
    assert (M._decode_frame(scan) == frame).all()


def test_clips_report_what_cannot_be_read(spark):
    good = M.write_avi(M.pad_payload(b"a" * 576 + b"\xf0" * 576))
    dct = good.replace(b"\xff\xc3", b"\xff\xc0")
    df = spark.createDataFrame([(1, good), (2, b"nothing"), (3, None), (4, dct), (5, good[:200]), (1, good)], "doc_id long, media binary")
    rows = M.clip_rows(df).collect()
    assert [(r.first_frame, r.last_frame, r.start_s, r.end_s) for r in rows if r.doc_id == 1] == [(0, 2, 0.0, 0.25), (3, 5, 0.25, 0.5)] * 2
    assert {r.doc_id: r.clip for r in rows if r.error} == {2: None, 4: None, 5: None} and "process 0" in next(r.error for r in rows if r.doc_id == 4)
    assert M.clip_rows(df.limit(0)).count() == 0


def test_shots_stand_where_histograms_change():
    frames = np.zeros((40, 12, 16), np.uint8)
    frames[10:25] = 100
    frames[25:] = 200
    assert M.find_shots(frames) == [(0, 9), (10, 24), (25, 39)] and M.find_shots(frames[:1]) == [(0, 0)] and M.find_shots(frames[:0]) == []


def test_every_weight_and_input_has_its_gradient():
    rng = np.random.default_rng(1)
    w = {k: v.astype(float) for k, v in tox.new_weights(rng).items()}
    w["v"] += rng.standard_normal(w["v"].shape) / 4
    inputs, rows = rng.standard_normal((7, tox.INPUTS)), rng.integers(0, 7, (4, tox.WINDOW))
    cast = lambda: {k: v.astype(np.float32) for k, v in w.items()}
    total = lambda: float(tox.forward(cast(), tox.project(cast(), inputs.astype(np.float32)), rows).sum())
    run = tox.forward(cast(), tox.project(cast(), inputs.astype(np.float32)), rows, keep=True)
    g = tox.gradients(cast(), inputs.astype(np.float32), rows, np.ones(4, np.float32), run)
    for name, array, grads in [*((k, w[k], g[k]) for k in w), ("inputs", inputs[:, -tox.EMBED :], g["inputs"])]:
        for at in {tuple(int(rng.integers(n)) for n in array.shape) for _ in range(6)}:
            keep = array[at]
            array[at] = keep + 1e-2
            up = total()
            array[at] = keep - 1e-2
            down = total()
            array[at] = keep
            assert abs((up - down) / 2e-2 - grads[at]) < 3e-2 * max(1, abs(grads[at])), name


def test_embeddings_of_words():
    counts, which, hashes, (letters, begin) = tox.words_of([b"abc ab abc", b""])
    e = tox.Embeddings(np.sort(hashes), np.arange(3 * tox.EMBED, dtype=np.float32).reshape(3, -1), np.ones((tox.CHAR_SLOTS, tox.EMBED), np.float32))
    got = e.of(e.places(hashes, letters, begin))
    assert (got == e.words[1:] + 1).all()  # each of the two words has trigrams, all ones
    part = e.places(hashes, letters, begin).take(np.array([1, 0, 1]))
    assert (e.of(part) == got[[1, 0, 1]]).all() and list(counts) == [3, 0] and len(which) == 3


# ------------------------------------------------------------------ the pipeline


def test_pipeline_equals_a_chain_of_plain_versions(spark, tmp_path):
    rng = np.random.default_rng(9)
    word = lambda: f"w{int(rng.integers(900))}"
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(prose(12) for _ in range(int(rng.integers(1, 6))))))
    bad = [100 + i for i in range(40)]
    rows += [(i, prose(10) + " vileword nastyword " + prose(8)) for i in bad]
    item = prose(24)
    run_ = prose(9) + "\n" + prose(9)
    rows += [(200, run_ + "\n" + prose(30)), (201, prose(30) + "\n" + run_), (202, prose(20) + " " + item), (203, ""), (204, None)]
    base = [word() for _ in range(80)]
    rows += [(210, " ".join(base)), (211, " ".join([*base[:40], "new", *base[41:]])), (212, run_)]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for i, t in rows], schema), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [i for i, _ in rows], "quality": [1] * len(rows), "toxic": [int(i in bad) for i, _ in rows]}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")

    left = [(i, t) for i, t in rows if i not in bad]
    left = [(i, k) if gone else (i, t) for (i, t), (n, gone, k) in zip(left, lines_kept(left, LONG_LINE)) if not n or gone < n]
    comp = components(left)
    left = [(i, t) for i, t in left if comp[i] == i]
    left = [(i, t) for i, t in left if not contaminated(t, [item])]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == {i: len(encoder()(t or "")) + 1 for i, t in left}
    assert {201, 202, 211, 212}.isdisjoint(got) is False and not {202, 211, 212} & set(got) and 201 in got
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_media_columns_equal_their_definition(spark):
    texts = dict(documents())
    for r in QUERIES["op9_media_clips"](spark, SF).collect():
        data = (texts[r.doc_id] or "").encode()
        whole = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))


def mirrored(n: int) -> tuple[str, str]:
    """The sequence abba baab ... of n letters, and the same with a and b exchanged: alike under any polynomial hash
    modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 64, 1024, 2048, 4096])
def test_mirrored_sequences_are_told_apart(spark, n):
    left, right = mirrored(n)
    hashes = [hashed_words(x.encode(), lower=True) for x in (left, right)]
    assert hashes[0][0] != hashes[1][0]
    runs = [run_hashes(hashed_words(" ".join(x).encode(), lower=True), n) for x in (left, right)]
    assert runs[0][0] != runs[1][0]
    near = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, [(1, left), (2, right), (3, " ".join(left))])).collect()}
    assert near[1] == 1 and near[2] == 2 and near[3] == 3
    lines = {r.doc_id: r.n_removed for r in dedup_lines(docs(spark, [(1, left + "\nsecond line"), (2, right + "\nsecond line")]), long_line=1).collect()}
    assert lines == {1: 0, 2: 1}
    swapped = {r.doc_id: r.n_removed for r in remove_repeats(docs(spark, [(1, " ".join(left)), (2, " ".join(right))]), window=n).collect()}
    assert swapped == {1: 0, 2: 0}
    bench = spark.createDataFrame([(7, left)], "item_id long, text string")
    assert [r.n_contaminated for r in find_contamination(docs(spark, [(1, left), (2, right)]), bench).orderBy("doc_id").collect()] == [1, 0]
