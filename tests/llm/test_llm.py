"""Training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidewater.llm import toxicity as tox
from tidewater.llm.common import with_rest
from tidewater.llm.decontaminate import MASKS, find_contamination, without_contaminated
from tidewater.llm.html_extract import extract_pages, main_text, parse, style_tree
from tidewater.llm.license_scan import read_expression, scan_licenses
from tidewater.llm.line_dedup import dedup_lines, without_later_copies
from tidewater.llm.media_clips import clip_rows, encode_media, media_digest, pad_payload, read_frames, write_avi
from tidewater.llm.near_dedup import near_duplicates, one_of_each_group
from tidewater.llm.packing import encoder, pack
from tidewater.llm.substring_dedup import remove_repeats
from tidewater.llm.url_filter import judge_urls

DOCS = "doc_id long, text string, key string, rest string, hits string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(3000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", "r", "h", len(t or "")) for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "no id here"), (5, LONG), (6, "same text"), (6, "same text"), (7, "é ü 漢字 \U0001f600")]


def test_every_operator_takes_edge_rows(spark):
    df, none = docs(spark, EDGE), docs(spark, [])
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f g h i"), (2, "")], "item_id long, text string")
    model = tox.fit([], np.empty(0, bool))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for run in (scan_licenses, near_duplicates, remove_repeats, dedup_lines, lambda d: find_contamination(d, bench), lambda d: tox.score_toxicity(d, labels, model=model), lambda d: media_digest(encode_media(d))):
        assert run(df).count() == len(EDGE)
        assert run(none).count() == 0
    assert pack(none).count() == 0 and pack(df).select("doc_id").distinct().count() == 8
    for run in (without_later_copies, one_of_each_group, lambda d: without_contaminated(d, bench), lambda d: tox.without_toxic(d, labels, model=model)):
        assert run(df).columns == df.columns and run(none).count() == 0


def test_rest_keeps_clashing_names(spark):
    assert with_rest(docs(spark, EDGE)).select("rest.key").first()[0] == "k"


def test_licence_expressions():
    assert read_expression("MIT OR (Apache-2.0 AND GPL-3.0-only)") == (["mit", "apache", "gpl"], True)
    assert read_expression("GPL-2.0 WITH Classpath-exception-2.0") == (["gpl"], True)
    assert read_expression("AND MIT") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT or later text", (["mit"], True)),
        ("GPL-2.0 or later", (["gpl"], False)),
        ("GPL-2.0-or-later OR MIT", (["gpl", "mit"], True)),
        ("MIT/Apache-2.0", (["mit", "apache"], True)),
        ("MIT, Apache-2.0 and GPL-3.0-only", (["mit", "apache", "gpl"], True)),
        ("MIT, see the file", (["mit"], True)),
        ("MIT AND GPL-2.0-only", (["mit", "gpl"], False)),
        ("GPL-2.0-only WITH Linux-syscall-note", (["gpl"], False)),
        ("GPL-2.0-only WITH Classpath-exception-2.0", (["gpl"], True)),
        ("GPL-2.0-only with love", (["gpl"], False)),
        ("(MIT OR GPL-2.0-only) AND LicenseRef-Own", (["mit", "gpl", "custom"], False)),
        ("Zlib // a comment", (["zlib"], True)),
        ("mitigation", None),
        ("later or MIT", None),
        ("(MIT or", None),
        ("", None),
    ],
)
def test_licence_operands(text, want):
    assert read_expression(text) == want


def test_licence_places(spark):
    got = scan_licenses(docs(spark, [(1, "The MIT-License, mit license\nGeneral Public License")])).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == (8, 3, 1, 5, "gpl,mit")


def brute_components(texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(int(rng.integers(3, 80)))]
        for c in range(5):
            words = list(base)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = f"z{c}"
            rows.append((g * 10 + c, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_repeated_windows_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"u{i}_{j}" for j in range(int(rng.integers(0, 40)))), *passage[: int(rng.integers(20, 60))], *(f"v{i}_{j}" for j in range(10))])) for i in range(12)]
    seen = {}
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - 34):
            seen.setdefault(tuple(w[s : s + 35]), []).append((i, s))
    gone = {(i, s + k) for places in seen.values() if len(places) > 1 for i, s in places for k in range(35)}
    got = {r.doc_id: r.kept for r in remove_repeats(docs(spark, rows)).collect()}
    assert got == {i: " ".join(w for k, w in enumerate(t.split()) if (i, k) not in gone) for i, t in rows}


def test_later_line_runs_go(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n a\nb \n\nc\ny"), (3, "a\nq"), (4, "a\nb\nc\nd"), (5, "z\nz\nz")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.longest_repeat, r.kept) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: (4, 0, 0, 4, "a\nb\nc\nd"), 2: (5, 3, 1, 2, "x\ny"), 3: (2, 0, 0, 1, "a\nq"), 4: (4, 4, 1, 4, ""), 5: (3, 2, 1, 2, "z")}
    kept = {r.doc_id: (r.text, r.n_chars) for r in without_later_copies(docs(spark, rows)).collect()}
    assert 4 not in kept and kept[2] == ("x\ny", 3) and kept[3] == ("a\nq", 3)


def test_later_long_single_lines_go(spark):
    long, short = (" ".join(f"w{i}" for i in range(n)) for n in (35, 34))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n {long}\nd\n{short}\ne"), (3, long), (4, f"{long}\n{long}")]
    kept = {r.doc_id: (r.text, r.n_chars) for r in without_later_copies(docs(spark, rows)).collect()}
    assert kept == {1: (rows[0][1], len(rows[0][1])), 2: (f"c\nd\n{short}\ne", 6 + len(short))}
    got = {r.doc_id: (r.n_removed, r.n_runs) for r in dedup_lines(docs(spark, rows), long_line=35).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (2, 1)}


def test_masks_miss_no_window_with_three_substitutions():
    from itertools import combinations

    for odd in combinations(range(16), 3):
        assert any(all(o + m not in odd for m in mask) for mask in MASKS for o in range(5))


def test_contamination_with_substitutions(spark):
    item = [f"t{i}" for i in range(20)]
    near = list(item)
    for i in (2, 7, 13):
        near[i] = "other"
    far = list(item)
    for i in range(0, 20, 4):
        far[i] = "other"
    rows = [(1, " ".join(["start", *item, "end"])), (2, "So: " + ", ".join(near).upper()), (3, " ".join(far)), (4, "nothing here"), (5, " ".join(f"s{i}" for i in range(9)))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, "s0 s1 s2 sX s4 s5 s6 s7 s8")], "item_id long, text string")
    got = {r.doc_id: (r.n_contaminated, r["items"]) for r in find_contamination(docs(spark, rows), bench).collect()}
    assert got == {1: (20, [7, 8]), 2: (20, [7, 8]), 3: (0, []), 4: (0, []), 5: (9, [9])}


def test_packing_holds_every_id_once(spark):
    rows = [(i, " ".join(f"tok{i}_{j}" for j in range(i * 13 % 400))) for i in range(60)] + [(99, LONG)]
    pieces = pack(docs(spark, rows)).collect()
    encode = encoder()
    for doc, text in rows:
        ids = np.array([*encode(text), 0], np.uint32)
        mine = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.piece)
        assert [p.start for p in mine] == [0, *np.cumsum([p.length for p in mine])[:-1]] and sum(p.length for p in mine) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in mine)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.02 * sum(p.length for p in pieces) / 2048 + 1


def test_ids_are_those_of_the_json_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    contract = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder()("a<|endoftext|>b") == [64, 50256, 65]
    for text in ("a<|endoftext|>b", " <|endoftext|> \n<|endoftext|><|endoftext|>", "<|endoftext|", "x <|ENDOFTEXT|> it's  12 \u00e9 \u6f22", "", LONG):
        assert encoder()(text) == contract.encode(text, add_special_tokens=False).ids


def test_html_of_a_page():
    page = '<html><head><title>T</title><script>var a="</p>"</script></head><body><header>H</header><nav>N</nav><article><h1>A &amp; B</h1><p>one<br>two  <b>th</b>ree<p>four<div class="comments"><p>no</p></div><form>f</form></article><aside>s</aside><footer>F</footer>'
    assert main_text(parse(page), frozenset()) == "A & B\n\none two three\n\nfour"
    assert main_text(parse("a < b <!-- x"), frozenset()) == "a < b"


def test_style_tree_drops_what_a_site_repeats(spark):
    body = lambda i: f"<body><div class='box'>Same on all pages</div><div class='story'>Story number {i} about {i * i}</div></body>"
    rows = [(i, f"http://h.example/{i}", body(i)) for i in range(6)] + [(90, None, None), (91, "x", ""), (None, "http://h.example/q", body(77)), (92, "http://one.example/", body(5))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    low = {r.n_pages for r in style_tree(pages).filter("importance < 0.3 and n_pages > 4").collect()}
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    assert low == {7} and got[3] == "Story number 3 about 9" and got[90] == "" and got[91] == "" and got[92].startswith("Same on all")
    assert extract_pages(pages.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.com/en/8?q", "https://example.com/en/77", "http://x.net/de/1", "http://example.net/de/8", "ftp://b.org/es/", "no", None, "http://notexample.com/fr/"]
    got = [(r["rule"], r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow")]


def test_media_round_trip(spark):
    rng = np.random.default_rng(1)
    for size in (0, 1, 192, 193, 5000):
        payload = pad_payload(rng.integers(0, 256, size, dtype=np.uint8).tobytes())
        assert read_frames(write_avi(payload))[1].tobytes() == payload
    df = encode_media(docs(spark, [(1, "x" * 192 * 3 + "é" * 288)]))
    row = media_digest(df).first()
    text = ("x" * 576 + "é" * 288).encode()
    assert row.payload_sha256 == hashlib.sha256(text + b" " * (-len(text) % 192)).hexdigest()
    assert clip_rows(df).count() >= 1 and clip_rows(df.selectExpr("doc_id", "cast(null as binary) as media")).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in tox.new_weights(rng).items()}
    w["v"] += 0.1
    inputs, rows = rng.standard_normal((9, tox.INPUTS)), rng.integers(0, 9, (3, tox.WINDOW))
    cast = lambda: {k: v.astype(np.float32) for k, v in w.items()}
    total = lambda: float(tox.forward(cast(), tox.project(cast(), inputs.astype(np.float32)), rows).sum())
    run = tox.forward(cast(), tox.project(cast(), inputs.astype(np.float32)), rows, keep=True)
    g = tox.gradients(cast(), inputs.astype(np.float32), rows, np.ones(3, np.float32), run)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        w[k][at] += 1e-2
        up = total()
        w[k][at] -= 2e-2
        down = total()
        w[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-2 * max(1, abs(g[k][at]))


def test_held_out_accuracy():
    root = "/root/testdata/sf0.1"
    text = dict(zip(*(pq.read_table(f"{root}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    labels = pq.read_table(f"{root}/labels.parquet").to_pydict()
    known = [(d, y) for d, y in zip(labels["doc_id"], labels["toxic"]) if d in text and len(text[d] or "") < 20_000]
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    train = [r for r in known if not held(r[0])][:1500]
    test = [r for r in known if held(r[0])][:800]
    model = tox.fit([(text[d] or "").encode() for d, _ in train], np.array([y == 1 for _, y in train]), epochs=8)
    score = model.score([(text[d] or "").encode() for d, _ in test])
    toxic = np.array([y == 1 for _, y in test])
    assert (score[toxic] >= 0.7).mean() > 0.75 and (score[~toxic] < 0.7).mean() > 0.97
