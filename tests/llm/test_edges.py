"""Each operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import time

import numpy as np

import corpus_pipeline
from tidewater.llm import toxicity as tox
from tidewater.llm.decontaminate import find_contamination, without_contaminated
from tidewater.llm.html_extract import extract_pages, main_text, parse, style_nodes
from tidewater.llm.license_scan import _automaton, scan_licenses, scan_text
from tidewater.llm.line_dedup import dedup_lines, digest_lines, without_later_copies
from tidewater.llm.media_clips import encode_media, media_digest
from tidewater.llm.near_dedup import near_duplicates, one_of_each_group
from tidewater.llm.packing import pack
from tidewater.llm.substring_dedup import remove_repeats
from tidewater.llm.url_filter import judge_urls

#: Names that operators use inside.
NAMES = "key rest hits row rep comp hub gone_id again_id kept n_rows repeat starts singles places seeds text_ perhaps_ bucket_ place_ low doc".split()
DOCS = "doc_id long, text string, n_chars long, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES)
VERY_LONG = " ".join(f"w{i % 70_001}" for i in range(200_000))
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "no id"), (None, "no id"), (5, VERY_LONG), (6, "same text of six words here"), (6, "same text of six words here"), (7, "same text of six words here"), (8, "é ü 漢字 \U0001f600"), (9, VERY_LONG)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "en", "s", *NAMES) for i, t in rows], DOCS)


BENCH = [(1, None), (None, "a b c d e f g h i"), (2, "")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def test_results_on_edge_rows(spark):
    df = docs(spark, ROWS)
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
    near = order((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert near == order([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (None, None, None), (None, None, None), (5, 5, True), (6, 6, True), (6, 6, True), (7, 6, False), (8, 8, True), (9, 5, False)])
    n = len(VERY_LONG.split())
    cut = order((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert cut == order([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (None, 2, 0), (None, 2, 0), (5, n, n), (6, 6, 0), (6, 6, 0), (7, 6, 0), (8, 4, 0), (9, n, n)])
    lines = order((r.doc_id, r.n_lines, r.n_removed) for r in dedup_lines(df, long_line=35).collect())
    assert lines == order([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (None, 1, 0), (None, 1, 0), (5, 1, 0), (6, 1, 0), (6, 1, 0), (7, 1, 0), (8, 1, 0), (9, 1, 1)])
    assert digest_lines(df).count() == len(ROWS)
    found = order((r.doc_id, r.n_words, r.n_contaminated) for r in find_contamination(df, bench(spark)).collect())
    assert [r[2] for r in found] == [0] * len(ROWS)
    scan = order((r.doc_id, r.n_words, r.n_base, r.labels, r.score) for r in scan_licenses(df).collect())
    assert [(r[2:]) for r in scan] == [(0, "", 0.0)] * len(ROWS)
    media = media_digest(encode_media(df)).collect()
    assert {r.n_bytes for r in media if r.doc_id in (1, 2)} == {0} and len({r.media_sha256 for r in media if r.doc_id in (6, 7)}) == 1
    model = tox.fit([], np.empty(0, bool))
    scores = tox.score_toxicity(df, spark.createDataFrame([], "doc_id long, toxic int"), model=model).collect()
    assert len({r.score for r in scores}) == 1 and {r.predicted for r in scores} == {0}
    pieces = pack(df).collect()
    assert sorted(p.length for p in pieces if p.doc_id in (1, 2)) == [1, 1] and sum(p.doc_id == 6 for p in pieces) == 2


def test_stages_keep_columns_values_and_clean_rows(spark):
    df = docs(spark, ROWS)
    whole = {tuple(r) for r in df.collect()}
    count = lambda out: sorted(str(r.doc_id) for r in out)
    model = tox.fit([], np.empty(0, bool))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    left = one_of_each_group(df).collect()
    assert count(left) == sorted(["1", "2", "3", "4", "None", "None", "5", "6", "8"]) and {tuple(r) for r in left} <= whole
    left = without_later_copies(df).collect()
    assert count(left) == sorted(["1", "2", "3", "4", "None", "None", "5", "6", "6", "7", "8"]) and {tuple(r) for r in left} <= whole
    for stage in (lambda d: without_contaminated(d, bench(spark)), lambda d: tox.without_toxic(d, labels, model=model)):
        left = stage(df).collect()
        assert sorted(map(str, left)) == sorted(map(str, df.collect()))
    none = df.limit(0)
    for stage in (one_of_each_group, without_later_copies, lambda d: without_contaminated(d, bench(spark)), lambda d: tox.without_toxic(d, labels, model=model)):
        assert stage(none).columns == df.columns and stage(none).count() == 0
    assert pack(none).count() == 0 and remove_repeats(none).count() == 0 and near_duplicates(none).count() == 0 and digest_lines(none).count() == 0


def test_ties_among_packed_pieces_lose_nothing(spark):
    pieces = pack(docs(spark, [(i, "same words again") for i in range(300)])).collect()
    assert sorted(p.doc_id for p in pieces) == list(range(300)) and len({p.length for p in pieces}) == 1


PAGES = "page_id long, url string, html string, host string, path string, low string, rule string, text string"


def test_pages_on_edge_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "<p>word </p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "http://h/x", "<p>t"), (3, "http://h/x", "<p>t"), (None, "nothing", "a < b"), (4, "http://h/y", deep), (5, "http://H/z#a", long)]
    pages = spark.createDataFrame([(*r, "h", "p", "l", "r", "t") for r in rows], PAGES)
    got = sorted(((str(r.page_id), r.text[:9], r.n_chars) for r in extract_pages(pages).collect()))
    assert got == sorted([("1", "", 0), ("2", "", 0), ("3", "t", 1), ("3", "t", 1), ("None", "a < b", 5), ("4", "deep", 4), ("5", "word\n\nwor", 20_000 * 6 - 2)])
    judged = sorted((str(r.page_id), r.host, r.path, r["rule"], r.verdict) for r in judge_urls(pages).collect())
    assert judged == [("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "h", "/x", None, "allow"), ("3", "h", "/x", None, "allow"), ("4", "h", "/y", None, "allow"), ("5", "h", "/z", None, "allow"), ("None", "", "", None, "allow")]
    none = pages.limit(0)
    assert extract_pages(none).count() == 0 and judge_urls(none).count() == 0
    tie = judge_urls(pages.limit(1).selectExpr("1L as page_id", "'http://a.b/x/' as url"), rules=[("block", "b", "/x/"), ("allow", "a.b", "/x")]).first()
    assert (tie["rule"], tie.verdict) == ("a.b/x", "allow")  # the longer one
    same = judge_urls(pages.limit(1).selectExpr("1L as page_id", "'http://b/x' as url"), rules=[("block", "b", "/x"), ("allow", "b", "/x")]).first()
    assert same.verdict == "allow"  # of one host and path the last one


def test_deep_pages_and_many_phrases_take_linear_time():
    began = time.process_time()
    root = parse("<body>" + "<div>" * 4000 + "x" + "</div>" * 4000)
    assert len(style_nodes(root)) == 4001 and main_text(root, frozenset()) == "x"
    assert scan_text(b"mit license " * 80_000, _automaton())[1] == 80_000
    assert time.process_time() - began < 5


def test_words_of_a_class_decide_together():
    page = '<article><h1>T</h1><div class="notice-period"><p>Two months.</p></div><div id="comments-on-law"><p>Prose.</p></div><div class="comment-list"><p>no</p></div><div class="notice">no</div></article>'
    assert main_text(parse(page), frozenset()) == "T\n\nTwo months.\n\nProse."
    assert main_text(parse("<body><nav>n</nav><p>Lead.</p><article><p>Body.</p></article><p class='ad'>a</p><footer>f</footer>"), frozenset()) == "Lead.\n\nBody."


def test_stage_docstrings_state_the_cases():
    for _, stage in corpus_pipeline.STAGES:
        text = stage.__doc__.lower()
        assert all(word in text for word in ("null", "empty", "long", "repeated", "names"))


def test_empty_tables_and_unreadable_media(spark):
    from pyspark.sql import functions as F

    none = docs(spark, [])
    assert scan_licenses(none).collect() == encode_media(none).collect() == media_digest(encode_media(none)).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.score_toxicity(none, labels).collect() == []
    media = encode_media(docs(spark, [(1, "text"), (2, "text")])).unionByName(spark.createDataFrame([(3, 4, None), (4, 5, bytearray(b"RIFF broken"))], "doc_id long, n_bytes long, media binary"))
    got = {r.doc_id: r for r in media_digest(media.withColumn("feature", F.lit("clash"))).collect()}
    assert got[1].payload_sha256 == got[2].payload_sha256 and got[3].media_bytes is None and (got[4].media_bytes, got[4].payload_bytes) == (11, None)


def test_a_very_long_url_and_a_tie(spark):
    url = "https://Sub.Example.com/en/7" + "x" * 300_000 + "?q#f"
    pages = spark.createDataFrame([(1, url, "clash"), (1, url, "clash"), (None, "https://example.net/de/8" + "/a" * 100_000, None)], "page_id long, url string, rule string")
    got = sorted((r.page_id or 0, r.rule, r.verdict) for r in judge_urls(pages).collect())
    assert got == [(0, "example.net/de/8", "block"), (1, "example.com/en/7", "allow"), (1, "example.com/en/7", "allow")]


def test_comments_teasers_and_leads():
    text = lambda page: main_text(parse(page), frozenset())
    assert text('<article><p>Text.</p><section class="user-comments"><p>nice</p></section></article>') == "Text."
    assert text('<article class="card"><p>Teaser</p></article><article><p>Real</p></article>') == "Real"
    assert text('<article class="card"><p>Only</p></article>') == "Only"
    assert text('<div class="lead">Lead in.</div><article><p>Real</p></article>') == "Lead in.\n\nReal"
    assert text('<body class="has-comments"><div class="post no-comments"><article><p>Real</p></article></div></body>') == "Real"
