"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.llm.common import table


def op1_license_scan(spark, sf_dir):
    from tidewater.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")


def op2_near_dedup(spark, sf_dir):
    from tidewater.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    from tidewater.llm.substring_dedup import remove_repeats, with_digest

    return with_digest(remove_repeats(table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark, sf_dir):
    from tidewater.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark, sf_dir):
    from tidewater.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op6_decontamination(spark, sf_dir):
    from tidewater.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_contaminated", F.array_join("items", ",").alias("items"), (F.col("n_contaminated") > 0).alias("contaminated"))


def op7_line_dedup(spark, sf_dir):
    """Later copies of line runs, and of long single lines, as in the pipeline."""
    from tidewater.llm.line_dedup import LONG_LINE, digest_lines

    return digest_lines(table(spark, sf_dir, "documents"), long_line=LONG_LINE)


def line_dedup_runs(spark, sf_dir):
    """Later copies of runs of two lines or more only."""
    from tidewater.llm.line_dedup import digest_lines

    return digest_lines(table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    from tidewater.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op9_media_clips(spark, sf_dir):
    from tidewater.llm.media_clips import encoded_digest

    return encoded_digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    from tidewater.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash_dedup(spark, sf_dir):
    from tidewater.llm.simhash import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    from tidewater.llm.fill_middle import fill_in_middle, with_digests

    return with_digests(fill_in_middle(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark, sf_dir):
    from tidewater.llm.prefix_trie import spliced_trie

    return spliced_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


def media_clips(spark, sf_dir):
    """The timed clips of all documents' media."""
    from tidewater.llm.media_clips import encoded_clips

    return encoded_clips(table(spark, sf_dir, "documents")).select("doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "error")


def media_payloads(spark, sf_dir):
    """The columns of op9 that SQL can express."""
    return op9_media_clips(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def licence_places(spark, sf_dir):
    """The columns of op1 that SQL can express."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_near_dedup, op3_substring_dedup, op4_best_fit_packing, op5_html_extraction, op6_decontamination, op7_line_dedup, line_dedup_runs, op8_url_filter, op9_media_clips, op10_toxicity, op11_simhash_dedup, op12_fill_in_middle, op13_prefix_trie, media_clips, media_payloads, licence_places)}

ORACLE_SQL = {
    "licence_places": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
phrases(phrase, label) AS (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
places AS (SELECT doc_id, s - 1 AS pos, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS s FROM w), phrases WHERE ws[s:s + len(phrase) - 1] = phrase),
found AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN found USING (doc_id)
""",
    "media_payloads": """
WITH p AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents), q AS (SELECT *, CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS pad FROM p)
SELECT doc_id, n::BIGINT AS n_bytes, (n + pad)::BIGINT AS payload_bytes, sha256(t || repeat(' ', pad)) AS payload_sha256 FROM q
""",
    "op2_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[s:s + 4], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
least_of AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) JOIN least_of USING (doc_id)
""",
    "op3_substring_dedup": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w)),
repeated AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM repeated),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
  FROM words LEFT JOIN (SELECT *, true AS gone FROM covered) USING (doc_id, p) WHERE gone IS NULL GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op6_decontamination": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, ws, len(ws) AS n, least(len(ws), 16) AS w, CASE WHEN len(ws) >= 16 THEN 13 ELSE len(ws) - len(ws) // 8 END AS need
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL)
  WHERE len(ws) >= 1),
dw AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
iw AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM i),
same AS (SELECT doc_id, item_id, p - q AS shift, p FROM dw JOIN iw USING (word)),
dense AS (
  SELECT doc_id, item_id, shift FROM (
    SELECT doc_id, item_id, shift, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS k FROM same)
  JOIN i USING (item_id) WHERE k >= need GROUP BY ALL),
starts AS (
  SELECT doc_id, item_id, shift, w, need, unnest(range(greatest(1, shift + 1), least(len(d.ws), shift + n) - w + 2)) AS s
  FROM dense JOIN i USING (item_id) JOIN d USING (doc_id)),
hit AS (
  SELECT a.doc_id, a.item_id, a.shift, s, any_value(w) AS w FROM starts a JOIN same b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.shift = a.shift AND b.p BETWEEN s AND s + w - 1
  GROUP BY ALL HAVING count(*) >= any_value(need)),
covered AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(s, s + w)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_contaminated, coalesce(items, '') AS items, k IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "line_dedup_runs": """
WITH w AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, coalesce(text, '') AS text, [x FOR x IN [trim(y, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') FOR y IN string_split(coalesce(text, ''), chr(10))] IF x <> ''] AS ls FROM documents),
runs AS (
  SELECT r, n, s, md5(array_to_string(ls[s:s + n - 1], chr(10))) AS h
  FROM (SELECT r, ls, n, unnest(range(1, len(ls) - n + 2)) AS s FROM w, (SELECT 1 << unnest(range(0, 24)) AS n))),
ranked AS (SELECT r, n, s, count(*) OVER (PARTITION BY n, h) AS copies, row_number() OVER (PARTITION BY n, h ORDER BY r, s) AS nth FROM runs),
longest AS (SELECT r, max(n) AS longest FROM ranked WHERE copies > 1 GROUP BY r),
gone AS (SELECT DISTINCT r, unnest([s, s + 1]) AS p, true AS out FROM ranked WHERE n = 2 AND nth > 1),
kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY p) FILTER (out IS NULL) AS k, count(out) AS n_removed,
         count(*) FILTER (out AND before IS NULL) AS n_runs
  FROM (SELECT r, p, line, out, lag(out) OVER (PARTITION BY r ORDER BY p) AS before
        FROM (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM w) LEFT JOIN gone USING (r, p))
  GROUP BY r)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(longest, 0)::BIGINT AS longest_repeat,
       sha256(CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE coalesce(k, '') END) AS kept_sha256
FROM w LEFT JOIN kept USING (r) LEFT JOIN longest USING (r)
""",
    "op8_url_filter": """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
ranked AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM parts p LEFT JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1
""",
}

ORACLE_SQL["op12_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ts, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(ts)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(ts[1:a], '') AS prefix, array_to_string(ts[a + 1:b], '') AS middle, array_to_string(ts[b + 1:], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""

ORACLE_SQL["op13_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id, t, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS i
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL)),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x // 2, 3988292384 * (x % 2)))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c.conv_id, i, t, bytes FROM crc c JOIN turns s ON s.conv_id = c.conv_id - c.conv_id % 5 AND i <= h
  UNION ALL SELECT conv_id, i, t, bytes FROM crc JOIN turns USING (conv_id) WHERE i > h),
placed AS (SELECT conv_id, t, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d FROM built),
prefixes AS (
  SELECT conv_id, d, bytes, md5(string_agg(t, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM crc),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, d) AS node FROM prefixes GROUP BY conv_id) GROUP BY node),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM prefixes GROUP BY node, d),
edges AS (SELECT DISTINCT node, up FROM (SELECT node, d, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM prefixes) WHERE up IS NOT NULL),
kids AS (SELECT up AS node, count(*) AS n_children FROM edges GROUP BY up),
under AS (SELECT DISTINCT a.node, b.node AS below FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
  SELECT under.node, count(*) FILTER (kids.node IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM under JOIN nodes ON nodes.node = below LEFT JOIN kids ON kids.node = below GROUP BY under.node)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN edges USING (node) LEFT JOIN nodes p ON p.node = edges.up LEFT JOIN ends ON ends.node = n.node
"""

#: The SQL of line_dedup_runs, with later copies of single lines of 35 words or more.
ORACLE_SQL["op7_line_dedup"] = ORACLE_SQL["line_dedup_runs"].replace(
    "gone AS (SELECT DISTINCT r, unnest([s, s + 1]) AS p, true AS out FROM ranked WHERE n = 2 AND nth > 1)",
    """gone AS (SELECT DISTINCT r, p, true AS out FROM (SELECT r, unnest([s, s + 1]) AS p FROM ranked WHERE n = 2 AND nth > 1 UNION ALL
  SELECT r, s FROM ranked JOIN w USING (r) WHERE n = 1 AND nth > 1 AND len(regexp_extract_all(ls[s], '[^\\x20\\x09-\\x0D]+')) >= 35))""",
)
