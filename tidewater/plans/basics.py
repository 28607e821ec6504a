"""Joins, sets, pages, formats and classification, each as a small query."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import bits as B
from tidewater.functions import formats as S
from tidewater.functions import numeric as N
from tidewater.operators import paging as P
from tidewater.operators.joins import first_per_key, lookup_join, same_set
from tidewater.operators.windows import numbered
from tidewater.sources import views as V
from tidewater.sources.views import sql_with


def _customers(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), "c_name", "c_nationkey", V.exact(F.col("c_acctbal"), 2).alias("balance"), "c_mktsegment")


def anti_join(spark, sf_dir):
    """Users without a position."""
    return _customers(spark, sf_dir).join(V.positions(spark, sf_dir), "user", "left_anti").select("user", "c_name")


def semi_join(spark, sf_dir):
    """Users with a large position."""
    return _customers(spark, sf_dir).join(V.positions(spark, sf_dir).filter("debt > 40000"), "user", "left_semi").select("user", "c_name")


def outer_merge(spark, sf_dir):
    """Holdings of even and of odd suppliers' assets merged, amounts added."""
    l = V.table(spark, sf_dir, "lineitem")
    side = lambda k, name: l.filter(F.col("l_suppkey") % 2 == k).groupBy(F.col("l_partkey").alias("asset")).agg(F.sum(V.exact(F.col("l_quantity"), 2)).alias(name))
    both = side(0, "a").join(side(1, "b"), "asset", "full_outer")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return both.select("asset", zero("a").alias("held"), zero("b").alias("added"), (zero("a") + zero("b")).alias("amount"))


def lookup_first(spark, sf_dir):
    """Suppliers with the first asset whose size is their number; larger numbers have none: a stub row."""
    sized = V.table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("k"), F.col("p_partkey").alias("asset"), F.col("p_name").alias("symbol"))
    firsts = first_per_key(sized, ["k"], [F.col("asset")])
    s = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("k"))
    return lookup_join(s, firsts, ["k"], {"asset": -1, "symbol": "unknown"}).select("s_suppkey", "asset", "symbol")


def positional_prices(spark, sf_dir):
    """Two series related by index (assets, prices of each kind), numbered and joined by number: no series is an array."""
    a = V.assets(spark, sf_dir)
    keys = numbered(a.select("kind", "asset"), ["kind"], "asset")
    prices = numbered(a.select("kind", F.col("asset").alias("at"), F.col("price").cast("double").alias("price")), ["kind"], "at")
    return keys.join(prices, ["kind", "i"]).select("kind", "asset", "price")


def search(spark, sf_dir):
    """Any string column contains the text, case ignored."""
    return P.narrowed(_customers(spark, sf_dir), query="MACH").select("user", "c_name", "c_mktsegment")


def filtered(spark, sf_dir):
    """Equality and list filters together."""
    return P.narrowed(_customers(spark, sf_dir), equal={"c_nationkey": 3}, one_of={"c_mktsegment": ["MACHINERY", "HOUSEHOLD"]}).select("user", "c_nationkey", "c_mktsegment")


def paginate_offset(spark, sf_dir):
    """The third page of 25 by balance, with the number of pages."""
    rows = P.page(_customers(spark, sf_dir), [F.desc("balance"), F.col("user")], 3, 25).select("user", F.col("balance").cast("double").alias("balance"))
    return rows.crossJoin(F.broadcast(P.pages(_customers(spark, sf_dir), 25)))


def paginate_keyset(spark, sf_dir):
    """The 20 rows after user 100."""
    return P.after_key(_customers(spark, sf_dir), "user", 100, 20).select("user", "c_name")


def top_k(spark, sf_dir):
    """The ten largest debts of each status, newest first on ties, and a row for the rest."""
    o = V.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", V.exact(F.col("o_totalprice"), 2).alias("debt"))
    nth = F.row_number().over(W.partitionBy("o_orderstatus").orderBy(F.desc("debt"), "o_orderkey"))
    top = o.withColumn("nth", nth.cast("long")).filter("nth <= 10").select("o_orderstatus", "nth", F.col("o_orderkey").alias("position_id"), F.col("debt").cast("double").alias("debt"))
    rest = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("nth"), F.sum("debt").alias("debt"))
    return top.unionByName(rest.select("o_orderstatus", "nth", F.lit(None).cast("long").alias("position_id"), F.col("debt").cast("double").alias("debt")))


def custom_sort(spark, sf_dir):
    """Segments by a list, then by name, as places."""
    by = V.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("place", F.row_number().over(W.partitionBy().orderBy(P.by_list("c_mktsegment", ["MACHINERY", "HOUSEHOLD"]), "c_mktsegment")).cast("long"))


def set_operations(spark, sf_dir):
    """Users by which of two sets they are in, with union, intersection and difference counted, and set equality."""
    o = V.positions(spark, sf_dir)
    a, b = o.filter("debt > 30000").select("user"), o.filter("position_id % 3 = 0").select("user")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    same = same_set(a, a.unionAll(a)).select(F.lit("same").alias("what"), F.col("same").cast("long").alias("n"))
    return count(a.unionByName(b), "all").unionByName(count(a.union(b).distinct(), "union")).unionByName(count(a.intersect(b), "both")).unionByName(count(a.exceptAll(a.intersect(b)).distinct(), "only_left")).unionByName(same)


def undirected_edges(spark, sf_dir):
    """Pairs of nations that trade, each once whatever the direction."""
    n = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"))
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b"))
    l = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    e = l.join(n, l.l_suppkey == n.s_suppkey).join(V.positions(spark, sf_dir), F.col("l_orderkey") == F.col("position_id")).join(c, F.col("user") == F.col("c_custkey")).filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def rollup_report(spark, sf_dir):
    """Sums by segment and nation with subtotals."""
    return _customers(spark, sf_dir).rollup("c_mktsegment", "c_nationkey").agg(F.sum("balance").cast("double").alias("balance"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def unpivoted(spark, sf_dir):
    """Both thresholds of each slot as rows."""
    s = V.queue_slots(spark, sf_dir).select("slot", F.col("ltv").cast("double").alias("ltv"), F.col("borrow_ltv").cast("double").alias("borrow_ltv"))
    return s.unpivot("slot", ["ltv", "borrow_ltv"], "kind", "value")


def scalar_formats(spark, sf_dir):
    """Display strings of order values, and back."""
    x = F.col("o_totalprice")
    o = V.table(spark, sf_dir, "orders")
    s = (F.col("o_orderkey") * 37 % 200_000).cast("long")
    d, h, m = S.time_left(s)
    return o.select("o_orderkey", S.abbreviated(x).alias("short"), N.half_up(S.parse_display(S.abbreviated(x)), 2).alias("parsed"), S.percent_floor(x / 1000, 1).alias("percent"), S.ordinal(F.col("o_orderkey")).alias("nth"),
        S.shortened(F.col("o_orderpriority"), "ord").alias("address"), S.countdown(s).alias("clock"), d.cast("long").alias("days"), h.cast("long").alias("hours"), m.cast("long").alias("minutes"), S.relative_time(s).alias("ago"),
        S.range_midpoint(F.concat((F.col("o_orderkey") % 60).cast("string"), F.lit("% - 90%"))).alias("middle"), N.trunc_dp(x / 7, 3).alias("cut"), N.shift_digits(x.cast("string"), -6).alias("shifted"))


#: Patterns of messages and their labels, first match first.
MESSAGES = [("insufficient", "funds"), ("error.*9", "retry"), ("^error", "failed"), ("view|click", "activity")]


def text_classify(spark, sf_dir):
    """Messages labelled by the first pattern found, and a template filled in."""
    message = F.concat_ws(" ", "kind", "props")
    return V.events(spark, sf_dir).select("event_id", S.first_match(message, MESSAGES, "other").alias("label"), S.interpolated(F.lit("{kind} of {series}: {missing}"), {"kind": F.col("kind"), "series": F.col("series")}).alias("text"), S.decoded(F.col("market"), {0: "stay", 1: "left", 2: "right"}).alias("action"))


def wide_integers(spark, sf_dir):
    """Integers in strings: read where 38 digits hold them, else marked for quarantine."""
    text = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, F.repeat(F.lit("9"), 38)).when(F.col("o_orderkey") % 5 == 1, "x").otherwise("000"))
    o = V.table(spark, sf_dir, "orders").withColumn("text", text)
    return o.select("o_orderkey", N.uint(F.col("text")).cast("double").alias("amount"), N.overflows(F.col("text")).alias("overflows"), N.is_numeric(F.col("text")).alias("numeric"))


def bit_flags(spark, sf_dir):
    """Nibbles packed and read again, bytes to a number, one generator step."""
    k = F.col("o_orderkey")
    packed = B.pack_nibbles([k % 16, k % 7, k % 3, k % 2])
    o = V.table(spark, sf_dir, "orders").withColumn("packed", packed)
    return o.select("o_orderkey", F.col("packed").cast("long").alias("packed"), B.nibble(F.col("packed"), 1).cast("long").alias("second"), B.little_endian(F.array((k % 256), F.floor(k / 256) % 256).cast("array<long>")).alias("number"), B.xorshift32(k + 1).alias("state"))


QUERIES = {f.__name__: f for f in (anti_join, semi_join, outer_merge, lookup_first, positional_prices, search, filtered, paginate_offset, paginate_keyset, top_k, custom_sort, set_operations, undirected_edges, rollup_report, unpivoted, scalar_formats, text_classify, wide_integers, bit_flags)}
#: The name that the report had while outer_merge read two fifths of the suppliers.
QUERIES["outer_merge_whole"] = outer_merge

_ABBR = lambda v, s: f"regexp_replace(format('{{:.1f}}', floor({v} * 10) / 10), '\\.0$', '') || '{s}'"
_REL = lambda n, u: f"({n})::VARCHAR || ' {u}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END || ' ago'"
SQL = {
    "anti_join": sql_with("positions", 'SELECT c_custkey AS "user", c_name FROM customer WHERE c_custkey NOT IN (SELECT "user" FROM positions)'),
    "semi_join": sql_with("positions", 'SELECT c_custkey AS "user", c_name FROM customer WHERE c_custkey IN (SELECT "user" FROM positions WHERE debt > 40000)'),
    "outer_merge_whole": "WITH a AS (SELECT l_partkey AS asset, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1), b AS (SELECT l_partkey AS asset, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1) SELECT asset, coalesce(a.q, 0.0) AS held, coalesce(b.q, 0.0) AS added, coalesce(a.q, 0.0) + coalesce(b.q, 0.0) AS amount FROM a FULL JOIN b USING (asset)",
    "lookup_first": "WITH f AS (SELECT p_size AS k, min(p_partkey) AS asset, arg_min(p_name, p_partkey) AS symbol FROM part GROUP BY 1) SELECT s_suppkey, coalesce(asset, -1) AS asset, coalesce(symbol, 'unknown') AS symbol FROM supplier LEFT JOIN f ON k = s_suppkey",
    "positional_prices": sql_with("assets", "SELECT kind, asset, price::DOUBLE AS price FROM assets"),
    "search": "SELECT c_custkey AS \"user\", c_name, c_mktsegment FROM customer WHERE lower(c_name) LIKE '%mach%' OR lower(c_mktsegment) LIKE '%mach%'",
    "filtered": "SELECT c_custkey AS \"user\", c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 3 AND c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')",
    "paginate_offset": 'SELECT "user", balance::DOUBLE AS balance, n_rows, ceil(n_rows / 25)::BIGINT AS n_pages FROM (SELECT c_custkey AS "user", c_acctbal::DECIMAL(18,2) AS balance FROM customer ORDER BY 2 DESC, 1 LIMIT 25 OFFSET 50), (SELECT count(*) AS n_rows FROM customer)',
    "paginate_keyset": 'SELECT c_custkey AS "user", c_name FROM customer WHERE c_custkey > 100 ORDER BY 1 LIMIT 20',
    "top_k": """WITH o AS (SELECT o_orderstatus, o_orderkey, o_totalprice::DECIMAL(18,2) AS debt, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders)
SELECT o_orderstatus, nth, o_orderkey AS position_id, debt::DOUBLE AS debt FROM o WHERE nth <= 10 UNION ALL SELECT o_orderstatus, count(*), NULL, sum(debt)::DOUBLE FROM o GROUP BY 1""",
    "custom_sort": "SELECT c_mktsegment, n, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 ELSE 3 END, c_mktsegment) AS place FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)",
    "set_operations": sql_with("positions", """WITH a AS (SELECT "user" FROM positions WHERE debt > 30000), b AS (SELECT "user" FROM positions WHERE position_id % 3 = 0)
SELECT 'all' AS what, count(*) AS n FROM (FROM a UNION ALL FROM b) UNION ALL SELECT 'union', count(*) FROM (FROM a UNION FROM b) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b)
UNION ALL SELECT 'only_left', count(*) FROM (SELECT DISTINCT "user" FROM (FROM a EXCEPT ALL (FROM a INTERSECT FROM b))) UNION ALL SELECT 'same', 1"""),
    "undirected_edges": sql_with("positions", 'SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN positions ON position_id = l_orderkey JOIN customer ON c_custkey = "user" WHERE s_nationkey <> c_nationkey GROUP BY 1, 2'),
    "rollup_report": "SELECT c_mktsegment, c_nationkey, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance, count(*) AS n, grouping_id(c_mktsegment, c_nationkey)::BIGINT AS level FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "unpivoted": sql_with("slots", "SELECT slot, 'ltv' AS kind, ltv::DOUBLE AS value FROM slots UNION ALL SELECT slot, 'borrow_ltv', borrow_ltv::DOUBLE FROM slots"),
    "scalar_formats": f"""WITH o AS (SELECT *, o_totalprice AS x, o_orderkey * 37 % 200000 AS s FROM orders), a AS (SELECT *, CASE WHEN x >= 1e9 THEN {_ABBR("x / 1e9", "B")} WHEN x >= 1e6 THEN {_ABBR("x / 1e6", "M")} WHEN x >= 1e3 THEN {_ABBR("x / 1e3", "K")} ELSE {_ABBR("x", "")} END AS short FROM o)
SELECT o_orderkey, short, floor(regexp_replace(short, '[BMK]', '')::DOUBLE * (CASE right(short, 1) WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1.0 END) * 100.0 + 0.5) / 100.0 AS parsed, format('{{:.1f}}', floor(x / 1000 * 10.0) / 10.0) || '%' AS percent,
  o_orderkey || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth, 'ord...' || right(o_orderpriority, 4) AS address,
  lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock, s // 86400 AS days, s % 86400 // 3600 AS hours, s % 3600 // 60 AS minutes,
  CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN {_REL("s // 60", "minute")} WHEN s < 86400 THEN {_REL("s // 3600", "hour")} ELSE {_REL("s // 86400", "day")} END AS ago,
  ((o_orderkey % 60)::DOUBLE + 90) / 2 AS middle, floor(x / 7 * 1000.0) / 1000.0 AS cut, floor(x * 1e-6::DOUBLE * 1e6) / 1e6 AS shifted FROM a""",
    "text_classify": sql_with("ev", """WITH m AS (SELECT *, kind || ' ' || props AS t FROM ev) SELECT event_id, CASE WHEN regexp_matches(t, '(?i)insufficient') THEN 'funds' WHEN regexp_matches(t, '(?i)error.*9') THEN 'retry' WHEN regexp_matches(t, '(?i)^error') THEN 'failed' WHEN regexp_matches(t, '(?i)view|click') THEN 'activity' ELSE 'other' END AS label,
  kind || ' of ' || series || ': {missing}' AS text, CASE market WHEN 0 THEN 'stay' WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE 'unknown' END AS action FROM m"""),
    "wide_integers": """WITH t AS (SELECT o_orderkey, o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN repeat('9', 38) WHEN 1 THEN 'x' ELSE '000' END AS t FROM orders)
SELECT o_orderkey, TRY_CAST(CASE WHEN length(ltrim(t, '0')) <= 38 THEN t END AS HUGEINT)::DOUBLE AS amount, regexp_full_match(t, '[0-9]+') AND length(ltrim(t, '0')) > 38 AS overflows, TRY_CAST(t AS DOUBLE) IS NOT NULL AS numeric FROM t""",
    "bit_flags": """WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 16) | ((o_orderkey % 7) << 4) | ((o_orderkey % 3) << 8) | ((o_orderkey % 2) << 12) AS packed FROM orders), a AS (SELECT *, ((k + 1) # ((k + 1) << 13)) & 4294967295 AS x1 FROM (SELECT k, packed FROM p)), b AS (SELECT *, xor(x1, x1 >> 17) AS x2 FROM a)
SELECT k AS o_orderkey, packed, (packed >> 4) & 15 AS second, k % 256 + (k // 256) % 256 * 256 AS number, xor(x2, x2 << 5) & 4294967295 AS state FROM b""".replace("((k + 1) # ((k + 1) << 13))", "xor(k + 1, (k + 1) << 13)"),
}
SQL["outer_merge"] = SQL["outer_merge_whole"]
