"""Variants of joins, groupings, reshaping and time ranges that the larger reports don't show on their own."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.numeric import half_up, safe_div, wide_sum
from tidewater.operators import grid as G
from tidewater.operators import scan
from tidewater.operators import windows as X
from tidewater.operators.joins import interpolating_join
from tidewater.operators.rules import Rule, evaluate
from tidewater.plans.racing import SIDE, _GRID_SQL, _grid
from tidewater.plans.series import AS_OF
from tidewater.sources import views as V
from tidewater.sources.views import sql_with

KINDS = ("click", "error", "purchase", "signup", "view")
#: Hours of each range that a page offers.
RANGES = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}
_TIME = ["ts", "event_id"]


def _dbl(c: str):
    return F.col(c).cast("double")


def _day():
    return F.to_date("ts").alias("day")


def revenue_and_value(spark, sf_dir):
    """Revenue of two sources by minute with the value of the same minute, none where there is none; minutes in order."""
    e = V.events(spark, sf_dir).withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    both = e.filter("kind = 'purchase'").unionByName(e.filter("kind = 'signup'")).groupBy("minute").agg(F.sum("value").cast("double").alias("revenue"))
    tvl = e.filter("kind = 'view'").groupBy("minute").agg(F.sum("value").cast("double").alias("tvl"))
    rows = both.join(tvl, "minute", "left").withColumn("before", -F.unix_micros(F.col("minute").cast("timestamp")))
    return X.ranked(rows, "before", "minute", "place").select("minute", "revenue", "tvl", "place")


def curve_lookup(spark, sf_dir, share_rows: int = scan.SHARE_ROWS):
    """Utilisation of twelve markets at noon of a day, between the points of their curves; a half without any point."""
    points = V.events(spark, sf_dir).filter("kind = 'view'").groupBy("market", "ts").agg((F.max("value").cast("double") / 1000).alias("used"))
    probes = spark.range(12).select(F.col("id").alias("market"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz").alias("ts"))
    return interpolating_join(probes, points, ["market"], "ts", "used", share_rows).select("market", half_up(F.coalesce("used", F.lit(0.5)), 6).alias("used"))


def days_by_kind(spark, sf_dir):
    """Every hour with every kind, and the mean value there, 0 without one: the product with a fixed list is an explode."""
    e = V.events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    every = e.select("hour").distinct().withColumn("kind", F.explode(F.lit(list(KINDS))))
    means = e.groupBy("hour", "kind").agg((F.sum("value").cast("double") / F.count(F.lit(1))).alias("mean"))
    return every.join(means, ["hour", "kind"], "left").select("hour", "kind", half_up(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"))


def markets_by_denom(spark, sf_dir):
    """Positions of each market and denomination that the market lists."""
    markets = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("market"), F.explode(F.array(F.lit(0), F.col("n_nationkey") % 3 + 1).cast("array<long>")).alias("denom"))
    held = V.positions(spark, sf_dir).select((F.col("user") % 25).alias("market"), (F.col("position_id") % 4).alias("denom"), "debt")
    sums = held.groupBy("market", "denom").agg(F.sum("debt").cast("double").alias("debt"), F.count(F.lit(1)).alias("n"))
    return markets.join(sums, ["market", "denom"], "left").fillna(0.0, ["debt"]).fillna(0, ["n"])


def pools_of_assets(spark, sf_dir):
    """What all pools of an asset hold, where a pool has many assets and an asset is in several pools."""
    in_pools = V.assets(spark, sf_dir).select("asset", F.explode(F.array_distinct(F.array(F.col("asset") % 10, F.col("asset") % 6))).alias("pool"))
    pools = V.events(spark, sf_dir).groupBy(F.col("market").alias("pool")).agg(F.sum("value").alias("total"))
    return in_pools.join(pools, "pool").groupBy("asset").agg(F.sum("total").cast("double").alias("total"), F.count(F.lit(1)).alias("n_pools"))


def percent_rates(spark, sf_dir):
    """Each position's rate from percent weights, and the mean rate of its assets without those that have none."""
    v = V.valued(spark, sf_dir)
    share = half_up(safe_div(_dbl("value"), F.sum("value").over(W.partitionBy("position_id")).cast("double")) * 100, 4)
    rows = v.withColumn("percent", share.cast("decimal(9,4)")).withColumn("known", F.when(F.col("asset") % 3 != 0, F.col("rate")))
    s = rows.groupBy("position_id").agg(F.sum(F.col("rate") * F.col("percent")).cast("double").alias("weighted"), F.sum("known").cast("double").alias("sum"), F.count("known").alias("n"))
    return s.select("position_id", half_up(F.col("weighted") / 100, 8).alias("rate"), half_up(F.try_divide("sum", "n"), 8).alias("known_rate"))


def rounded_groups(spark, sf_dir):
    """Deposits by threshold to two places within a range, and by the borrowing threshold alone."""
    s = V.queue_slots(spark, sf_dir).withColumns({"l": half_up(_dbl("ltv") * 1.0007, 2), "b": half_up(_dbl("borrow_ltv") * 1.0007, 2)})
    one = lambda key, what: s.groupBy(F.col(key).alias("threshold")).agg(F.sum("tvl").cast("double").alias("tvl")).select(F.lit(what).alias("what"), "threshold", "tvl")
    return one("l", "ltv").filter("threshold between 0.65 and 0.8").unionByName(one("b", "borrow"))


def recall(spark, sf_dir):
    """What can be called back: by venue, as a list in order, and in all."""
    by = V.events(spark, sf_dir).filter("kind in ('purchase', 'signup')").groupBy("market").agg(F.sum("value").alias("amount")).filter("amount > 0")
    return by.agg(F.sum("amount").cast("double").alias("total"), F.to_json(F.array_sort(F.collect_list(F.struct("market", F.col("amount").cast("string").alias("amount"))))).alias("venues"))


def best_actions(spark, sf_dir):
    """How many states of each car are known, and in how many of these the best action is the one that is wanted."""
    k = F.col("o_orderkey")
    q = V.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("car"), (k % 625).alias("state"), F.array(k % 7, k % 5, k % 11, k % 3).alias("values"))
    best = (F.array_position("values", F.array_max("values")) - 1).alias("best")
    wanted = spark.range(0, 625).select(F.col("id").alias("state"), (F.col("id") % 4).alias("wanted"))
    rows = q.select("car", "state", best).join(F.broadcast(wanted), "state")
    s = rows.groupBy("car").agg(F.countDistinct("state").alias("states"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("best") == F.col("wanted"), 1)).alias("right"))
    return s.withColumn("coverage", half_up(F.least(F.col("states") / 625 * 100, F.lit(100.0)), 4))


def current_totals(spark, sf_dir):
    """Value of the queue and of the lockdrop, and what waits to be claimed, in one row."""
    slots = V.queue_slots(spark, sf_dir).agg(F.sum("tvl").cast("double").alias("queue"))
    drop = V.deposits(spark, sf_dir).agg(F.sum(F.when(~F.col("unstaking"), F.col("amount"))).cast("double").alias("lockdrop"))
    claims = V.events(spark, sf_dir).agg(F.sum(F.when(F.col("kind") == "signup", F.col("value"))).cast("double").alias("claims"))
    return slots.crossJoin(drop).crossJoin(claims)


def reversed_risk(spark, sf_dir):
    """The ten suppliers with the largest balances (numbers in strings), the smallest of them first."""
    s = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("string").alias("balance"))
    top = s.orderBy(F.desc(_dbl("balance")), "s_suppkey").limit(10)
    place = F.row_number().over(W.partitionBy().orderBy(_dbl("balance"), F.desc("s_suppkey")))
    return top.select("s_suppkey", _dbl("balance").alias("balance"), place.cast("long").alias("place"))


def grid_turns(spark, sf_dir):
    """Tracks after a half turn and after three quarter turns, and mirrored top to bottom (a half turn of the mirror image)."""
    n = F.lit(SIDE)
    one = lambda df, what: df.select(F.lit(what).alias("what"), "track", "x", "y", "tile")
    g = _grid(spark, sf_dir)
    return one(G.turned(g, 2, n, n), "half").unionByName(one(G.turned(g, 3, n, n), "three")).unionByName(one(G.turned(G.mirrored(g, n), 2, n, n), "flipped"))


def range_counts(spark, sf_dir):
    """Events and sums of each kind in the last hour, day, week and month before the reports' now."""
    age = F.unix_micros(F.lit(AS_OF).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    ranges = F.array(*(F.struct(F.lit(n).alias("range"), F.lit(h * 3_600_000_000).alias("span")) for n, h in RANGES.items()))
    rows = V.events(spark, sf_dir).withColumn("age", age).filter("age >= 0").select("*", F.inline(ranges)).filter("age <= span")
    return rows.groupBy("range", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("total"))


def session_history(spark, sf_dir, idle: int = 6 * 3600):
    """The rows of each series' latest session, less the value that the session began with."""
    e = V.events(spark, sf_dir).withColumn("opens", X.session_starts("ts", idle, ["series"]))
    e = e.withColumn("session", F.sum("opens").over(X.running(["series"], _TIME)))
    last = F.max("session").over(W.partitionBy("series"))
    base = F.first("value").over(W.partitionBy("series", "session").orderBy(*_TIME))
    return e.withColumns({"last": last, "base": base}).filter("session = last").select("event_id", "series", half_up((F.col("value") - F.col("base")).cast("double"), 4).alias("gain"))


def snapshot_profit(spark, sf_dir):
    """A position's value less its debt and less what its first asset was worth at the start."""
    v = V.valued(spark, sf_dir).groupBy("position_id").agg(F.sum("value").alias("value"), F.min_by("value", "asset").alias("initial"))
    rows = v.join(V.debts(spark, sf_dir), "position_id")
    return rows.select("position_id", (F.col("value") - F.col("debt") - F.col("initial")).cast("double").alias("profit"))


def map_nodes(spark, sf_dir):
    """The kinds as nodes of the map: size, events, share of all, and the class by share."""
    n = V.events(spark, sf_dir).groupBy("kind").agg(F.sum("value").cast("double").alias("size"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    return n.withColumn("class", F.when(share >= 0.3, "hub").when(share >= 0.15, "node").otherwise("leaf"))


def rules_by_kind(spark, sf_dir):
    """All rules that hold on a day, split by kind, in order of priority."""
    facts = V.events(spark, sf_dir).groupBy("market", _day()).agg(F.sum("value").cast("double").alias("tvl"), F.count(F.when(F.col("kind") == "error", 1)).alias("errors"))
    rules = [Rule("large", "info", 5, F.col("tvl") > 800), Rule("errors", "warning", 30, F.col("errors") >= 4), Rule("many", "warning", 10, F.col("errors") >= 2), Rule("any", "info", 1, F.col("tvl") > 0)]
    order = W.partitionBy("market", "day", "kind").orderBy(F.desc("priority"), "rule")
    return evaluate(facts, rules).withColumn("nth", F.row_number().over(order).cast("long")).select("market", "day", "kind", "nth", "rule")


def wide_totals(spark, sf_dir):
    """Sums of integers of up to 39 digits in strings, exactly, and whether a sum is over a bound of 39 digits."""
    text = F.concat(F.lit("1"), F.lpad((F.col("o_orderkey") % 9973).cast("string"), 4, "0"), F.lit("0" * 33), F.lit("7"))
    s = V.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("user")).agg(wide_sum(text).alias("total"))
    bound = "2" + "0" * 38 + "0"
    wide = F.lpad("total", 60, "0")
    return s.select("user", "total", (wide > F.lpad(F.lit(bound), 60, "0")).alias("over"))


def keyed_store(spark, sf_dir):
    """What a store of JSON by key holds after all writes: the last value of each key, {} for one that was cleared."""
    writes = V.events(spark, sf_dir).select("series", "kind", "ts", "event_id", F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("props")).alias("props"))
    last = writes.groupBy("series", "kind").agg(F.max_by(F.struct("props"), F.struct("ts", "event_id")).alias("w"))
    return last.select("series", "kind", F.coalesce("w.props", F.lit("{}")).alias("value"))


def denoms(spark, sf_dir):
    """The denomination of an asset that is either native or a token."""
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.format_string('{"native_token": {"denom": "u%d"}}', k)).otherwise(F.format_string('{"token": {"address": "t%d"}}', k))
    info = F.from_json(text, "native_token struct<denom: string>, token struct<address: string>")
    return V.table(spark, sf_dir, "part").select(k.alias("asset"), F.coalesce(info["native_token"]["denom"], info["token"]["address"]).alias("denom"))


QUERIES = {f.__name__: f for f in (
    revenue_and_value, curve_lookup, days_by_kind, markets_by_denom, pools_of_assets, percent_rates, rounded_groups, recall, best_actions, current_totals, reversed_risk, grid_turns, range_counts, session_history, snapshot_profit, map_nodes, rules_by_kind, wide_totals, keyed_store, denoms)}

_R = lambda x, n=0: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
SQL = {
    "revenue_and_value": sql_with("ev", """WITH b AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, sum(value)::DOUBLE AS revenue FROM ev WHERE kind IN ('purchase', 'signup') GROUP BY 1), t AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, sum(value)::DOUBLE AS tvl FROM ev WHERE kind = 'view' GROUP BY 1)
SELECT minute, revenue, tvl, row_number() OVER (ORDER BY minute) AS place FROM b LEFT JOIN t USING (minute)"""),
    "curve_lookup": sql_with("ev", f"""WITH v AS (SELECT market, ts, max(value)::DOUBLE / 1000 AS u FROM ev WHERE kind = 'view' GROUP BY 1, 2), p AS (SELECT m AS market, TIMESTAMP '2024-01-15 12:00:00' AS ts FROM range(12) r(m)),
a AS (SELECT p.*, v.ts AS ta, u AS va FROM p ASOF LEFT JOIN v ON p.market = v.market AND p.ts >= v.ts), b AS (SELECT a.*, v.ts AS tb, u AS vb FROM a ASOF LEFT JOIN v ON a.market = v.market AND a.ts <= v.ts)
SELECT market, {_R("coalesce(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + ((epoch_us(ts) - epoch_us(ta)) / (epoch_us(tb) - epoch_us(ta))) * (vb - va) END, 0.5::DOUBLE)", 6)} AS used FROM b"""),
    "days_by_kind": sql_with("ev", f"""WITH d AS (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS hour FROM ev), k(kind) AS (VALUES {", ".join(f"('{k}')" for k in KINDS)}), m AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, kind, sum(value)::DOUBLE / count(*) AS mean FROM ev GROUP BY 1, 2)
SELECT hour, kind, {_R("coalesce(mean, 0.0)", 6)} AS mean FROM d CROSS JOIN k LEFT JOIN m USING (hour, kind)"""),
    "markets_by_denom": sql_with("positions", """WITH m AS (SELECT n_nationkey::BIGINT AS market, unnest([0, n_nationkey % 3 + 1])::BIGINT AS denom FROM nation), s AS (SELECT "user" % 25 AS market, position_id % 4 AS denom, sum(debt)::DOUBLE AS debt, count(*) AS n FROM positions GROUP BY 1, 2)
SELECT market, denom, coalesce(debt, 0.0) AS debt, coalesce(n, 0) AS n FROM m LEFT JOIN s USING (market, denom)"""),
    "pools_of_assets": sql_with("assets ev", """WITH i AS (SELECT asset, unnest(list_distinct([asset % 10, asset % 6])) AS pool FROM assets), p AS (SELECT market AS pool, sum(value) AS total FROM ev GROUP BY 1) SELECT asset, sum(total)::DOUBLE AS total, count(*) AS n_pools FROM i JOIN p USING (pool) GROUP BY 1"""),
    "percent_rates": sql_with("valued", f"""WITH t AS (SELECT position_id, asset, rate, value::DOUBLE AS v, (sum(value) OVER (PARTITION BY position_id))::DOUBLE AS total FROM valued), r AS (SELECT *, ({_R("CASE WHEN total = 0 THEN 0.0 ELSE v / total END * 100", 4)})::DECIMAL(9,4) AS percent FROM t),
s AS (SELECT position_id, sum(rate * percent)::DOUBLE AS w, (sum(rate) FILTER (asset % 3 <> 0))::DOUBLE AS a, count(*) FILTER (asset % 3 <> 0) AS n FROM r GROUP BY 1)
SELECT position_id, {_R("w / 100", 8)} AS rate, CASE WHEN n > 0 THEN {_R("a / n", 8)} END AS known_rate FROM s"""),
    "rounded_groups": sql_with("slots", f"""WITH s AS (SELECT {_R("ltv::DOUBLE * 1.0007::DOUBLE", 2)} AS l, {_R("borrow_ltv::DOUBLE * 1.0007::DOUBLE", 2)} AS b, tvl FROM slots)
SELECT 'ltv' AS what, l AS threshold, sum(tvl)::DOUBLE AS tvl FROM s WHERE l BETWEEN 0.65 AND 0.8 GROUP BY 2 UNION ALL SELECT 'borrow', b, sum(tvl)::DOUBLE FROM s GROUP BY 2"""),
    "recall": sql_with("ev", """WITH b AS (SELECT market, sum(value) AS amount FROM ev WHERE kind IN ('purchase', 'signup') GROUP BY 1 HAVING sum(value) > 0) SELECT sum(amount)::DOUBLE AS total, to_json(list(struct_pack(market := market, amount := amount::VARCHAR) ORDER BY market))::VARCHAR AS venues FROM b"""),
    "best_actions": f"""WITH q AS (SELECT o_custkey % 50 AS car, o_orderkey % 625 AS state, [o_orderkey % 7, o_orderkey % 5, o_orderkey % 11, o_orderkey % 3] AS v FROM orders), r AS (SELECT car, state, list_position(v, list_max(v)) - 1 AS best FROM q)
SELECT car, count(DISTINCT state) AS states, count(*) AS rows, count(*) FILTER (best = state % 4) AS "right", {_R("least(count(DISTINCT state) / 625 * 100, 100.0::DOUBLE)", 4)} AS coverage FROM r GROUP BY 1""",
    "current_totals": sql_with("slots deposits ev", """SELECT (SELECT sum(tvl)::DOUBLE FROM slots) AS queue, (SELECT sum(amount)::DOUBLE FROM deposits WHERE NOT unstaking) AS lockdrop, (SELECT sum(value)::DOUBLE FROM ev WHERE kind = 'signup') AS claims"""),
    "reversed_risk": "WITH t AS (SELECT s_suppkey, s_acctbal AS balance FROM supplier ORDER BY 2 DESC, 1 LIMIT 10) SELECT *, row_number() OVER (ORDER BY balance, s_suppkey DESC) AS place FROM t",
    "grid_turns": f"WITH {_GRID_SQL} SELECT 'half' AS what, track, {SIDE - 1} - x AS x, {SIDE - 1} - y AS y, tile FROM g UNION ALL SELECT 'three', track, y, {SIDE - 1} - x, tile FROM g UNION ALL SELECT 'flipped', track, x, {SIDE - 1} - y, tile FROM g",
    "range_counts": sql_with("ev", f"""WITH r(range, span) AS (VALUES {", ".join(f"('{n}', {h * 3_600_000_000})" for n, h in RANGES.items())}), a AS (SELECT *, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) AS age FROM ev) SELECT range, kind, count(*) AS n, sum(value)::DOUBLE AS total FROM a JOIN r ON age BETWEEN 0 AND span GROUP BY 1, 2"""),
    "session_history": sql_with("ev", f"""WITH o AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts)) > 21600000000, true) THEN 1 ELSE 0 END AS opens FROM ev),
s AS (SELECT *, sum(opens) OVER (PARTITION BY series ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o), b AS (SELECT *, max(session) OVER (PARTITION BY series) AS last, first(value) OVER (PARTITION BY series, session ORDER BY ts, event_id) AS base FROM s)
SELECT event_id, series, {_R("(value - base)::DOUBLE", 4)} AS gain FROM b WHERE session = last"""),
    "snapshot_profit": sql_with("valued", "WITH v AS (SELECT position_id, sum(value) AS value, arg_min(value, asset) AS initial FROM valued GROUP BY 1) SELECT position_id, (value - debt - initial)::DOUBLE AS profit FROM v JOIN positions USING (position_id)"),
    "map_nodes": sql_with("ev", """WITH n AS (SELECT kind, sum(value)::DOUBLE AS size, count(*) AS n, max(ts) AS last FROM ev GROUP BY 1), s AS (SELECT *, n / (sum(n) OVER ()) AS share FROM n) SELECT kind, size, n, last, CASE WHEN share >= 0.3 THEN 'hub' WHEN share >= 0.15 THEN 'node' ELSE 'leaf' END AS class FROM s"""),
    "rules_by_kind": sql_with("ev", """WITH f AS (SELECT market, ts::DATE AS day, sum(value)::DOUBLE AS tvl, count(*) FILTER (kind = 'error') AS errors FROM ev GROUP BY 1, 2),
m AS (SELECT market, day, 'large' AS rule, 'info' AS kind, 5 AS p FROM f WHERE tvl > 800 UNION ALL SELECT market, day, 'errors', 'warning', 30 FROM f WHERE errors >= 4 UNION ALL SELECT market, day, 'many', 'warning', 10 FROM f WHERE errors >= 2 UNION ALL SELECT market, day, 'any', 'info', 1 FROM f WHERE tvl > 0)
SELECT market, day, kind, row_number() OVER (PARTITION BY market, day, kind ORDER BY p DESC, rule) AS nth, rule FROM m"""),
    "wide_totals": f"""WITH t AS (SELECT o_custkey % 100 AS "user", ('1' || lpad((o_orderkey % 9973)::VARCHAR, 4, '0') || repeat('0', 33) || '7') AS x FROM orders), s AS (SELECT "user", sum(left(x, length(x) - 19)::HUGEINT) AS hi, sum(right(x, 19)::HUGEINT) AS lo FROM t GROUP BY 1),
u AS (SELECT "user", (hi + lo // 10000000000000000000)::VARCHAR || lpad((lo % 10000000000000000000)::VARCHAR, 19, '0') AS total FROM s) SELECT "user", total, lpad(total, 60, '0') > lpad('2{"0" * 39}', 60, '0') AS over FROM u""",
    "keyed_store": sql_with("ev", """WITH l AS (SELECT series, kind, arg_max(struct_pack(p := CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END), (ts, event_id)) AS w FROM ev GROUP BY 1, 2) SELECT series, kind, coalesce(w.p, '{}') AS value FROM l"""),
    "denoms": "SELECT p_partkey AS asset, CASE WHEN p_partkey % 2 = 0 THEN 'u' ELSE 't' END || p_partkey AS denom FROM part",
}
