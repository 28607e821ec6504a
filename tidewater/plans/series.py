"""Reports on event logs and time series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import lending as L
from tidewater.functions.numeric import clamp, half_up
from tidewater.operators import scan
from tidewater.operators import windows as X
from tidewater.operators.joins import asof_join, interpolating_join
from tidewater.operators.rules import Rule, best_for_page, evaluate
from tidewater.operators.series import buckets_zero_fill, dense_ticks
from tidewater.sources import views as V
from tidewater.sources.views import sql_with

#: Reports never read the clock: this is "now".
AS_OF = "2024-01-30 00:00:00"
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
_TIME = ["ts", "event_id"]


def _dbl(c: str):
    return F.col(c).cast("double")


def _age_days(ts: str = "ts"):
    return (F.unix_micros(F.lit(AS_OF).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000


def rate_history_apr(spark, sf_dir):
    """Per series: the newest rate against the newest aged 20 to 40 days, else the newest older one, else the oldest of
    at least 7 days; annualised."""
    e = V.events(spark, sf_dir).filter("value > 0").withColumn("age", _age_days()).filter("age >= 0")
    pick = lambda test, newest=True: (F.max_by if newest else F.min_by)(F.when(test, F.struct((1 + _dbl("value") / 10_000).alias("rate"), "age")), F.when(test, F.struct("ts", "event_id")))
    s = e.groupBy("series").agg(pick(F.lit(True)).alias("now"), pick(F.col("age").between(20, 40)).alias("near"), pick(F.col("age") > 40).alias("far"), pick(F.lit(True), newest=False).alias("oldest"))
    past = F.coalesce("near", "far", F.when(F.col("oldest.age") >= 7, F.col("oldest")))
    s = s.withColumn("past", past).withColumn("days", F.col("past.age") - F.col("now.age"))
    return s.select("series", F.col("now.rate").alias("rate"), F.col("past.rate").alias("past_rate"), half_up(L.annualised(F.col("now.rate"), F.col("past.rate"), F.col("days")), 2).alias("apr"))


def profit_chart_asof(spark, sf_dir, share_rows: int = scan.SHARE_ROWS):
    """Purchases with the latest view of their series at or before them; before the first view, the earliest one."""
    e = V.events(spark, sf_dir)
    probes = e.filter("kind = 'purchase'").select("event_id", "series", "ts", _dbl("value").alias("amount"))
    facts = e.filter("kind = 'view'").groupBy("series", "ts").agg(F.max(_dbl("value")).alias("condition"))
    return asof_join(probes, facts, ["series"], "ts", ["condition"], share_rows=share_rows).select("event_id", "series", "amount", "condition", half_up(F.col("amount") - F.col("condition"), 4).alias("profit"))


def interp_performance(spark, sf_dir, share_rows: int = scan.SHARE_ROWS):
    """Clicks with the price of their series on the line between its neighbouring views, held at both ends."""
    e = V.events(spark, sf_dir)
    points = e.filter("kind = 'view'").groupBy("series", "ts").agg(F.max(_dbl("value")).alias("price"))
    probes = e.filter("kind = 'click'").select("event_id", "series", "ts")
    return interpolating_join(probes, points, ["series"], "ts", "price", share_rows).select("event_id", "series", half_up(F.col("price"), 4).alias("price"))


def hypothetical_performance(spark, sf_dir):
    """Per day and kind: the mean value against the kind's first day, one column per kind."""
    daily = V.events(spark, sf_dir).groupBy("kind", F.to_date("ts").alias("day")).agg((F.sum("value").cast("double") / F.count(F.lit(1))).alias("price"))
    base = daily.withColumn("level", half_up(F.col("price") / F.first("price").over(W.partitionBy("kind").orderBy("day")) * 100, 4))
    return base.groupBy("day").pivot("kind", ["click", "error", "purchase", "signup", "view"]).agg(F.first("level")).withColumnsRenamed({k: f"hypo_{k}" for k in ("click", "error", "purchase", "signup", "view")})


def pair_apr(spark, sf_dir):
    """Per market: revenue of all sources by day, first and last day, and the simple rate on the market's value."""
    e = V.events(spark, sf_dir)
    sources = e.filter("kind = 'purchase'").select("market", "ts", "value").unionByName(e.filter("kind = 'signup'").select("market", "ts", "value"))
    daily = sources.groupBy("market", F.to_date("ts").alias("day")).agg(F.sum("value").alias("revenue"))
    s = daily.groupBy("market").agg(F.sum("revenue").cast("double").alias("revenue"), F.min_by("revenue", "day").cast("double").alias("first_revenue"), F.max_by("revenue", "day").cast("double").alias("last_revenue"), F.datediff(F.max("day"), F.min("day")).cast("double").alias("days"))
    tvl = e.filter("kind = 'view'").groupBy("market").agg(F.sum("value").cast("double").alias("tvl"))
    return s.join(tvl, "market", "left").withColumn("apr", half_up(L.simple_apr(F.col("revenue"), F.col("tvl"), F.col("days")), 4))


def event_distribution(spark, sf_dir):
    """Events by kind, with their share."""
    by = V.events(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("total"))
    return by.withColumn("share", half_up(F.col("n") / F.sum("n").over(W.partitionBy()) * 100, 4))


def event_buckets(spark, sf_dir):
    """30 daily buckets, oldest first, zeros where nothing happened."""
    e = V.events(spark, sf_dir).filter("kind = 'error' and market = 3")
    return buckets_zero_fill(e, F.col("ts"), START, END, 30, {"n": F.count(F.lit(1)), "total": F.sum("value").cast("double")})


def paired_series(events):
    """Views and clicks of each market side by side by their number in the series, the shorter one filled with 0."""
    one = X.numbered(events.filter("kind in ('view', 'click')").select("market", "kind", "event_id", _dbl("value").alias("value")), ["market", "kind"], "event_id")
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0))
    return one.groupBy("market", "i").agg(of("view").alias("views"), of("click").alias("clicks"))


def timeline(spark, sf_dir):
    """Paired series of all events."""
    return paired_series(V.events(spark, sf_dir))


def flow_edges(spark, sf_dir):
    """Flows between a series' consecutive markets of activity: kinds as nodes, with normalised intensity."""
    w = W.partitionBy("series").orderBy(*_TIME)
    hops = V.events(spark, sf_dir).withColumns({"next": F.lead("kind").over(w), "next_value": F.lead("value").over(w)}).filter("next is not null and next <> kind")
    edges = hops.groupBy(F.least("kind", "next").alias("source"), F.greatest("kind", "next").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.sum("next_value").cast("double").alias("flow"))
    nodes = V.events(spark, sf_dir).groupBy("kind").agg(F.sum("value").cast("double").alias("size"))
    out = edges.join(nodes.withColumnsRenamed({"kind": "source", "size": "source_size"}), "source").join(nodes.withColumnsRenamed({"kind": "target", "size": "target_size"}), "target")
    return out.select("source", "target", "n", "flow", half_up(clamp(F.col("flow") / (F.col("source_size") + F.col("target_size")), 0.1, 1.0), 6).alias("intensity"))


def running_winrate(spark, sf_dir, share_rows: int = scan.SHARE_ROWS):
    """Outcomes 0, 1, 2 (event_id mod 3): percent of wins so far in each series, and the round's result by rule."""
    e = V.events(spark, sf_dir)
    mine, theirs = F.col("event_id") % 3, F.col("series") % 3
    result = F.element_at(F.lit(["draw", "win", "loss"]), ((mine - theirs + 3) % 3 + 1).cast("int"))
    e = e.withColumn("result", result)
    rated = X.running_ratio(e, F.col("result") == "win", ["series"], _TIME, "win_rate", share_rows)
    return rated.select("event_id", "series", "result", half_up(F.col("win_rate"), 1).alias("win_rate"))


def running_max(spark, sf_dir, share_rows: int = scan.SHARE_ROWS):
    """A cumulative series made monotone, at least 0."""
    return X.running_max(V.events(spark, sf_dir), "value", ["series"], _TIME, "highest", share_rows).select("event_id", "series", _dbl("value").alias("value"), _dbl("highest").alias("highest"))


def ffill(spark, sf_dir, share_rows: int = scan.SHARE_ROWS):
    """Daily ticks of each series without gaps, the last known value carried forward."""
    daily = V.events(spark, sf_dir).groupBy("series", F.to_date("ts").alias("day")).agg(F.max("value").cast("double").alias("value"))
    dense = dense_ticks(daily, ["series"], "day")
    return X.filled_forward(dense.withColumn("observed", F.col("value").isNotNull()), "value", ["series"], ["day"], share_rows).select("series", "day", "observed", "value")


def revenue_rate(spark, sf_dir, span_seconds: int = 3600, share_rows: int = scan.SHARE_ROWS):
    """Value gained a second over the last hour of each market, at least 0.

    Rows of a market and second share their rate. Each second's first and last value are put on one time line with the
    times an hour before; the next second from such a time on opens the hour. So a row takes the same work however
    many rows an hour has.
    """
    e = V.events(spark, sf_dir).withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    row = F.struct("event_id", "value")
    seconds = e.filter("s is not null").groupBy("market", "s").agg(F.min(row)["value"].alias("first"), F.max(row)["value"].alias("newest"))
    opens = seconds.select("market", F.col("s").alias("at"), F.lit(1).alias("fact"), F.struct("s", "first").alias("opening"))
    line = opens.unionByName(seconds.select("market", (F.col("s") - span_seconds).alias("at"), F.lit(0).alias("fact"), "s", "newest"), allowMissingColumns=True)
    found = scan.running(line, ["market"], ["at", "fact"], {"hour": scan.upcoming("opening")}, share_rows).filter("fact = 0")
    span = F.col("s") - F.col("hour.s")
    rates = found.select(F.col("market").alias("of"), F.col("s").alias("second"), F.try_divide((F.col("newest") - F.col("hour.first")).cast("double"), span.cast("double")).alias("gain"))
    same = F.col("market").eqNullSafe(F.col("of")) & (F.col("s") == F.col("second"))
    rate = half_up(F.greatest(F.coalesce("gain", F.lit(0.0)), F.lit(0.0)), 6)
    return e.join(rates, same, "left").select("event_id", "market", rate.alias("rate"))


def recent_history(spark, sf_dir, keep: int = 100):
    """Per series: the newest rows of the last day before AS_OF, at most `keep`."""
    recent = V.events(spark, sf_dir).filter(_age_days().between(0, 1))
    nth = F.row_number().over(W.partitionBy("series").orderBy(F.desc("ts"), F.desc("event_id")))
    return recent.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= keep).select("series", "nth", "event_id", _dbl("value").alias("value"))


def snapshot_changes(spark, sf_dir):
    """Value against the snapshot before, and whether both value rose and the count of clicks fell."""
    daily = V.events(spark, sf_dir).groupBy("market", F.to_date("ts").alias("day")).agg(F.sum("value").cast("double").alias("tvl"), F.count(F.when(F.col("kind") == "click", 1)).alias("claims"))
    up, gain = X.changed("tvl", ["market"], ["day"])
    less = F.lag("claims").over(W.partitionBy("market").orderBy("day")) > F.col("claims")
    return daily.select("market", "day", "tvl", "claims", up.alias("changed"), half_up(gain, 4).alias("delta"), F.coalesce((gain > 0) & less, F.lit(False)).alias("fulfilled"))


def session_gains(spark, sf_dir, idle: int = 6 * 3600):
    """Sessions of each series, parted by idle time: rows, span and gain from the first to the last value."""
    e = V.events(spark, sf_dir).withColumn("opens", X.session_starts("ts", idle, ["series"]))
    e = e.withColumn("session", F.sum("opens").over(X.running(["series"], _TIME)))
    first, last = F.min_by("value", F.struct("ts", "event_id")), F.max_by("value", F.struct("ts", "event_id"))
    return e.groupBy("series", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("opened"), F.max("ts").alias("closed"), (last - first).cast("double").alias("gain"))


def checkpoint_yield(spark, sf_dir):
    """Per market: time covered by checkpoints, first and last value, simple yearly return."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))  # steps between checkpoints add up to the whole span
    s = V.events(spark, sf_dir).filter("kind = 'view'").groupBy("market").agg((F.max(at) - F.min(at)).alias("micros"), F.min_by("value", F.struct("ts", "event_id")).cast("double").alias("first"), F.max_by("value", F.struct("ts", "event_id")).cast("double").alias("last"))
    return s.select("market", "micros", "first", "last", half_up(F.try_divide(F.col("last") - F.col("first"), F.col("first")) * (365 * 86_400_000_000 / F.col("micros")), 4).alias("apr"))


def rules_eval(spark, sf_dir):
    """Rules over daily facts: all that hold, and the one a page shows."""
    w = W.partitionBy("market").orderBy("day")
    facts = V.events(spark, sf_dir).groupBy("market", F.to_date("ts").alias("day")).agg(F.sum("value").cast("double").alias("tvl"), F.count(F.when(F.col("kind") == "error", 1)).alias("errors"))
    facts = facts.withColumn("tvl_delta", F.col("tvl") - F.lag("tvl").over(w))
    rules = [
        Rule("tvl_up", "info", 10, (F.col("tvl_delta") > 0) & (F.col("tvl") > 500)),
        Rule("tvl_down", "warning", 20, F.col("tvl_delta") < -100, "vault"),
        Rule("errors", "warning", 30, F.col("errors") >= 8, "status"),
        Rule("quiet", "info", 1, F.col("errors") < 8),
    ]
    matches = evaluate(facts, rules)
    return best_for_page(matches, ["market", "day"], F.lit("vault")).select("market", "day", "rule", "kind", "priority")


def json_props(spark, sf_dir):
    """JSON in strings: a field by schema, the value for broken rows, and the row written back as JSON."""
    e = V.events(spark, sf_dir)
    parsed = F.from_json(F.col("props"), T.StructType([T.StructField("k", T.LongType())]))
    k = F.coalesce(parsed["k"], F.lit(0))
    return e.select("event_id", k.alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("valid"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("line"))


QUERIES = {f.__name__: f for f in (rate_history_apr, profit_chart_asof, interp_performance, hypothetical_performance, pair_apr, event_distribution, event_buckets, timeline, flow_edges, running_winrate, running_max, ffill, revenue_rate, recent_history, snapshot_changes, session_gains, checkpoint_yield, rules_eval, json_props)}
#: The name that the report had while timeline read part of the events.
QUERIES["timeline_whole"] = timeline

_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000"
_R = lambda x, n: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
SQL = {
    "rate_history_apr": sql_with("ev", f"""WITH e AS (SELECT *, {_AGE} AS age, 1 + value::DOUBLE / 10000 AS rate FROM ev WHERE value > 0), f AS (SELECT * FROM e WHERE age >= 0),
s AS (SELECT series, arg_max(struct_pack(rate, age), (ts, event_id)) AS now, arg_max(struct_pack(rate, age), (ts, event_id)) FILTER (age BETWEEN 20 AND 40) AS near,
  arg_max(struct_pack(rate, age), (ts, event_id)) FILTER (age > 40) AS far, arg_min(struct_pack(rate, age), (ts, event_id)) AS oldest FROM f GROUP BY 1),
p AS (SELECT series, now, coalesce(near, far, CASE WHEN oldest.age >= 7 THEN oldest END) AS past FROM s)
SELECT series, now.rate AS rate, past.rate AS past_rate, CASE WHEN past.rate <> 0 AND past.age - now.age > 0 THEN {_R("(pow(now.rate / past.rate, 365 / (past.age - now.age)) - 1) * 100", 2)} END AS apr FROM p"""),
    "profit_chart_asof": sql_with("ev", f"""WITH p AS (SELECT event_id, series, ts, value::DOUBLE AS amount FROM ev WHERE kind = 'purchase'), v AS (SELECT series, ts, max(value)::DOUBLE AS condition FROM ev WHERE kind = 'view' GROUP BY 1, 2),
f AS (SELECT series, arg_min(condition, ts) AS first FROM v GROUP BY 1),
j AS (SELECT event_id, p.series, amount, coalesce(condition, first) AS condition FROM p ASOF LEFT JOIN v ON p.series = v.series AND p.ts >= v.ts LEFT JOIN f ON f.series = p.series)
SELECT *, {_R("amount - condition", 4)} AS profit FROM j"""),
    "interp_performance": sql_with("ev", f"""WITH p AS (SELECT event_id, series, ts FROM ev WHERE kind = 'click'), v AS (SELECT series, ts, max(value)::DOUBLE AS price FROM ev WHERE kind = 'view' GROUP BY 1, 2),
a AS (SELECT p.*, v.ts AS ta, price AS va FROM p ASOF LEFT JOIN v ON p.series = v.series AND p.ts >= v.ts), b AS (SELECT a.*, v.ts AS tb, price AS vb FROM a ASOF LEFT JOIN v ON a.series = v.series AND a.ts <= v.ts)
SELECT event_id, series, {_R("CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + ((epoch_us(ts) - epoch_us(ta)) / (epoch_us(tb) - epoch_us(ta))) * (vb - va) END", 4)} AS price FROM b"""),
    "hypothetical_performance": sql_with("ev", f"""WITH d AS (SELECT kind, ts::DATE AS day, sum(value)::DOUBLE / count(*) AS price FROM ev GROUP BY 1, 2), l AS (SELECT kind, day, {_R("price / first(price) OVER (PARTITION BY kind ORDER BY day) * 100", 4)} AS level FROM d)
SELECT day, {", ".join(f"max(level) FILTER (kind = '{k}') AS hypo_{k}" for k in ("click", "error", "purchase", "signup", "view"))} FROM l GROUP BY 1"""),
    "pair_apr": sql_with("ev", f"""WITH d AS (SELECT market, ts::DATE AS day, sum(value) AS revenue FROM ev WHERE kind IN ('purchase', 'signup') GROUP BY 1, 2),
s AS (SELECT market, sum(revenue)::DOUBLE AS revenue, arg_min(revenue, day)::DOUBLE AS first_revenue, arg_max(revenue, day)::DOUBLE AS last_revenue, (max(day) - min(day))::DOUBLE AS days FROM d GROUP BY 1),
t AS (SELECT market, sum(value)::DOUBLE AS tvl FROM ev WHERE kind = 'view' GROUP BY 1)
SELECT s.*, tvl, {_R("revenue / tvl * (365 / greatest(days, 1.0)) * 100", 4)} AS apr FROM s LEFT JOIN t USING (market)"""),
    "event_distribution": sql_with("ev", f"SELECT kind, count(*) AS n, sum(value)::DOUBLE AS total, {_R('count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE * 100', 4)} AS share FROM ev GROUP BY kind"),
    "event_buckets": sql_with("ev", f"""WITH s AS (SELECT floor((epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) * 30 / (epoch_us(TIMESTAMP '{END}') - epoch_us(TIMESTAMP '{START}')))::INT AS bucket, count(*) AS n, sum(value)::DOUBLE AS total
  FROM ev WHERE kind = 'error' AND market = 3 AND ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' GROUP BY 1)
SELECT b::INT AS bucket, coalesce(n, 0) AS n, coalesce(total, 0.0) AS total FROM range(30) r(b) LEFT JOIN s ON s.bucket = b"""),
    "timeline_whole": sql_with("ev", """WITH n AS (SELECT market, kind, value::DOUBLE AS value, (row_number() OVER (PARTITION BY market, kind ORDER BY event_id) - 1)::INT AS i FROM ev WHERE kind IN ('view', 'click'))
SELECT market, i, coalesce(v.value, 0.0) AS views, coalesce(c.value, 0.0) AS clicks FROM (SELECT * FROM n WHERE kind = 'view') v FULL JOIN (SELECT * FROM n WHERE kind = 'click') c USING (market, i)"""),
    "flow_edges": sql_with("ev", f"""WITH h AS (SELECT kind, lead(kind) OVER w AS next, lead(value) OVER w AS nv FROM ev WINDOW w AS (PARTITION BY series ORDER BY ts, event_id)),
g AS (SELECT least(kind, next) AS source, greatest(kind, next) AS target, count(*) AS n, sum(nv)::DOUBLE AS flow FROM h WHERE next IS NOT NULL AND next <> kind GROUP BY 1, 2), n AS (SELECT kind, sum(value)::DOUBLE AS size FROM ev GROUP BY 1)
SELECT source, target, n, flow, {_R("least(greatest(flow / (a.size + b.size), 0.1), 1.0)", 6)} AS intensity FROM g JOIN n a ON a.kind = source JOIN n b ON b.kind = target"""),
    "running_winrate": sql_with("ev", f"""WITH r AS (SELECT *, ['draw', 'win', 'loss'][(event_id % 3 - series % 3 + 3) % 3 + 1] AS result FROM ev)
SELECT event_id, series, result, {_R("avg(CASE WHEN result = 'win' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY series ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", 1)} AS win_rate FROM r"""),
    "running_max": sql_with("ev", "SELECT event_id, series, value::DOUBLE AS value, greatest(0, max(value) OVER (PARTITION BY series ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS highest FROM ev"),
    "ffill": sql_with("ev", """WITH d AS (SELECT series, ts::DATE AS day, max(value)::DOUBLE AS value FROM ev GROUP BY 1, 2), s AS (SELECT series, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY 1)
SELECT s.series, s.day, value IS NOT NULL AS observed, last_value(value IGNORE NULLS) OVER (PARTITION BY s.series ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS value FROM s LEFT JOIN d USING (series, day)"""),
    "revenue_rate": sql_with("ev", f"""WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM ev), w AS (SELECT event_id, market, s - min(s) OVER w AS span, arg_min(value, (s, event_id)) OVER w AS a, arg_max(value, (s, event_id)) OVER w AS b FROM e WINDOW w AS (PARTITION BY market ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
SELECT event_id, market, {_R("greatest(CASE WHEN span = 0 THEN 0.0::DOUBLE ELSE (b - a)::DOUBLE / span::DOUBLE END, 0.0::DOUBLE)", 6)} AS rate FROM w"""),
    "recent_history": sql_with("ev", f"""WITH r AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts DESC, event_id DESC) AS nth, event_id, value::DOUBLE AS value FROM ev WHERE {_AGE} BETWEEN 0 AND 1) SELECT * FROM r WHERE nth <= 100"""),
    "snapshot_changes": sql_with("ev", f"""WITH d AS (SELECT market, ts::DATE AS day, sum(value)::DOUBLE AS tvl, count(*) FILTER (kind = 'click') AS claims FROM ev GROUP BY 1, 2), l AS (SELECT *, lag(tvl) OVER w AS b, lag(claims) OVER w AS c FROM d WINDOW w AS (PARTITION BY market ORDER BY day))
SELECT market, day, tvl, claims, coalesce(tvl <> b, false) AS changed, {_R("tvl - b", 4)} AS delta, coalesce(tvl - b > 0 AND c > claims, false) AS fulfilled FROM l"""),
    "session_gains": sql_with("ev", """WITH o AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts)) > 21600000000, true) THEN 1 ELSE 0 END AS opens FROM ev),
s AS (SELECT *, (sum(opens) OVER (PARTITION BY series ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM o)
SELECT series, session, count(*) AS n, min(ts) AS opened, max(ts) AS closed, (arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)))::DOUBLE AS gain FROM s GROUP BY 1, 2"""),
    "checkpoint_yield": sql_with("ev", f"""WITH d AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY market ORDER BY ts, event_id)), 0) AS dt FROM ev WHERE kind = 'view'),
s AS (SELECT market, sum(dt)::BIGINT AS micros, arg_min(value, (ts, event_id))::DOUBLE AS first, arg_max(value, (ts, event_id))::DOUBLE AS last FROM d GROUP BY 1)
SELECT *, {_R("(last - first) / first * (31536000000000 / micros)", 4)} AS apr FROM s"""),
    "rules_eval": sql_with("ev", """WITH f AS (SELECT market, ts::DATE AS day, sum(value)::DOUBLE AS tvl, count(*) FILTER (kind = 'error') AS errors FROM ev GROUP BY 1, 2), g AS (SELECT *, tvl - lag(tvl) OVER (PARTITION BY market ORDER BY day) AS delta FROM f),
m AS (SELECT market, day, 'tvl_up' AS rule, 'info' AS kind, 10 AS priority, '' AS page FROM g WHERE delta > 0 AND tvl > 500 UNION ALL SELECT market, day, 'tvl_down', 'warning', 20, 'vault' FROM g WHERE delta < -100
  UNION ALL SELECT market, day, 'errors', 'warning', 30, 'status' FROM g WHERE errors >= 8 UNION ALL SELECT market, day, 'quiet', 'info', 1, '' FROM g WHERE errors < 8),
b AS (SELECT *, row_number() OVER (PARTITION BY market, day ORDER BY page = '', priority DESC, rule) AS nth FROM m WHERE page IN ('vault', ''))
SELECT market, day, rule, kind, priority FROM b WHERE nth = 1"""),
    "json_props": sql_with("ev", """WITH p AS (SELECT event_id, coalesce((props::JSON ->> '$.k')::BIGINT, 0) AS k, json_extract(props, '$.k') IS NOT NULL AS valid FROM ev) SELECT event_id, k, valid, '{"id":' || event_id || ',"k":' || k || '}' AS line FROM p"""),
}
SQL["timeline"] = SQL["timeline_whole"]
