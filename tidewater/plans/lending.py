"""Reports on positions, debts, rates and markets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import lending as L
from tidewater.functions.numeric import half_up, safe_div, trunc_dp
from tidewater.operators.joins import first_per_key, lookup_join
from tidewater.sources import views as V
from tidewater.sources.views import sql_with

CREDIT_PRICE = 1.0


def _per_position(spark, sf_dir):
    """position_id, user, debt and the position's sums; ratios are sums over sums, so that one grouping gives all."""
    v = F.col("value")
    sums = V.valued(spark, sf_dir).groupBy("user", "position_id").agg(
        F.sum(v).alias("tvl_"), F.sum(v * F.col("max_ltv")).alias("liq_"), F.sum(v * F.col("max_borrow_ltv")).alias("borrow_"), F.sum(v * F.col("rate")).alias("cost_"), F.count(F.lit(1)).alias("n_assets"))
    joined = sums.join(V.debts(spark, sf_dir), "position_id")
    d = lambda c: F.col(c).cast("double")
    return joined.filter("tvl_ > 0").select("user", "position_id", "n_assets", d("debt").alias("debt"), d("tvl_").alias("tvl"), (d("liq_") / d("tvl_") * 100).alias("liquidation_ltv"), trunc_dp(d("borrow_") / d("tvl_") * 100, 2).alias("borrow_ltv"), (d("cost_") / d("tvl_")).alias("cost")).withColumn("ltv", L.ltv(F.col("debt") * CREDIT_PRICE, F.col("tvl")))


PER_POSITION = """WITH sums AS (
  SELECT "user", position_id, sum(value) AS tvl_, sum(value * max_ltv) AS liq_, sum(value * max_borrow_ltv) AS borrow_, sum(value * rate) AS cost_, count(*) AS n_assets FROM valued GROUP BY ALL),
per_position AS (
  SELECT *, CASE WHEN debt = 0 THEN 0.0::DOUBLE ELSE sign(debt) * floor(abs(debt / tvl * 100) * 100.0) / 100.0 END AS ltv FROM (
    SELECT s."user", position_id, n_assets, debt::DOUBLE AS debt, tvl_::DOUBLE AS tvl, liq_::DOUBLE / tvl_::DOUBLE * 100 AS liquidation_ltv,
           floor(borrow_::DOUBLE / tvl_::DOUBLE * 100 * 100.0) / 100.0 AS borrow_ltv, cost_::DOUBLE / tvl_::DOUBLE AS cost
    FROM sums s JOIN positions p USING (position_id) WHERE tvl_ > 0))
"""


def risky_positions(spark, sf_dir):
    """Positions over their liquidation threshold, with the fee; the ltv is cut to two places, the threshold isn't."""
    return _per_position(spark, sf_dir).filter((F.col("debt") > 0) & (F.col("ltv") > F.col("liquidation_ltv"))).select("user", "position_id", "ltv", half_up(F.col("liquidation_ltv"), 6).alias("liquidation_ltv"), half_up(L.liquidation_fee(F.col("ltv"), F.col("liquidation_ltv"), F.col("debt") * CREDIT_PRICE), 2).alias("fee"))


def vault_summary(spark, sf_dir):
    """Per position: value, debt, cost, limits, what can still be borrowed, health and leverage."""
    c = F.col
    return _per_position(spark, sf_dir).select(
        "user", "position_id", "n_assets", "tvl", "debt", "ltv", "borrow_ltv", half_up(c("cost"), 8).alias("cost"), half_up(L.liquidation_value(c("debt"), F.lit(CREDIT_PRICE), c("liquidation_ltv")), 4).alias("liquidation_value"),
        half_up(L.max_mint(c("tvl"), c("borrow_ltv"), F.lit(CREDIT_PRICE)), 4).alias("max_mint"), half_up(L.mintable(c("tvl"), c("borrow_ltv"), F.lit(CREDIT_PRICE), c("debt")), 4).alias("mintable"),
        half_up(L.health(c("ltv"), c("liquidation_ltv")), 4).alias("health"), half_up(L.leverage(c("tvl"), c("debt")), 4).alias("leverage"))


def annual_interest(spark, sf_dir, least_debt: float = 1000.0):
    """What the first position of each user pays in a year, without and with the user's discount; small debts are left out."""
    n = V.tasks(spark, sf_dir)
    first = first_per_key(V.positions(spark, sf_dir).select("user", "position_id").repartition(n, "user"), ["user"], [F.col("position_id")])
    discount = (F.col("user") % 10) / 100
    owed = _per_position(spark, sf_dir).filter(F.col("debt") > least_debt).repartition(n, "user", "position_id")
    rows = owed.join(V.dealt(first, n, "user", "position_id"), ["user", "position_id"], "left_semi")
    interest = (half_up(F.col("cost") * F.col("debt"), 4)).cast("decimal(20,4)")
    return rows.agg(F.sum(interest).cast("double").alias("undiscounted"), half_up(F.sum(half_up(F.col("cost") * (1 - discount) * F.col("debt"), 4).cast("decimal(20,4)")).cast("double"), 4).alias("discounted"), F.count(F.lit(1)).alias("n_positions"))


def bounded_apr(spark, sf_dir):
    """One row: total debt, value, lowest rate, and the rate of return of a vault that lends at it."""
    debt = V.positions(spark, sf_dir).agg(F.sum("debt").cast("double").alias("total_debt"))
    value = V.valued(spark, sf_dir).agg(F.sum("value").cast("double").alias("total_value"))
    lowest = V.assets(spark, sf_dir).agg(F.min(F.col("rate").cast("string").try_cast("double")).alias("lowest_rate"))
    return debt.crossJoin(value).crossJoin(lowest).withColumn("apr", half_up(safe_div(F.col("lowest_rate") * F.col("total_debt"), F.col("total_value")), 8))


def asset_shares(spark, sf_dir):
    """Ratio of each asset in its position, for volatile assets alone as well, and the position's rate cost by asset."""
    by = W.partitionBy("position_id")
    value, total = F.col("value").cast("double"), F.sum("value").over(by).cast("double")
    volatile = F.when(F.col("stable"), None).when(F.count(F.lit(1)).over(by) == 2, F.lit(1.0)).otherwise(value / total)
    return V.valued(spark, sf_dir).withColumns({"ratio": F.try_divide(value, total), "volatile_ratio": volatile}).select("position_id", "asset", "symbol", half_up(F.col("ratio"), 8).alias("ratio"), half_up(F.col("volatile_ratio"), 8).alias("volatile_ratio"), half_up(F.col("ratio") * F.col("rate").cast("double"), 8).alias("rate_cost"))


def portfolio(spark, sf_dir):
    """Per user: value, debt, net value, positions, distinct assets."""
    held = V.valued(spark, sf_dir).groupBy("user").agg(F.sum("value").alias("value"), F.countDistinct("asset").alias("n_assets"))
    owed = V.positions(spark, sf_dir).groupBy("user").agg(F.sum("debt").alias("debt"), F.count(F.lit(1)).alias("n_positions"))
    both = owed.join(held, "user", "left")
    d = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return both.select("user", "n_positions", F.coalesce("n_assets", F.lit(0).cast("long")).alias("n_assets"), d("value").alias("value"), d("debt").alias("debt"), half_up(d("value") - d("debt"), 4).alias("net_value"))


def oracle_health(spark, sf_dir):
    """Per kind of asset: what pools hold of it against what positions hold, and how far the pools exceed it."""
    pools = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("asset")).agg(F.sum((V.exact(F.col("l_extendedprice"), 2))).alias("pool"))
    used = V.valued(spark, sf_dir).groupBy("asset").agg(F.sum("value").alias("value"))
    rows = lookup_join(V.assets(spark, sf_dir).select("asset", "kind"), pools, ["asset"], {}).join(used, "asset", "left")
    sums = rows.groupBy("kind").agg(F.sum("pool").cast("double").alias("pool"), F.sum("value").cast("double").alias("value"), F.count(F.lit(1)).alias("n_assets"))
    return sums.withColumn("health", half_up(L.pool_health(F.col("pool"), F.col("value")), 4))


def intents(spark, sf_dir, most: int = 11):
    """Positions that meet a user's thresholds: take profit, stop loss, arbitrage or deviation. At most `most` per market."""
    p = _per_position(spark, sf_dir).withColumns({"market": F.col("user") % 10, "take_profit": (F.col("user") % 5).cast("double") + 1, "stop_loss": 90 + (F.col("user") % 7).cast("double"), "desired": 40 + (F.col("user") % 13).cast("double")})
    action = F.when(F.col("ltv") <= F.col("take_profit"), "take_profit").when(F.col("ltv") >= F.col("stop_loss"), "stop_loss").when(F.abs(F.col("ltv") - F.col("desired")) <= 0.5, "hold").when(F.abs(F.col("ltv") - F.col("desired")) > 60, "rebalance")
    rows = p.withColumn("action", action).filter(F.col("action").isNotNull() & (F.col("action") != "hold"))
    order = W.partitionBy("market").orderBy(F.desc("debt"), "position_id")
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select("market", F.col("nth").cast("long").alias("nth"), "user", "position_id", "action", "ltv")


def markets_table(spark, sf_dir):
    """Per nation's market: leverage, utilisation, supply rate, a kinked interest rate, sorted by value."""
    s = V.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("market")).agg(F.sum(V.exact(F.greatest("s_acctbal", F.lit(0.0)), 2)).cast("double").alias("supplied"), F.count(F.lit(1)).alias("n_suppliers"))
    b = V.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("market")).agg((F.sum(V.exact(F.greatest("c_acctbal", F.lit(0.0)), 2)) / 20).cast("double").alias("borrowed"))
    n = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("market"), F.col("n_name").alias("name"), (0.5 + (F.col("n_nationkey") % 4) / 10).alias("max_ltv"))
    rows = lookup_join(lookup_join(n, s, ["market"], {"supplied": 0.0, "n_suppliers": 0}), b, ["market"], {"borrowed": 0.0})
    used = F.least(safe_div(F.col("borrowed"), F.col("supplied")), F.lit(1.0))
    out = rows.withColumn("utilisation", used).withColumn("borrow_rate", L.interest_rate(F.col("utilisation"), F.lit(0.01), F.lit(0.1), F.lit(0.8), F.lit(2.0)))
    return out.select("market", "name", "n_suppliers", "supplied", half_up(L.market_leverage(F.col("max_ltv")), 6).alias("leverage"), half_up(F.col("utilisation"), 6).alias("utilisation"), half_up(F.col("borrow_rate"), 6).alias("borrow_rate"), half_up(F.col("borrow_rate") * F.col("utilisation") * 0.95, 6).alias("supply_rate"))


def interest_curve(spark, sf_dir):
    """Per nation's market, a rate curve with a kink at 51 points: the base rate by what its suppliers lack, the kink by
    how many there are."""
    s = V.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("market")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("s_acctbal") < 0, 1)).alias("short"))
    curve = s.select("market", (0.02 + F.col("short") / F.col("n") / 10).alias("base"), (0.5 + F.col("n") % 5 / 10).alias("kink"), F.explode(F.sequence(F.lit(0), F.lit(50)).cast("array<long>")).alias("i"))
    return curve.select("market", "i", half_up(L.interest_rate(F.col("i") / 50, F.col("base"), F.lit(0.1), F.col("kink"), F.lit(3.0)), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (risky_positions, vault_summary, annual_interest, bounded_apr, asset_shares, portfolio, oracle_health, intents, markets_table, interest_curve)}

SQL = {
    "risky_positions": sql_with("valued", PER_POSITION + """SELECT "user", position_id, ltv, floor(liquidation_ltv * 1000000.0 + 0.5) / 1000000.0 AS liquidation_ltv,
  floor((ltv - liquidation_ltv) / 100 * ((ltv - liquidation_ltv) / ltv * debt) * 100.0 + 0.5) / 100.0 AS fee FROM per_position WHERE debt > 0 AND ltv > liquidation_ltv"""),
    "vault_summary": sql_with("valued", PER_POSITION + """SELECT "user", position_id, n_assets, tvl, debt, ltv, borrow_ltv, floor(cost * 1e8 + 0.5) / 1e8 AS cost,
  floor(debt * 1.0 / (liquidation_ltv / 100) * 10000.0 + 0.5) / 10000.0 AS liquidation_value, floor(tvl * (borrow_ltv / 100) * 10000.0 + 0.5) / 10000.0 AS max_mint,
  floor((tvl * (borrow_ltv / 100) - debt) * 10000.0 + 0.5) / 10000.0 AS mintable, floor((100 - ltv / liquidation_ltv * 100) * 10000.0 + 0.5) / 10000.0 AS health,
  floor(tvl / greatest(0.01::DOUBLE, tvl - debt) * 10000.0 + 0.5) / 10000.0 AS leverage FROM per_position"""),
    "annual_interest": sql_with("valued", PER_POSITION + """, firsts AS (SELECT "user", min(position_id) AS position_id FROM positions GROUP BY 1)
SELECT sum((floor(cost * debt * 10000.0 + 0.5) / 10000.0)::DECIMAL(20,4))::DOUBLE AS undiscounted,
  floor(sum((floor(cost * (1 - ("user" % 10)::DOUBLE / 100) * debt * 10000.0 + 0.5) / 10000.0)::DECIMAL(20,4))::DOUBLE * 10000.0 + 0.5) / 10000.0 AS discounted, count(*) AS n_positions
FROM per_position SEMI JOIN firsts USING ("user", position_id) WHERE debt > 1000"""),
    "bounded_apr": sql_with("valued", """SELECT total_debt, total_value, lowest_rate, floor(lowest_rate * total_debt / total_value * 1e8 + 0.5) / 1e8 AS apr
FROM (SELECT sum(debt)::DOUBLE AS total_debt FROM positions), (SELECT sum(value)::DOUBLE AS total_value FROM valued), (SELECT min(rate::VARCHAR::DOUBLE) AS lowest_rate FROM assets)"""),
    "asset_shares": sql_with("valued", """WITH r AS (SELECT *, value::DOUBLE / (sum(value) OVER w)::DOUBLE AS ratio, count(*) OVER w AS n FROM valued WINDOW w AS (PARTITION BY position_id))
SELECT position_id, asset, symbol, floor(ratio * 1e8 + 0.5) / 1e8 AS ratio, floor((CASE WHEN stable THEN NULL WHEN n = 2 THEN 1.0 ELSE ratio END) * 1e8 + 0.5) / 1e8 AS volatile_ratio,
  floor(ratio * rate::DOUBLE * 1e8 + 0.5) / 1e8 AS rate_cost FROM r"""),
    "portfolio": sql_with("valued", """WITH h AS (SELECT "user", sum(value) AS value, count(DISTINCT asset) AS n_assets FROM valued GROUP BY 1), o AS (SELECT "user", sum(debt) AS debt, count(*) AS n_positions FROM positions GROUP BY 1)
SELECT "user", n_positions, coalesce(n_assets, 0) AS n_assets, coalesce(value::DOUBLE, 0.0) AS value, debt::DOUBLE AS debt, floor((coalesce(value::DOUBLE, 0.0) - debt::DOUBLE) * 10000.0 + 0.5) / 10000.0 AS net_value FROM o LEFT JOIN h USING ("user")"""),
    "oracle_health": sql_with("valued", """WITH p AS (SELECT l_partkey AS asset, sum(l_extendedprice::DECIMAL(18,2)) AS pool FROM lineitem GROUP BY 1), u AS (SELECT asset, sum(value) AS value FROM valued GROUP BY 1),
s AS (SELECT kind, sum(pool)::DOUBLE AS pool, sum(value)::DOUBLE AS value, count(*) AS n_assets FROM assets LEFT JOIN p USING (asset) LEFT JOIN u USING (asset) GROUP BY 1)
SELECT kind, pool, value, n_assets, floor((CASE WHEN pool > 0 THEN greatest((pool - value) / pool * 100, 0.0) ELSE 0.0 END) * 10000.0 + 0.5) / 10000.0 AS health FROM s"""),
    "intents": sql_with("valued", PER_POSITION + """, a AS (SELECT *, "user" % 10 AS market, CASE WHEN ltv <= "user" % 5 + 1 THEN 'take_profit' WHEN ltv >= 90 + "user" % 7 THEN 'stop_loss' WHEN abs(ltv - (40 + "user" % 13)) <= 0.5 THEN 'hold' WHEN abs(ltv - (40 + "user" % 13)) > 60 THEN 'rebalance' END AS action FROM per_position),
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY debt DESC, position_id) AS nth FROM a WHERE action IS NOT NULL AND action <> 'hold')
SELECT market, nth, "user", position_id, action, ltv FROM r WHERE nth <= 11"""),
    "markets_table": """WITH s AS (SELECT s_nationkey AS market, sum(greatest(s_acctbal, 0)::DECIMAL(18,2))::DOUBLE AS supplied, count(*) AS n_suppliers FROM supplier GROUP BY 1),
b AS (SELECT c_nationkey AS market, sum(greatest(c_acctbal, 0)::DECIMAL(18,2))::DOUBLE / 20 AS borrowed FROM customer GROUP BY 1),
m AS (SELECT n_nationkey AS market, n_name AS name, 0.5::DOUBLE + (n_nationkey % 4)::DOUBLE / 10 AS max_ltv, coalesce(n_suppliers, 0) AS n_suppliers, coalesce(supplied, 0.0) AS supplied, coalesce(borrowed, 0.0) AS borrowed
  FROM nation LEFT JOIN s ON s.market = n_nationkey LEFT JOIN b ON b.market = n_nationkey),
u AS (SELECT *, least(CASE WHEN supplied = 0 THEN 0.0 ELSE borrowed / supplied END, 1.0) AS u FROM m),
r AS (SELECT *, CASE WHEN u <= 0.8 THEN 0.01::DOUBLE + 0.1::DOUBLE * u ELSE 0.01::DOUBLE + 0.1::DOUBLE * 0.8::DOUBLE + 2.0::DOUBLE * (u - 0.8::DOUBLE) END AS rate FROM u)
SELECT market, name, n_suppliers, supplied, floor(1.0::DOUBLE / (1 - max_ltv) * 1000000.0 + 0.5) / 1000000.0 AS leverage, floor(u * 1000000.0 + 0.5) / 1000000.0 AS utilisation,
  floor(rate * 1000000.0 + 0.5) / 1000000.0 AS borrow_rate, floor(rate * u * 0.95::DOUBLE * 1000000.0 + 0.5) / 1000000.0 AS supply_rate FROM r""",
    "interest_curve": """WITH s AS (SELECT s_nationkey AS market, count(*) AS n, count(*) FILTER (s_acctbal < 0) AS short FROM supplier GROUP BY 1),
c AS (SELECT market, i, i::DOUBLE / 50 AS u, 0.02::DOUBLE + short::DOUBLE / n::DOUBLE / 10 AS base, 0.5::DOUBLE + (n % 5)::DOUBLE / 10 AS kink FROM s, range(51) t(i))
SELECT market, i, floor((CASE WHEN u <= kink THEN base + 0.1::DOUBLE * u ELSE base + 0.1::DOUBLE * kink + 3.0::DOUBLE * (u - kink) END) * 1000000.0 + 0.5) / 1000000.0 AS rate FROM c""",
}
