"""Reports on ranges of any bounds: thresholds that positions meet, bands of a market, uneven layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import scan
from tidewater.operators.ranges import overlap_join, range_join, range_sums
from tidewater.plans.lending import PER_POSITION, _per_position
from tidewater.sources import views as V
from tidewater.sources.views import sql_with


def threshold_matches(spark, sf_dir):
    """Positions that meet a threshold of their user: taking profit (at or below), stopping losses (at or above), or
    holding (within half a point of what is desired)."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    u, none = F.col("user"), F.lit(None).cast("double")
    one = lambda kind, low, high: F.struct(F.lit(kind).alias("action"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    thresholds = c.select("user", F.inline(F.array(one("take_profit", none, u % 5 + 1), one("stop_loss", 90 + u % 7, none), one("hold", 40 + u % 13 - 0.5, 40 + u % 13 + 0.5))))
    p = _per_position(spark, sf_dir).select("user", "position_id", "ltv")
    return range_join(p, thresholds, "ltv", "low", "high", ["user"], closed="both").select("user", "position_id", "action", "ltv")


def _bands(spark, sf_dir):
    s, k = V.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    low = (k * 37 % 100).cast("double")
    return s.select(k.alias("band"), F.col("s_nationkey").cast("long").alias("market"), low.alias("low"), (low + 1 + (k % 7) * (k % 7) * (k % 7) / F.lit(10.0)).alias("high"))


def band_matches(spark, sf_dir, share_rows: int = scan.SHARE_ROWS):
    """Per band of a market: the positions whose ltv lies in it, and their debt. Each position lies in many bands, so
    the bands take differences of running totals; pairs of positions and bands would grow with both."""
    p = _per_position(spark, sf_dir).select((F.col("user") % 25).alias("market"), "ltv", F.col("debt").cast("decimal(20,4)").alias("debt"))
    held = range_sums(p, _bands(spark, sf_dir), "ltv", "low", "high", {"debt": "debt"}, ["market"], share_rows)
    return held.select("band", "n", F.coalesce(F.col("debt").cast("double"), F.lit(0.0)).alias("debt"))


def band_overlaps(spark, sf_dir):
    """Pairs of bands of one market that overlap, the smaller first."""
    a = _bands(spark, sf_dir)
    b = a.select(F.col("band").alias("other"), "market", F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    return overlap_join(a, b, ("low", "high"), ("other_low", "other_high"), ["market"]).filter("band < other").select("market", "band", "other", F.greatest("low", "other_low").alias("from"), F.least("high", "other_high").alias("to"))


def uneven_layers(spark, sf_dir):
    """Value and slots of the loss queue in layers whose widths grow, empty layers too, and what lies in none."""
    k = F.col("n_nationkey").cast("long")
    layers = V.table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(k.alias("layer"), (6000 + 5 * k * k).alias("low"), (6000 + 5 * (k + 1) * (k + 1)).alias("high"))
    slots = V.queue_slots(spark, sf_dir).select(F.col("slot"), (F.col("ltv") * 10000).cast("long").alias("points"), "tvl")
    sums = range_join(slots, layers, "points", "low", "high", how="left").groupBy("layer").agg(F.sum("tvl").cast("double").alias("tvl"), F.count(F.lit(1)).alias("n_slots"))
    every = layers.select("layer").unionByName(sums.filter("layer is null").select("layer"))
    out = every.join(sums.withColumnRenamed("layer", "of"), F.col("layer").eqNullSafe(F.col("of")), "left")
    return out.select("layer", F.coalesce("tvl", F.lit(0.0)).alias("tvl"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"))


QUERIES = {f.__name__: f for f in (threshold_matches, band_matches, band_overlaps, uneven_layers)}

_BANDS = "bands AS (SELECT s_suppkey AS band, s_nationkey AS market, (s_suppkey * 37 % 100)::DOUBLE AS low, (s_suppkey * 37 % 100)::DOUBLE + 1 + ((s_suppkey % 7) * (s_suppkey % 7) * (s_suppkey % 7))::DOUBLE / 10.0::DOUBLE AS high FROM supplier)"
SQL = {
    "threshold_matches": sql_with("valued", PER_POSITION + """, t AS (SELECT c_custkey AS u, 'take_profit' AS action, NULL::DOUBLE AS low, (c_custkey % 5 + 1)::DOUBLE AS high FROM customer UNION ALL SELECT c_custkey, 'stop_loss', (90 + c_custkey % 7)::DOUBLE, NULL FROM customer
  UNION ALL SELECT c_custkey, 'hold', 40 + c_custkey % 13 - 0.5::DOUBLE, 40 + c_custkey % 13 + 0.5::DOUBLE FROM customer)
SELECT "user", position_id, action, ltv FROM per_position JOIN t ON u = "user" AND (low IS NULL OR ltv >= low) AND (high IS NULL OR ltv <= high)"""),
    "band_matches": sql_with("valued", PER_POSITION + f""", {_BANDS} SELECT band, count(ltv) AS n, coalesce(sum(debt::DECIMAL(20,4))::DOUBLE, 0.0) AS debt FROM bands LEFT JOIN per_position ON "user" % 25 = market AND ltv >= low AND ltv < high GROUP BY band"""),
    "band_overlaps": f"""WITH {_BANDS} SELECT a.market::BIGINT AS market, a.band, b.band AS other, greatest(a.low, b.low) AS "from", least(a.high, b.high) AS "to" FROM bands a JOIN bands b ON a.market = b.market AND a.band < b.band AND a.low < b.high AND b.low < a.high""",
    "uneven_layers": sql_with("slots", """WITH l AS (SELECT n_nationkey::BIGINT AS layer, 6000 + 5 * n_nationkey * n_nationkey AS low, 6000 + 5 * (n_nationkey + 1) * (n_nationkey + 1) AS high FROM nation WHERE n_nationkey < 20),
m AS (SELECT layer, tvl FROM slots LEFT JOIN l ON (ltv * 10000)::BIGINT >= low AND (ltv * 10000)::BIGINT < high)
SELECT layer, coalesce(sum(tvl)::DOUBLE, 0.0) AS tvl, count(tvl) AS n_slots FROM (SELECT layer, tvl FROM m UNION ALL SELECT layer, NULL FROM l) GROUP BY layer"""),
}
