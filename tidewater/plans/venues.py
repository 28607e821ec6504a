"""Reports on queues, deposits, points, votes and revenue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import formats as S
from tidewater.functions import lending as L
from tidewater.functions.numeric import half_up, safe_div, trunc_dp
from tidewater.operators import scan
from tidewater.operators import windows as X
from tidewater.operators.joins import layer_join
from tidewater.sources import views as V
from tidewater.sources.views import sql_with

TODAY = "1998-12-01"


def _dbl(c: str):
    return F.col(c).cast("double")


def _points(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), V.exact(F.greatest("c_acctbal", F.lit(0.0)), 2).alias("points"))


def leaderboard(spark, sf_dir):
    """Rank, share of all points, and level of every user; ties by user."""
    total = _points(spark, sf_dir).agg(F.sum("points").alias("total"))
    ranked = X.ranked(_points(spark, sf_dir), "points", "user").crossJoin(F.broadcast(total))
    return ranked.select(F.col("rank").cast("long").alias("rank"), "user", _dbl("points").alias("points"), half_up(_dbl("points") / _dbl("total") * 100, 3).alias("share"), L.level(_dbl("points")).alias("level"))


def user_rank(spark, sf_dir, user: int = 7):
    """The rank of one user: users above are counted, nothing is sorted."""
    me = _points(spark, sf_dir).filter(F.col("user") == user).select(F.col("user").alias("me"), F.col("points").alias("mine"))
    ahead = F.count(F.when((F.col("points") > F.col("mine")) | ((F.col("points") == F.col("mine")) & (F.col("user") < F.col("me"))), 1))
    return _points(spark, sf_dir).crossJoin(F.broadcast(me)).groupBy(F.col("me").alias("user")).agg((ahead + 1).alias("rank"), F.count(F.lit(1)).alias("n_users"))


def ltv_metrics(spark, sf_dir):
    """One row: value, weighted thresholds, slots and assets, in one pass."""
    w = lambda c: safe_div(F.sum(F.col("tvl") * F.col(c)).cast("double"), F.sum("tvl").cast("double"))
    return V.queue_slots(spark, sf_dir).agg(F.sum("tvl").cast("double").alias("tvl"), half_up(w("ltv"), 8).alias("ltv"), half_up(w("borrow_ltv"), 8).alias("borrow_ltv"), F.count(F.lit(1)).alias("n_slots"), F.countDistinct("asset").alias("n_assets"), F.min("ltv").cast("double").alias("lowest"), F.max("ltv").cast("double").alias("highest"))


def ltv_pairs(spark, sf_dir):
    """Value by both thresholds, from deposit groups nested in slots."""
    nested = V.queue_slots(spark, sf_dir).select("slot", F.array(F.struct("ltv", F.array(F.struct("borrow_ltv", "tvl")).alias("groups"))).alias("slots"))
    rows = nested.select("slot", F.inline("slots")).select("ltv", F.inline("groups"))
    return rows.groupBy(_dbl("ltv").alias("ltv"), _dbl("borrow_ltv").alias("borrow_ltv")).agg(F.sum("tvl").cast("double").alias("tvl"), F.count(F.lit(1)).alias("n_slots"))


def ltv_segments(spark, sf_dir):
    """Ten segments of three points from 60 percent on, empty ones too, with their share."""
    layered = layer_join(V.queue_slots(spark, sf_dir), _dbl("ltv") * 100, 3.0, 60.0, 10).filter("layer is not null")
    sums = layered.groupBy("layer").agg(F.sum("tvl").cast("double").alias("tvl"), F.count(F.lit(1)).alias("n_slots"))
    every = spark.range(10).select(F.col("id").cast("int").alias("layer"))
    out = every.join(sums, "layer", "left").select("layer", F.coalesce("tvl", F.lit(0.0)).alias("tvl"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"))
    return out.withColumn("share", half_up(safe_div(F.col("tvl"), F.sum("tvl").over(W.partitionBy())) * 100, 6))


def loss_absorption(spark, sf_dir, share_rows: int = scan.SHARE_ROWS):
    """Per asset: value that absorbs losses before each slot (highest thresholds first), its place among slots with
    value, and the place in words."""
    order = [F.desc("ltv"), F.desc("borrow_ltv"), F.col("slot")]
    rows = scan.running(V.queue_slots(spark, sf_dir).filter("tvl > 0"), ["asset"], order, {"up_to": scan.total("tvl"), "place": scan.count()}, share_rows)
    return rows.select("asset", "slot", _dbl("tvl").alias("tvl"), scan.ahead("tvl", F.col("up_to")).cast("double").alias("ahead"), "place", S.ordinal(F.col("place").cast("int")).alias("place_text"))


def lockdrop_alloc(spark, sf_dir, pool: float = 1_000_000.0):
    """Points of each user's locks, share and part of the pool; the largest locks listed."""
    d = V.deposits(spark, sf_dir).withColumn("points", L.lockdrop_points(F.col("amount"), F.col("lock_days").cast("decimal(6,0)"), 1).cast("decimal(28,2)"))
    users = d.groupBy("user").agg(F.sum("points").alias("p"), F.count(F.lit(1)).alias("n_locks"), F.max("amount").cast("double").alias("largest"))
    total = users.agg(F.sum("p").alias("total"))
    share = _dbl("p") / _dbl("total")
    return users.crossJoin(F.broadcast(total)).select("user", "n_locks", "largest", _dbl("p").alias("points"), half_up(share * 100, 8).alias("share"), half_up(share * pool, 4).alias("allocation"))


def proposals(spark, sf_dir, required_stake: float = 1_000_000.0, threshold: float = 0.33):
    """Votes by proposal (orders by customer mod 97): ratios cut to two places, alignment, result by threshold order,
    status, each proposal once, in a set order of statuses."""
    vote = F.col("o_orderkey") % 4
    power = lambda v: F.sum(F.when(vote == v, V.exact(F.col("o_totalprice"), 2)).otherwise(F.lit(0))).cast("double")
    p = V.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 97).alias("proposal")).agg(power(0).alias("for_power"), power(1).alias("against_power"), power(2).alias("amendment_power"), power(3).alias("removal_power"), F.max("o_orderdate").alias("ends"))
    p = p.withColumn("total", F.col("for_power") + F.col("against_power") + F.col("amendment_power") + F.col("removal_power"))
    ratio = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(trunc_dp(F.col(c) / F.col("total") * 100, 2))
    over = lambda c: F.col(c) / F.col("total") > threshold
    result = F.when(over("for_power"), "For").when(over("amendment_power"), "Amend").when(over("removal_power"), "Remove").otherwise("Against")
    status = F.when(F.col("total") < 3.6e7, "pending").when(F.col("ends") >= F.lit("1998-11-01").cast("timestamp_ntz"), "active").otherwise("completed")
    aligned = trunc_dp((F.col("for_power") - required_stake + F.sqrt(F.lit(required_stake))) / F.col("total"), 2)
    return p.select("proposal", ratio("for_power").alias("for_ratio"), ratio("against_power").alias("against_ratio"), ratio("amendment_power").alias("amend_ratio"), ratio("removal_power").alias("remove_ratio"), aligned.alias("align_ratio"), result.alias("result"), status.alias("status"))


def claim_totals(spark, sf_dir):
    """Claims of two sources by coin, zero amounts dropped."""
    l = V.table(spark, sf_dir, "lineitem")
    a = l.select((F.col("l_partkey") % 40).alias("coin"), V.exact(F.col("l_tax") * F.col("l_quantity"), 4).alias("amount"))
    b = l.select((F.col("l_suppkey") % 40).alias("coin"), V.exact(F.col("l_discount") * F.col("l_quantity"), 4).alias("amount"))
    return a.unionByName(b).filter("amount > 0").groupBy("coin").agg(F.sum("amount").cast("double").alias("amount"), F.count(F.lit(1)).alias("n"))


def claims_by_pair(spark, sf_dir):
    """Deposits with the claims of the same threshold pair, summed before they are joined."""
    claims = V.queue_slots(spark, sf_dir).filter("slot % 3 = 0").groupBy("ltv", "borrow_ltv").agg(F.sum("tvl").alias("pending"))
    return V.queue_slots(spark, sf_dir).join(claims, ["ltv", "borrow_ltv"], "left").select("slot", _dbl("tvl").alias("tvl"), F.coalesce(_dbl("pending"), F.lit(0.0)).alias("pending"))


def _voting(spark, sf_dir):
    days = F.datediff(F.lit(TODAY).cast("date"), F.col("day").cast("date"))
    d = V.deposits(spark, sf_dir).withColumn("multiplier", L.lock_multiplier(F.greatest(F.col("lock_days") - days % 365, F.lit(0)).cast("decimal(10,0)"), F.col("perpetual"), 365))
    return d.withColumn("power", (F.col("amount") * F.col("multiplier").cast("decimal(10,0)")).cast("decimal(28,2)"))


def voting_power(spark, sf_dir):
    """Per user: staked, unstaking, power of both and of active stakes, base and boosted."""
    p = _voting(spark, sf_dir)
    s = lambda c, test=None: F.coalesce(F.sum(F.when(test, F.col(c)) if test is not None else F.col(c)).cast("double"), F.lit(0.0))
    return p.groupBy("user").agg(s("amount", ~F.col("unstaking")).alias("staked"), s("amount", F.col("unstaking")).alias("unstaking"), s("power").alias("power"), s("power", ~F.col("unstaking")).alias("active_power"), s("amount", F.col("perpetual")).alias("locked_for_good"))


def fifo_unstake(spark, sf_dir, part: str = "0.3", share_rows: int = scan.SHARE_ROWS):
    """If each user takes out a part of the active stakes, oldest first: what goes from each, and the power lost."""
    p = _voting(spark, sf_dir).filter("not unstaking")
    totals = p.groupBy("user").agg((F.sum("amount") * F.lit(part).cast("decimal(2,1)")).cast("decimal(24,3)").alias("request"))
    rows = scan.running(p, ["user"], ["day", "deposit_id"], {"up_to": scan.total("amount")}, share_rows).join(totals, "user")
    out = rows.withColumn("taken", X.fifo_taken("amount", F.col("request"), scan.ahead("amount", F.col("up_to"))).cast("double"))
    return out.select("deposit_id", "user", _dbl("amount").alias("amount"), "taken", half_up(F.col("taken") / _dbl("amount") * _dbl("power"), 4).alias("power_lost"))


def revenue_sources(spark, sf_dir):
    """Revenue by nation from two cumulative sources (the newest total counts), as columns and in total."""
    o = V.table(spark, sf_dir, "orders").join(V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    newest = lambda prefix: F.max_by(F.when(F.col("o_orderpriority").startswith(prefix), V.exact(F.col("o_totalprice"), 2)), F.when(F.col("o_orderpriority").startswith(prefix), F.struct("o_orderdate", "o_orderkey"))).cast("double")
    out = o.groupBy("nation").agg(F.coalesce(newest("1"), F.lit(0.0)).alias("vault"), F.coalesce(newest("5"), F.lit(0.0)).alias("lockdrop"))
    return out.withColumn("total", half_up(F.col("vault") + F.col("lockdrop"), 4))


def lock_boosts(spark, sf_dir):
    """Boost of each lock, and boosted amount, by how long it runs."""
    elapsed = F.datediff(F.lit(TODAY).cast("date"), F.col("day").cast("date")).cast("double")
    d = V.deposits(spark, sf_dir).withColumn("boost", half_up(L.lock_boost(_dbl("lock_days"), elapsed, 730.0, F.col("perpetual")), 6))
    return d.select("deposit_id", "boost", half_up(F.col("boost") * _dbl("amount"), 4).alias("boosted"), F.when(F.col("perpetual"), "perpetual").when(F.col("lock_days") >= 180, "long").when(F.col("lock_days") >= 30, "middle").otherwise("short").alias("kind"))


QUERIES = {f.__name__: f for f in (leaderboard, user_rank, ltv_metrics, ltv_pairs, ltv_segments, loss_absorption, lockdrop_alloc, proposals, claim_totals, claims_by_pair, voting_power, fifo_unstake, revenue_sources, lock_boosts)}

_R = lambda x, n: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
_T2 = lambda x: f"sign({x}) * floor(abs({x}) * 100.0) / 100.0"
_PTS = "pts AS (SELECT c_custkey AS \"user\", greatest(c_acctbal, 0)::DECIMAL(18,2) AS points FROM customer)"
_VOTE = f"""v AS (SELECT *, (amount * (CASE WHEN perpetual THEN 366 ELSE greatest(greatest(lock_days - (DATE '{TODAY}' - day::DATE) % 365, 0), 0) + 1 END)::DECIMAL(10,0))::DECIMAL(28,2) AS power FROM deposits)"""
SQL = {
    "leaderboard": f"""WITH {_PTS} SELECT row_number() OVER (ORDER BY points DESC, "user") AS rank, "user", points::DOUBLE AS points, {_R("points::DOUBLE / (sum(points) OVER ())::DOUBLE * 100", 3)} AS share, (floor((points::DOUBLE + 1) / 10) + 1)::BIGINT AS level FROM pts""",
    "user_rank": f"""WITH {_PTS}, r AS (SELECT "user", row_number() OVER (ORDER BY points DESC, "user") AS rank, count(*) OVER () AS n_users FROM pts) SELECT * FROM r WHERE "user" = 7""",
    "ltv_metrics": sql_with("slots", f"SELECT sum(tvl)::DOUBLE AS tvl, {_R('sum(tvl * ltv)::DOUBLE / sum(tvl)::DOUBLE', 8)} AS ltv, {_R('sum(tvl * borrow_ltv)::DOUBLE / sum(tvl)::DOUBLE', 8)} AS borrow_ltv, count(*) AS n_slots, count(DISTINCT asset) AS n_assets, min(ltv)::DOUBLE AS lowest, max(ltv)::DOUBLE AS highest FROM slots"),
    "ltv_pairs": sql_with("slots", "SELECT ltv::DOUBLE AS ltv, borrow_ltv::DOUBLE AS borrow_ltv, sum(tvl)::DOUBLE AS tvl, count(*) AS n_slots FROM slots GROUP BY 1, 2"),
    "ltv_segments": sql_with("slots", f"""WITH s AS (SELECT ((ltv * 100)::INT - 60) // 3 AS layer, sum(tvl)::DOUBLE AS tvl, count(*) AS n_slots FROM slots GROUP BY 1)
SELECT l::INT AS layer, coalesce(tvl, 0.0) AS tvl, coalesce(n_slots, 0) AS n_slots, {_R("coalesce(tvl, 0.0) / (sum(tvl) OVER ()) * 100", 6)} AS share FROM range(10) r(l) LEFT JOIN s ON layer = l"""),
    "loss_absorption": sql_with("slots", """WITH r AS (SELECT *, coalesce(sum(tvl) OVER (PARTITION BY asset ORDER BY ltv DESC, borrow_ltv DESC, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, row_number() OVER (PARTITION BY asset ORDER BY ltv DESC, borrow_ltv DESC, slot) AS place FROM slots WHERE tvl > 0)
SELECT asset, slot, tvl::DOUBLE AS tvl, ahead::DOUBLE AS ahead, place, place || CASE WHEN place % 100 BETWEEN 11 AND 13 THEN 'th' WHEN place % 10 = 1 THEN 'st' WHEN place % 10 = 2 THEN 'nd' WHEN place % 10 = 3 THEN 'rd' ELSE 'th' END AS place_text FROM r"""),
    "lockdrop_alloc": sql_with("deposits", f"""WITH u AS (SELECT "user", sum(amount * (1 + lock_days)::DECIMAL(6,0)) AS p, count(*) AS n_locks, max(amount)::DOUBLE AS largest FROM deposits GROUP BY 1)
SELECT "user", n_locks, largest, p::DOUBLE AS points, {_R("p::DOUBLE / (sum(p) OVER ())::DOUBLE * 100", 8)} AS share, {_R("p::DOUBLE / (sum(p) OVER ())::DOUBLE * 1000000.0", 4)} AS allocation FROM u"""),
    "proposals": f"""WITH p AS (SELECT o_custkey % 97 AS proposal, {", ".join(f"sum(CASE WHEN o_orderkey % 4 = {i} THEN o_totalprice::DECIMAL(18,2) ELSE 0 END)::DOUBLE AS {c}" for i, c in enumerate(("f", "a", "m", "r")))}, max(o_orderdate) AS ends FROM orders GROUP BY 1), t AS (SELECT *, f + a + m + r AS total FROM p)
SELECT proposal, {", ".join(f"CASE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE {_T2(f'({c} / total * 100)')} END AS {n}" for c, n in (("f", "for_ratio"), ("a", "against_ratio"), ("m", "amend_ratio"), ("r", "remove_ratio")))}, {_T2("((f - 1000000.0::DOUBLE + sqrt(1000000.0::DOUBLE)) / total)")} AS align_ratio,
  CASE WHEN f / total > 0.33::DOUBLE THEN 'For' WHEN m / total > 0.33::DOUBLE THEN 'Amend' WHEN r / total > 0.33::DOUBLE THEN 'Remove' ELSE 'Against' END AS result,
  CASE WHEN total < 36000000 THEN 'pending' WHEN ends >= TIMESTAMP '1998-11-01' THEN 'active' ELSE 'completed' END AS status FROM t""",
    "claim_totals": """WITH c AS (SELECT l_partkey % 40 AS coin, (l_tax * l_quantity)::DECIMAL(18,4) AS amount FROM lineitem UNION ALL SELECT l_suppkey % 40, (l_discount * l_quantity)::DECIMAL(18,4) FROM lineitem)
SELECT coin, sum(amount)::DOUBLE AS amount, count(*) AS n FROM c WHERE amount > 0 GROUP BY 1""",
    "claims_by_pair": sql_with("slots", "WITH c AS (SELECT ltv, borrow_ltv, sum(tvl) AS pending FROM slots WHERE slot % 3 = 0 GROUP BY 1, 2) SELECT slot, tvl::DOUBLE AS tvl, coalesce(pending::DOUBLE, 0.0) AS pending FROM slots LEFT JOIN c USING (ltv, borrow_ltv)"),
    "voting_power": sql_with("deposits", f"""WITH {_VOTE} SELECT "user", coalesce(sum(amount) FILTER (NOT unstaking)::DOUBLE, 0.0) AS staked, coalesce(sum(amount) FILTER (unstaking)::DOUBLE, 0.0) AS unstaking, sum(power)::DOUBLE AS power,
  coalesce(sum(power) FILTER (NOT unstaking)::DOUBLE, 0.0) AS active_power, coalesce(sum(amount) FILTER (perpetual)::DOUBLE, 0.0) AS locked_for_good FROM v GROUP BY 1"""),
    "fifo_unstake": sql_with("deposits", f"""WITH {_VOTE}, f AS (SELECT *, (sum(amount) OVER (PARTITION BY "user") * 0.3::DECIMAL(2,1))::DECIMAL(24,3) AS request, coalesce(sum(amount) OVER (PARTITION BY "user" ORDER BY day, deposit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v WHERE NOT unstaking),
t AS (SELECT *, least(greatest(request - before, 0), amount)::DOUBLE AS taken FROM f)
SELECT deposit_id, "user", amount::DOUBLE AS amount, taken, {_R("taken / amount::DOUBLE * power::DOUBLE", 4)} AS power_lost FROM t"""),
    "revenue_sources": f"""WITH r AS (SELECT c_nationkey AS nation, coalesce(arg_max(o_totalprice::DECIMAL(18,2), (o_orderdate, o_orderkey)) FILTER (o_orderpriority LIKE '1%')::DOUBLE, 0.0) AS vault,
  coalesce(arg_max(o_totalprice::DECIMAL(18,2), (o_orderdate, o_orderkey)) FILTER (o_orderpriority LIKE '5%')::DOUBLE, 0.0) AS lockdrop FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT *, {_R("vault + lockdrop", 4)} AS total FROM r""",
    "lock_boosts": sql_with("deposits", f"""WITH b AS (SELECT *, {_R(f"CASE WHEN perpetual THEN 2.0::DOUBLE ELSE 1 + least(1.0::DOUBLE, lock_days::DOUBLE / 730.0::DOUBLE + greatest((DATE '{TODAY}' - day::DATE)::DOUBLE, 0.0::DOUBLE) / 730.0::DOUBLE) END", 6)} AS boost FROM deposits)
SELECT deposit_id, boost, {_R("boost * amount::DOUBLE", 4)} AS boosted, CASE WHEN perpetual THEN 'perpetual' WHEN lock_days >= 180 THEN 'long' WHEN lock_days >= 30 THEN 'middle' ELSE 'short' END AS kind FROM b"""),
}
