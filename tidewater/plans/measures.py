"""Caps, quorums, fixed rates, padded lists, dynamic sorts and lookups with fallbacks, each as a small query."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import formats as S
from tidewater.functions import lending as L
from tidewater.functions.numeric import half_up, safe_div, trunc_dp
from tidewater.operators import paging as P
from tidewater.operators import windows as X
from tidewater.operators.joins import first_per_key, lookup_join
from tidewater.sources import views as V
from tidewater.sources.views import sql_with

#: What a fixed rate costs against the variable one, where no terms are given.
TERMS = {"one_month": 1.2, "three_month": 1.5, "six_month": 2.0}


def _dbl(c: str):
    return F.col(c).cast("double")


def supply_caps(spark, sf_dir):
    """Assets with their supply against debt, whether the cap is reached, and whether the value is more than dust.

    The cap's ratio is read under one of two names, the first that is neither missing, empty nor zero.
    """
    l = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("asset"))
    sums = l.agg(F.sum(V.exact(F.col("l_quantity"), 2)).cast("double").alias("supply"), F.sum(V.exact(F.col("l_extendedprice"), 2)).cast("double").alias("value"))
    caps = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), F.when(F.col("p_size") % 3 == 0, F.lit("0")).when(F.col("p_size") % 3 == 1, "").otherwise("0.02").alias("cap"), (F.col("p_size") % 5 / 100).cast("string").alias("cap_ratio"))
    given = lambda c: F.when(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) != 0, F.col(c).try_cast("double"))
    debt = F.col("value") * F.lit(0.001)
    rows = sums.join(caps, "asset").withColumn("cap_ratio", F.coalesce(given("cap"), given("cap_ratio"), F.lit(0.0))).withColumn("ratio", safe_div(F.col("supply"), F.col("supply") + debt))
    return rows.select("asset", "supply", "cap_ratio", half_up(F.col("ratio"), 6).alias("ratio"), ((F.col("cap_ratio") > 0) & (F.col("ratio") >= F.col("cap_ratio"))).alias("reached"), (F.abs(trunc_dp(F.col("supply"), 5)) > 0).alias("held"), (F.col("value") > 1).alias("over_dust"))


def asset_totals(spark, sf_dir):
    """Each asset's value to one decimal place, with the sum of these on every row."""
    rows = V.valued(spark, sf_dir).groupBy("asset", "symbol").agg(F.sum("value").alias("value")).select("asset", "symbol", F.round("value", 1).cast("decimal(28,1)").alias("value"))
    total = rows.agg(F.sum("value").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("asset", "symbol", _dbl("value").alias("value"), _dbl("total").alias("total"))


def collected(spark, sf_dir):
    """Each user's deposits as one list, the earliest first."""
    d = V.deposits(spark, sf_dir).groupBy("user").agg(F.array_sort(F.collect_list(F.struct("deposit_id", _dbl("amount").alias("amount"), "lock_days"))).alias("rows"))
    return d.select("user", F.size("rows").cast("long").alias("n"), F.to_json("rows").alias("rows"))


def padded(spark, sf_dir, length: int = 10):
    """The first deposits of each user, filled up with empty rows to a fixed length."""
    nth = F.row_number().over(W.partitionBy("user").orderBy("deposit_id"))
    first = V.deposits(spark, sf_dir).withColumn("nth", nth.cast("int")).filter(F.col("nth") <= length).select("user", "nth", "deposit_id", _dbl("amount").alias("amount"))
    places = first.select("user").distinct().withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(length))))
    return places.join(first, ["user", "nth"], "left").withColumn("is_new", F.col("deposit_id").isNull())


def quorum(spark, sf_dir):
    """Proposals (one per market): powers by option, aligned power standardised by the stake that is asked for, and
    the quorum, in percent below 1 and as a ratio from 1 on."""
    stake = 1000.0
    e = V.events(spark, sf_dir).groupBy("market").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0)).cast("double").alias(n) for k, n in (("click", "for_power"), ("error", "against_power"), ("view", "amendment_power"), ("signup", "removal_power"), ("purchase", "aligned_power"))), F.sum("value").cast("double").alias("everything"))
    power = F.col("against_power") + F.col("for_power") + (F.col("aligned_power") - stake + F.sqrt(F.lit(stake))) + F.col("amendment_power") + F.col("removal_power")
    q = half_up(power / (F.col("everything") * (F.col("market") % 3 + 1) / 2), 2)
    return e.select("market", half_up(power, 4).alias("power"), F.when(q < 1, half_up(q * 100, 2)).otherwise(q).alias("quorum"))


def voted(spark, sf_dir):
    """Which lists of a proposal's voters name the asking user, and whether any does."""
    asked = F.col("series") == F.col("market") * 7 + 11
    votes = (("click", "voted_for"), ("error", "voted_against"), ("view", "voted_amend"), ("signup", "voted_remove"), ("purchase", "voted_align"))
    flags = V.events(spark, sf_dir).groupBy("market").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, asked)), F.lit(False)).alias(n) for k, n in votes))
    return flags.withColumn("voted", F.col("voted_for") | F.col("voted_against") | F.col("voted_amend") | F.col("voted_remove") | F.col("voted_align"))


def liquidation_totals(spark, sf_dir, share: float = 0.25):
    """A quarter of each user's debt met by the user's assets in proportion: per asset kind the debt repaid, up to what
    the kind's queue holds, and what the rest costs at the asset's price, with totals over all kinds. Assets without a
    price take no part."""
    v = V.valued(spark, sf_dir).filter("price > 0")
    held = v.groupBy("user", "kind").agg(F.sum("value").cast("double").alias("value"))
    ratio = F.col("value") / F.sum("value").over(W.partitionBy("user"))
    debt = V.positions(spark, sf_dir).groupBy("user").agg(F.sum("debt").cast("double").alias("debt"))
    due = held.withColumn("ratio", ratio).join(debt, "user").withColumn("due", half_up(F.col("debt") * share * F.col("ratio"), 4).cast("decimal(24,4)")).groupBy("kind").agg(F.sum("due").cast("double").alias("due"))
    queue = V.table(spark, sf_dir, "supplier").agg(F.sum(V.exact(F.greatest("s_acctbal", F.lit(0.0)), 2)).cast("double").alias("queue"))
    rows = due.crossJoin(F.broadcast(queue)).select("kind", "due", half_up(F.least("due", "queue"), 4).alias("repaid"), half_up(F.greatest(F.col("due") - F.col("queue"), F.lit(0.0)), 4).alias("cost"))
    whole = W.partitionBy()
    return rows.withColumns({"total_repaid": half_up(F.sum("repaid").over(whole), 2), "total_cost": half_up(F.sum("cost").over(whole), 2)})


def lock_progress(spark, sf_dir, day: float = 86400.0):
    """Per user: how far the locks have run, each weighted by its share of the user's tickets."""
    d = V.deposits(spark, sf_dir)
    span = (F.col("lock_days") + 1) * F.lit(day)
    passed = (F.unix_micros(F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("day").cast("timestamp"))) / 1_000_000
    left = F.greatest(span - passed, F.lit(0.0))
    tickets = _dbl("amount") * (F.col("lock_days") + 1)
    rows = d.withColumn("tickets", tickets).withColumn("done", half_up((1 - left / span) * F.col("tickets"), 2).cast("decimal(28,2)")).withColumn("tickets", half_up(F.col("tickets"), 2).cast("decimal(28,2)"))
    s = rows.groupBy("user").agg(F.sum("done").cast("double").alias("done"), F.sum("tickets").cast("double").alias("tickets"))
    return s.select("user", half_up(safe_div(F.col("done"), F.col("tickets"), None), 6).alias("progress"))


def scaled_layers(spark, sf_dir, target: float = 1000.0):
    """Segments of each layer of the loss queue scaled so that the layer adds up to a target; nothing in it: as is."""
    s = V.queue_slots(spark, sf_dir).withColumn("layer", F.floor((_dbl("ltv") * 100 - 60) / 3).cast("long"))
    totals = s.groupBy("layer").agg(F.sum("tvl").cast("double").alias("total"))
    total = F.col("total")
    return s.join(totals, "layer", "left").select("slot", "layer", half_up(F.when(total > 0, _dbl("tvl") * (target / total)).otherwise(_dbl("tvl")), 6).alias("tvl"))


def cap_messages(spark, sf_dir):
    """Error messages that name an asset's cap, found by the assets themselves: a pattern per asset, as a key."""
    assets = V.assets(spark, sf_dir).select(F.col("asset").cast("string").alias("denom"), "symbol")
    messages = V.events(spark, sf_dir).select("event_id", F.concat(F.lit("Error: SUPPLY cap ratio for "), (F.col("event_id") % 2500).cast("string"), F.lit(" exceeded")).alias("message"))
    named = messages.withColumn("denom", F.regexp_extract("message", r"(?i)supply cap ratio for (\S+)", 1))
    return lookup_join(named, assets, ["denom"], {}).select("event_id", F.when(F.col("symbol").isNotNull(), F.concat(F.lit("over its supply cap: "), F.col("symbol"))).otherwise(F.col("message")).alias("text"))


def date_labels(spark, sf_dir):
    """Labels of a time axis."""
    return V.events(spark, sf_dir).select("event_id", F.date_format("ts", "HH:mm").alias("clock"), F.date_format("ts", "MM/dd HH:mm").alias("short"), F.date_format("ts", "M/d/yyyy").alias("day"))


def borrow_rates(spark, sf_dir):
    """Variable rates as the mean over an asset kind's rates (0 without any), and fixed ones: times the terms' factors,
    where a missing or zero factor is the default one."""
    a = V.assets(spark, sf_dir).groupBy("kind").agg((F.avg(_dbl("rate")) * 100).alias("variable"), F.max("asset").alias("last"))
    factor = lambda n, i: F.coalesce(F.expr(f"nullif(cast((last + {i}) % 4 as double) / 2, 0)"), F.lit(TERMS[n]))
    return a.select("kind", half_up(F.coalesce("variable", F.lit(0.0)), 6).alias("variable"), *(half_up(F.col("variable") * factor(n, i), 6).alias(n) for i, n in enumerate(TERMS)))


def mint_and_repay(spark, sf_dir):
    """Positions after a change of collateral: what must be repaid so that the debt is within the limit, and whether
    the debt is over it."""
    from tidewater.plans.lending import _per_position

    most = trunc_dp(F.col("borrow_ltv") * F.col("tvl") / 100, 2)
    over = most < F.col("debt")
    p = _per_position(spark, sf_dir)
    return p.select("position_id", most.alias("limit"), F.lit(0.0).alias("mint"), F.when(over, half_up(F.col("debt") - most, 2)).otherwise(0.0).alias("repay"), over.alias("overdraft"))


def isolated_market(spark, sf_dir):
    """Per position: the price at which one asset no longer covers the debt, and the largest multiplier."""
    h = V.valued(spark, sf_dir)
    first = first_per_key(h, ["position_id"], [F.col("asset")]).join(V.positions(spark, sf_dir).select("position_id", "debt"), "position_id")
    amount, most = _dbl("amount"), _dbl("max_ltv")
    price = F.when((amount > 0) & (most > 0), half_up(L.liquidation_price(_dbl("debt"), amount, most), 4))
    return first.select("position_id", "asset", price.alias("liquidation_price"), half_up(L.market_leverage(most - F.col("position_id") % 5 / 10), 6).alias("max_multiplier"))


def liquidation_prices(spark, sf_dir):
    """Positions with one asset, or with a volatile and a stable one: the price at which they are liquidated; others
    have a threshold only."""
    v = V.valued(spark, sf_dir).groupBy("position_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("value"), F.sum(F.col("value") * F.col("max_ltv")).cast("double").alias("liq"), F.coalesce(F.sum(F.when(F.col("stable"), F.col("value"))), F.lit(0)).cast("double").alias("stable_value"),
        F.count(F.when(~F.col("stable"), 1)).alias("n_volatile"), F.coalesce(F.sum(F.when(~F.col("stable"), F.col("amount"))), F.lit(0)).cast("double").alias("volatile"), F.sum("amount").cast("double").alias("amount"))
    p = v.join(V.debts(spark, sf_dir).select("position_id", _dbl("debt").alias("debt")), "position_id").withColumn("limit", F.try_divide("liq", "value"))
    alone = F.when((F.col("n") == 1) & (F.col("debt") > 0), F.try_divide(F.col("debt"), F.col("amount") * F.col("limit")))
    rest = F.greatest(F.col("debt") - F.col("stable_value"), F.lit(0.0))
    pair = F.when((F.col("n") == 2) & (F.col("n_volatile") == 1) & (rest > 0), F.try_divide(rest, F.col("volatile") * F.col("limit")))
    price = F.coalesce(alone, pair)
    return p.select("position_id", F.when(price.isNotNull(), "price").otherwise("threshold").alias("kind"), half_up(price, 4).alias("price"))


def performance(spark, sf_dir, slippage: float = 1.0):
    """Users' value against a saved baseline, in percent less slippage, signed as the page shows it."""
    held = V.valued(spark, sf_dir).groupBy("user").agg(F.sum("value").cast("double").alias("now"))
    base = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), (F.greatest("c_acctbal", F.lit(0.0)) * 100 + 1).alias("then"))
    change = F.abs((F.col("then") - F.col("now")) / F.col("then") * 100) * (1 - slippage / 100)
    return held.join(base, "user").select("user", F.when(F.col("then") > F.col("now"), "-").otherwise("+").alias("sign"), half_up(change, 4).alias("percent"))


def time_to_full(spark, sf_dir):
    """Energy bars: percent, and the milliseconds until they are full."""
    k = F.col("c_custkey")
    c = V.table(spark, sf_dir, "customer").select(k.alias("user"), (k % 7 * 20).cast("double").alias("most"), (k % 100).cast("double").alias("energy"), (k % 5).cast("double").alias("hours"))
    missing = F.greatest(F.col("most") - F.col("energy"), F.lit(0.0))
    full = F.when((F.col("most") == 0) | (missing == 0) | (F.col("hours") == 0), F.lit(0)).otherwise(F.ceil(missing / F.col("most") * (F.col("hours") * 3_600_000)))
    return c.select("user", F.when(F.col("most") == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), half_up(F.col("energy") / F.col("most") * 100))).alias("percent"), full.cast("long").alias("millis"))


def sorted_table(spark, sf_dir, by: str | None = "multiplier", descending: bool = True):
    """A table sorted by a column that is chosen at run time, as places; display strings sort by their numbers."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.concat(F.lit("$"), S.abbreviated(F.greatest("s_acctbal", F.lit(0.0)) * 1000)).alias("tvl"), F.concat((F.col("s_suppkey") % 37 / 4).cast("string"), F.lit("x")).alias("multiplier"))
    keyed = s.withColumn("value", S.parse_display(F.col(by)) if by else F.lit(0.0))
    return X.ranked(keyed.withColumn("value", F.col("value") if descending else -F.col("value")), "value", "row", "place").select("row", "tvl", "multiplier", "place")


def range_rewards(spark, sf_dir):
    """Means over fixed ranges of each market's first fifteen rewards: lower, middle and upper five, and all."""
    nth = F.row_number().over(W.partitionBy("market").orderBy("event_id"))  # cut to fifteen before the shuffle, too
    first = V.events(spark, sf_dir).filter("kind = 'click'").withColumn("nth", nth).filter("nth <= 15").withColumn("i", F.col("nth") - 1)
    mean = lambda a, b, n: half_up(F.coalesce(F.sum(F.when(F.col("i").between(a, b), F.col("value"))), F.lit(0)).cast("double") / n, 6)
    return first.groupBy("market").agg(mean(0, 4, 5).alias("lower"), mean(5, 9, 5).alias("middle"), mean(10, 14, 5).alias("upper"), mean(0, 14, 15).alias("whole"))


def delegations(spark, sf_dir):
    """Known delegates with what a user's own record says of them: its columns win where it has some, the amount is in
    whole units and 0 without a record (most have none); the largest first, as places."""
    known = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("delegate"), F.col("c_name").alias("name"), F.lit("0.05").alias("commission"))
    own = V.table(spark, sf_dir, "supplier").groupBy(F.col("s_suppkey").alias("delegate")).agg((F.sum(V.exact(F.greatest("s_acctbal", F.lit(0.0)), 2)) * 1000).cast("double").alias("raw"), F.when(F.max("s_nationkey") % 2 == 0, F.lit("0.1")).alias("own"))
    rows = known.join(own, "delegate", "left").select("delegate", "name", F.coalesce("own", "commission").alias("commission"), half_up(F.coalesce("raw", F.lit(0.0)) / 1_000_000).cast("long").alias("amount"))
    return X.ranked(rows, "amount", "delegate", "place").select("delegate", "name", "commission", "amount", "place")


def either_key(spark, sf_dir):
    """Assets found by one of two keys: the keys become one column of the dimension, not an OR in the join."""
    dim = V.assets(spark, sf_dir).select("asset", "symbol", _dbl("max_borrow_ltv").alias("ltv"))
    keys = dim.select(F.col("asset").cast("string").alias("key"), F.lit(0).alias("rank"), "ltv").unionByName(dim.select(F.col("symbol").alias("key"), F.lit(1).alias("rank"), "ltv"))
    known = first_per_key(keys, ["key"], [F.col("rank"), F.col("ltv")]).select("key", "ltv")
    o = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).otherwise(F.lit("unknown")).alias("key"))
    return lookup_join(o, known, ["key"], {"ltv": 0.0}).select("l_orderkey", "l_linenumber", "ltv")


def fanned_out(spark, sf_dir):
    """Price series of a coin for each denomination that uses it; a coin that none uses gives no row."""
    coins = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("denom"), (F.col("p_size") % 11).cast("long").alias("coin"))
    daily = V.events(spark, sf_dir).filter("kind = 'view'").groupBy(F.col("market").alias("coin"), F.to_date("ts").alias("day")).agg(F.max("value").cast("double").alias("price"))
    last = daily.groupBy("coin").agg(F.max("day").alias("day"), F.max_by("price", "day").alias("price"), F.count(F.lit(1)).alias("days"))
    return coins.join(last, "coin").select("denom", "coin", "day", "price", "days")


def tolerant_union(spark, sf_dir):
    """Markets of all managers whose answers can be read: rows of broken ones go to quarantine and are counted."""
    text = F.when(F.col("s_suppkey") % 9 == 4, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("s_nationkey").alias("market"), F.col("s_suppkey").alias("id"))))
    answers = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("manager"), F.from_json(text, "market long, id long, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = answers.filter("r._corrupt_record is null").groupBy(F.col("r.market").alias("market")).agg(F.count(F.lit(1)).alias("n"))
    bad = answers.filter("r._corrupt_record is not null").agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("long").alias("market"), "n")
    return good.unionByName(bad)


def absent_rank(spark, sf_dir):
    """Ranks of three users asked for, by points: null for one who has none, and '0' in the lockdrop's form."""
    users = X.ranked(V.positions(spark, sf_dir).groupBy("user").agg(F.sum("debt").alias("points")), "points", "user").select("user", "rank")
    asked = spark.createDataFrame([(1,), (4,), (-5,)], "user long")
    total = V.positions(spark, sf_dir).select("user").distinct().agg(F.count(F.lit(1)).alias("total"))
    rows = asked.join(users.join(F.broadcast(asked), "user", "left_semi"), "user", "left")
    return rows.crossJoin(F.broadcast(total)).select("user", "rank", F.coalesce(F.col("rank").cast("string"), F.lit("0")).alias("lockdrop_rank"), "total")


def padded_domain(spark, sf_dir):
    """The range of a chart's axis: values less and more a twentieth of the span, in [0, 1000], to whole numbers; per market."""
    s = V.events(spark, sf_dir).groupBy("market").agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))
    pad = (F.col("high") - F.col("low")) * 0.05
    return s.select("market", F.floor(F.greatest(F.col("low") - pad, F.lit(0.0))).cast("long").alias("low"), F.ceil(F.least(F.col("high") + pad, F.lit(1000.0))).cast("long").alias("high"))


def display_strings(spark, sf_dir):
    """Amounts as currency, with zeros cut off, to two significant decimals, and a share between 0 and 1."""
    o = V.table(spark, sf_dir, "orders")
    small = (F.col("o_orderkey") % 9973 + 1) / F.lit(100000.0)
    return o.select("o_orderkey", S.currency(F.col("o_totalprice")).alias("money"), S.trimmed(F.col("o_orderkey") % 1000 / F.lit(8.0), 3).alias("trimmed"), S.to_second_significant(small).alias("significant"),
        half_up(L.share(F.col("o_totalprice"), F.lit(200_000.0)), 6).alias("share"), L.tier(0.8 * (F.col("o_orderkey") % 101) + 0.2 * (F.col("o_custkey") % 101)).alias("tier"), L.minimum_output(F.col("o_orderkey") % 1000, F.lit(1.25), F.lit(0.5)).cast("double").alias("at_least"), half_up(L.auction_discount(F.col("o_orderkey") % 7200, 60.0, 0.01), 6).alias("discount"))


def epoch_apr(spark, sf_dir, days: int = 7):
    """Per market and week: revenue, the newest value, and the week's rate a year; null where there is no value. Weeks
    begin with the first day of the log."""
    e = V.events(spark, sf_dir)
    start = F.to_date(F.lit("2024-01-01"))
    by = e.withColumn("epoch", F.floor(F.datediff(F.to_date("ts"), start) / days).cast("long")).groupBy("market", "epoch")
    s = by.agg(F.coalesce(F.sum(F.when(F.col("kind") == "purchase", F.col("value"))), F.lit(0)).cast("double").alias("revenue"), F.sum(F.when((F.col("kind") == "view") & (F.col("market") != 4), F.col("value"))).cast("double").alias("tvl"))
    return s.select("market", "epoch", "revenue", "tvl", half_up(F.try_divide("revenue", "tvl") * (365 / days) * 100, 4).alias("apr"))


def claimable(spark, sf_dir, pool: float = 1_000_000.0):
    """Points' share of a pool, once the user's period is over; before, nothing."""
    d = V.deposits(spark, sf_dir).groupBy("user").agg(F.sum(half_up(L.lockdrop_points(_dbl("amount"), F.col("lock_days"), 365.0), 2).cast("decimal(24,2)")).alias("points"), F.max("lock_days").alias("lock_days"))
    total = d.agg(F.sum("points").cast("double").alias("total"))
    share = _dbl("points") / F.col("total") * pool
    return d.crossJoin(F.broadcast(total)).select("user", _dbl("points").alias("points"), F.when(F.col("lock_days") < 300, half_up(share, 4)).otherwise(0.0).alias("claimable"))


def wide_sums(spark, sf_dir):
    """Amounts in strings of any length added up as decimals, by market; none of them fits a double exactly."""
    text = F.concat(F.col("event_id").cast("string"), F.lit("000000000000000007"))
    s = V.events(spark, sf_dir).groupBy("market").agg(F.sum(text.cast("decimal(30,0)")).alias("total"))
    return s.select("market", F.col("total").cast("string").alias("total"))


def excluded(spark, sf_dir, ids: tuple[int, ...] = (3, 5, 8)):
    """Markets without those on a list, and the table as it is where the filter says All."""
    e = V.events(spark, sf_dir).filter(~F.col("market").isin(*ids))
    count = lambda df, what: df.groupBy("market").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "market", "n")
    return count(e, "listed").unionByName(count(P.narrowed(e, one_of={"market": ["All"]}), "all"))


def unloop_plan(spark, sf_dir, loops: int = 5, slippage: float = 0.01, least: float = 100.0):
    """How far each position can be unwound: in each round as much value leaves as the limit (or the ltv, if less)
    allows, and repays debt less slippage. A debt that would end below the least one stays at it and ends the plan;
    positions over their limit have none. Rows are the plan's end: rounds, value, debt and ltv."""
    from tidewater.plans.lending import _per_position

    p = _per_position(spark, sf_dir).select("position_id", "tvl", "debt", (F.col("borrow_ltv") / 100).alias("limit"))
    now = lambda s: F.try_divide(s["debt"], s["value"])

    def step(s, _):
        ltv = F.coalesce(now(s), F.lit(0.0))
        out = F.least(F.col("limit") - ltv, ltv) * s["value"]
        paid = out * (1 - slippage)
        small = (s["debt"] - paid > 0) & (s["debt"] - paid < least)
        debt = F.when(small, F.least(s["debt"], F.lit(least))).when(F.col("limit") - ltv >= ltv, F.lit(0.0)).otherwise(s["debt"] - paid)
        goes = (s["open"] == 1) & (s["debt"] > 0) & (ltv <= F.col("limit"))
        value = s["value"] - paid
        return F.struct(F.when(goes, value).otherwise(s["value"]).alias("value"), F.when(goes, debt).otherwise(s["debt"]).alias("debt"), F.when(goes, s["rounds"] + 1).otherwise(s["rounds"]).alias("rounds"), F.when(goes & ~small, 1).otherwise(0).alias("open"))

    start = F.struct(F.col("tvl").alias("value"), F.col("debt").alias("debt"), F.lit(0).alias("rounds"), F.lit(1).alias("open"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(loops)), start, step)
    rows = p.withColumn("end", end)
    return rows.select("position_id", F.col("end.rounds").cast("long").alias("rounds"), half_up(F.col("end.value"), 4).alias("value"), half_up(F.col("end.debt"), 4).alias("debt"), half_up(F.try_divide("end.debt", "end.value"), 6).alias("ltv"))


QUERIES = {f.__name__: f for f in (
    supply_caps, asset_totals, collected, padded, quorum, voted, liquidation_totals, lock_progress, scaled_layers, cap_messages, date_labels, borrow_rates, mint_and_repay, isolated_market, liquidation_prices, performance,
    time_to_full, sorted_table, range_rewards, delegations, either_key, fanned_out, tolerant_union, absent_rank, padded_domain, display_strings, epoch_apr, claimable, wide_sums, excluded, unloop_plan)}

_R = lambda x, n=0: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
_GIVEN = lambda c: f"CASE WHEN coalesce(TRY_CAST({c} AS DOUBLE), 0) <> 0 THEN TRY_CAST({c} AS DOUBLE) END"
_ABBR = lambda v, s: f"regexp_replace(format('{{:.1f}}', floor({v} * 10) / 10), '\\.0$', '') || '{s}'"
_POWERS = (("click", "for_power"), ("error", "against_power"), ("view", "amendment_power"), ("signup", "removal_power"), ("purchase", "aligned_power"))
_VOTES = (("click", "voted_for"), ("error", "voted_against"), ("view", "voted_amend"), ("signup", "voted_remove"), ("purchase", "voted_align"))

SQL = {
    "supply_caps": f"""WITH s AS (SELECT l_partkey AS asset, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS supply, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY 1),
c AS (SELECT p_partkey AS asset, CASE p_size % 3 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE '0.02' END AS cap, ((p_size % 5)::DOUBLE / 100)::VARCHAR AS cap_ratio FROM part),
r AS (SELECT asset, supply, value, coalesce({_GIVEN("cap")}, {_GIVEN("cap_ratio")}, 0.0) AS cap_ratio, CASE WHEN supply + value * 0.001::DOUBLE = 0 THEN 0.0 ELSE supply / (supply + value * 0.001::DOUBLE) END AS ratio FROM s JOIN c USING (asset))
SELECT asset, supply, cap_ratio::DOUBLE AS cap_ratio, {_R("ratio", 6)} AS ratio, cap_ratio > 0 AND ratio >= cap_ratio AS reached, floor(abs(supply) * 1e5) > 0 AS held, value > 1 AS over_dust FROM r""",
    "asset_totals": sql_with("valued", """WITH s AS (SELECT asset, symbol, round(sum(value), 1)::DECIMAL(28,1) AS value FROM valued GROUP BY 1, 2) SELECT asset, symbol, value::DOUBLE AS value, (sum(value) OVER ())::DOUBLE AS total FROM s"""),
    "collected": sql_with("deposits", """WITH l AS (SELECT "user", list(struct_pack(deposit_id := deposit_id, amount := amount::DOUBLE, lock_days := lock_days) ORDER BY deposit_id) AS rows FROM deposits GROUP BY 1) SELECT "user", len(rows) AS n, to_json(rows)::VARCHAR AS rows FROM l"""),
    "padded": sql_with("deposits", """WITH f AS (SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY deposit_id)::INT AS nth, deposit_id, amount::DOUBLE AS amount FROM deposits), u AS (SELECT DISTINCT "user" FROM f)
SELECT u."user", n::INT AS nth, deposit_id, amount, deposit_id IS NULL AS is_new FROM u CROSS JOIN range(1, 11) r(n) LEFT JOIN f ON f."user" = u."user" AND f.nth = n"""),
    "quorum": sql_with("ev", f"""WITH s AS (SELECT market, {", ".join(f"coalesce(sum(value) FILTER (kind = '{k}'), 0)::DOUBLE AS {n}" for k, n in _POWERS)}, sum(value)::DOUBLE AS everything FROM ev GROUP BY 1),
p AS (SELECT *, against_power + for_power + (aligned_power - 1000.0 + sqrt(1000.0::DOUBLE)) + amendment_power + removal_power AS power FROM s), q AS (SELECT *, {_R("power / (everything * (market % 3 + 1) / 2)", 2)} AS q FROM p)
SELECT market, {_R("power", 4)} AS power, CASE WHEN q < 1 THEN {_R("q * 100", 2)} ELSE q END AS quorum FROM q"""),
    "voted": sql_with("ev", f"""WITH v AS (SELECT market, {", ".join(f"coalesce(bool_or(series = market * 7 + 11) FILTER (kind = '{k}'), false) AS {n}" for k, n in _VOTES)} FROM ev GROUP BY 1) SELECT *, {" OR ".join(n for _, n in _VOTES)} AS voted FROM v"""),
    "liquidation_totals": sql_with("valued", f"""WITH h AS (SELECT "user", kind, sum(value)::DOUBLE AS value FROM valued WHERE price > 0 GROUP BY 1, 2), r AS (SELECT *, value / sum(value) OVER (PARTITION BY "user") AS ratio FROM h),
d AS (SELECT "user", sum(debt)::DOUBLE AS debt FROM positions GROUP BY 1), k AS (SELECT kind, sum(({_R("debt * 0.25::DOUBLE * ratio", 4)})::DECIMAL(24,4))::DOUBLE AS due FROM r JOIN d USING ("user") GROUP BY 1),
q AS (SELECT sum(greatest(s_acctbal, 0)::DECIMAL(18,2))::DOUBLE AS queue FROM supplier), o AS (SELECT kind, due, {_R("least(due, queue)", 4)} AS repaid, {_R("greatest(due - queue, 0.0::DOUBLE)", 4)} AS cost FROM k, q)
SELECT *, {_R("sum(repaid) OVER ()", 2)} AS total_repaid, {_R("sum(cost) OVER ()", 2)} AS total_cost FROM o"""),
    "lock_progress": sql_with("deposits", f"""WITH r AS (SELECT "user", (lock_days + 1) * 86400.0::DOUBLE AS span, (epoch_us(TIMESTAMP '1998-01-01') - epoch_us(day)) / 1000000 AS passed, amount::DOUBLE * (lock_days + 1) AS tickets FROM deposits),
s AS (SELECT "user", sum(({_R("(1 - greatest(span - passed, 0.0::DOUBLE) / span) * tickets", 2)})::DECIMAL(28,2))::DOUBLE AS done, sum(({_R("tickets", 2)})::DECIMAL(28,2))::DOUBLE AS tickets FROM r GROUP BY 1)
SELECT "user", CASE WHEN tickets <> 0 THEN {_R("done / tickets", 6)} END AS progress FROM s"""),
    "scaled_layers": sql_with("slots", f"""WITH l AS (SELECT slot, floor((ltv::DOUBLE * 100 - 60) / 3)::BIGINT AS layer, tvl FROM slots), t AS (SELECT *, (sum(tvl) OVER (PARTITION BY layer))::DOUBLE AS total FROM l)
SELECT slot, layer, {_R("CASE WHEN total > 0 THEN tvl::DOUBLE * (1000.0::DOUBLE / total) ELSE tvl::DOUBLE END", 6)} AS tvl FROM t"""),
    "cap_messages": "SELECT event_id, CASE WHEN p_name IS NOT NULL THEN 'over its supply cap: ' || p_name ELSE 'Error: SUPPLY cap ratio for ' || event_id % 2500 || ' exceeded' END AS text FROM events LEFT JOIN part ON p_partkey = event_id % 2500",
    "date_labels": "SELECT event_id, strftime(ts, '%H:%M') AS clock, strftime(ts, '%m/%d %H:%M') AS short, strftime(ts, '%-m/%-d/%Y') AS day FROM events",
    "borrow_rates": sql_with("assets", f"""WITH a AS (SELECT kind, avg(rate::DOUBLE) * 100 AS variable, max(asset) AS last FROM assets GROUP BY 1)
SELECT kind, {_R("coalesce(variable, 0.0)", 6)} AS variable, {", ".join(_R(f"variable * coalesce(nullif(((last + {i}) % 4)::DOUBLE / 2, 0), {v})", 6) + f" AS {n}" for i, (n, v) in enumerate(TERMS.items()))} FROM a"""),
    "mint_and_repay": None,
    "isolated_market": sql_with("valued", f"""WITH f AS (SELECT position_id, min(asset) AS asset, arg_min(amount, asset)::DOUBLE AS amount, arg_min(max_ltv, asset)::DOUBLE AS most FROM valued GROUP BY 1), d AS (SELECT f.*, debt::DOUBLE AS debt FROM f JOIN positions USING (position_id))
SELECT position_id, asset, CASE WHEN amount > 0 AND most > 0 THEN {_R("debt / (amount * most)", 4)} END AS liquidation_price, {_R("CASE WHEN 1 - (most - (position_id % 5)::DOUBLE / 10) <> 0 THEN 1.0::DOUBLE / (1 - (most - (position_id % 5)::DOUBLE / 10)) END", 6)} AS max_multiplier FROM d"""),
    "liquidation_prices": sql_with("valued", f"""WITH v AS (SELECT position_id, count(*) AS n, sum(value)::DOUBLE AS value, sum(value * max_ltv)::DOUBLE AS liq, coalesce(sum(value) FILTER (stable), 0)::DOUBLE AS stable_value, count(*) FILTER (NOT stable) AS n_volatile,
  coalesce(sum(amount) FILTER (NOT stable), 0)::DOUBLE AS volatile, sum(amount)::DOUBLE AS amount FROM valued GROUP BY 1), p AS (SELECT v.*, debt::DOUBLE AS debt, CASE WHEN value <> 0 THEN liq / value END AS lim FROM v JOIN positions USING (position_id)),
q AS (SELECT position_id, coalesce(CASE WHEN n = 1 AND debt > 0 AND amount * lim <> 0 THEN debt / (amount * lim) END, CASE WHEN n = 2 AND n_volatile = 1 AND debt > stable_value AND volatile * lim <> 0 THEN (debt - stable_value) / (volatile * lim) END) AS price FROM p)
SELECT position_id, CASE WHEN price IS NOT NULL THEN 'price' ELSE 'threshold' END AS kind, {_R("price", 4)} AS price FROM q"""),
    "performance": sql_with("valued", f"""WITH h AS (SELECT "user", sum(value)::DOUBLE AS now FROM valued GROUP BY 1), b AS (SELECT c_custkey AS "user", greatest(c_acctbal, 0.0) * 100 + 1 AS past FROM customer)
SELECT "user", CASE WHEN past > now THEN '-' ELSE '+' END AS sign, {_R("abs((past - now) / past * 100) * 0.99::DOUBLE", 4)} AS percent FROM h JOIN b USING ("user")"""),
    "time_to_full": f"""WITH c AS (SELECT c_custkey AS "user", (c_custkey % 7 * 20)::DOUBLE AS most, (c_custkey % 100)::DOUBLE AS energy, (c_custkey % 5)::DOUBLE AS hours FROM customer)
SELECT "user", CASE WHEN most = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, {_R("energy / most * 100")}) END AS percent, CASE WHEN most = 0 OR most <= energy OR hours = 0 THEN 0 ELSE ceil((most - energy) / most * (hours * 3600000))::BIGINT END AS millis FROM c""",
    "sorted_table": f"""WITH s AS (SELECT s_suppkey AS row, greatest(s_acctbal, 0.0) * 1000 AS x, (s_suppkey % 37)::DOUBLE / 4 AS m FROM supplier)
SELECT row, '$' || CASE WHEN x >= 1e9 THEN {_ABBR("x / 1e9", "B")} WHEN x >= 1e6 THEN {_ABBR("x / 1e6", "M")} WHEN x >= 1e3 THEN {_ABBR("x / 1e3", "K")} ELSE {_ABBR("x", "")} END AS tvl, m || 'x' AS multiplier, row_number() OVER (ORDER BY m DESC, row) AS place FROM s""",
    "range_rewards": sql_with("ev", f"""WITH f AS (SELECT market, value, row_number() OVER (PARTITION BY market ORDER BY event_id) - 1 AS i FROM ev WHERE kind = 'click')
SELECT market, {", ".join(_R(f"coalesce(sum(value) FILTER (i BETWEEN {a} AND {b}), 0)::DOUBLE / {b - a + 1}", 6) + f" AS {n}" for n, a, b in (("lower", 0, 4), ("middle", 5, 9), ("upper", 10, 14), ("whole", 0, 14)))} FROM f WHERE i < 15 GROUP BY 1"""),
    "delegations": f"""WITH o AS (SELECT s_suppkey AS delegate, (sum(greatest(s_acctbal, 0)::DECIMAL(18,2)) * 1000)::DOUBLE AS raw, CASE WHEN max(s_nationkey) % 2 = 0 THEN '0.1' END AS own FROM supplier GROUP BY 1),
r AS (SELECT c_custkey AS delegate, c_name AS name, coalesce(own, '0.05') AS commission, ({_R("coalesce(raw, 0.0::DOUBLE) / 1000000")})::BIGINT AS amount FROM customer LEFT JOIN o ON delegate = c_custkey)
SELECT *, row_number() OVER (ORDER BY amount DESC, delegate) AS place FROM r""",
    "either_key": sql_with("assets", """WITH k AS (SELECT asset::VARCHAR AS key, 0 AS rank, max_borrow_ltv::DOUBLE AS ltv FROM assets UNION ALL SELECT symbol, 1, max_borrow_ltv::DOUBLE FROM assets), f AS (SELECT key, arg_min(ltv, (rank, ltv)) AS ltv FROM k GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(ltv, 0.0) AS ltv FROM lineitem LEFT JOIN f ON key = CASE WHEN l_linenumber % 2 = 0 THEN l_partkey::VARCHAR ELSE 'unknown' END"""),
    "fanned_out": sql_with("ev", """WITH d AS (SELECT market AS coin, ts::DATE AS day, max(value)::DOUBLE AS price FROM ev WHERE kind = 'view' GROUP BY 1, 2), l AS (SELECT coin, max(day) AS day, arg_max(price, day) AS price, count(*) AS days FROM d GROUP BY 1)
SELECT p_partkey AS denom, coin::BIGINT AS coin, day, price, days FROM part JOIN l ON coin = p_size % 11"""),
    "tolerant_union": "SELECT s_nationkey::BIGINT AS market, count(*) AS n FROM supplier WHERE s_suppkey % 9 <> 4 GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM supplier WHERE s_suppkey % 9 = 4",
    "absent_rank": sql_with("positions", """WITH p AS (SELECT "user", sum(debt) AS points FROM positions GROUP BY 1), r AS (SELECT "user", row_number() OVER (ORDER BY points DESC, "user") AS rank, count(*) OVER () AS total FROM p)
SELECT a."user", rank, coalesce(rank::VARCHAR, '0') AS lockdrop_rank, (SELECT count(*) FROM p) AS total FROM (VALUES (1::BIGINT), (4), (-5)) a("user") LEFT JOIN r ON r."user" = a."user\""""),
    "padded_domain": sql_with("ev", """WITH s AS (SELECT market, min(value)::DOUBLE AS a, max(value)::DOUBLE AS b FROM ev GROUP BY 1) SELECT market, floor(greatest(a - (b - a) * 0.05::DOUBLE, 0.0))::BIGINT AS low, ceil(least(b + (b - a) * 0.05::DOUBLE, 1000.0))::BIGINT AS high FROM s"""),
    "display_strings": None,
    "epoch_apr": sql_with("ev", f"""WITH s AS (SELECT market, floor(date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE / 7)::BIGINT AS epoch, coalesce(sum(value) FILTER (kind = 'purchase'), 0)::DOUBLE AS revenue, (sum(value) FILTER (kind = 'view' AND market <> 4))::DOUBLE AS tvl FROM ev GROUP BY 1, 2)
SELECT *, CASE WHEN tvl <> 0 THEN {_R("revenue / tvl * (365::DOUBLE / 7) * 100", 4)} END AS apr FROM s"""),
    "claimable": sql_with("deposits", f"""WITH d AS (SELECT "user", sum(({_R("amount::DOUBLE * (1 + lock_days / 365.0::DOUBLE)", 2)})::DECIMAL(24,2)) AS points, max(lock_days) AS lock_days FROM deposits GROUP BY 1), t AS (SELECT sum(points)::DOUBLE AS total FROM d)
SELECT "user", points::DOUBLE AS points, CASE WHEN lock_days < 300 THEN {_R("points::DOUBLE / total * 1000000.0::DOUBLE", 4)} ELSE 0.0::DOUBLE END AS claimable FROM d, t"""),
    "wide_sums": sql_with("ev", "SELECT market, sum((event_id::VARCHAR || '000000000000000007')::DECIMAL(30,0))::VARCHAR AS total FROM ev GROUP BY 1"),
    "excluded": sql_with("ev", "WITH e AS (SELECT market, count(*) AS n FROM ev WHERE market NOT IN (3, 5, 8) GROUP BY 1) SELECT 'listed' AS what, * FROM e UNION ALL SELECT 'all', * FROM e"),
}


def _with_positions() -> None:
    from tidewater.plans.lending import PER_POSITION

    SQL["mint_and_repay"] = sql_with("valued", PER_POSITION + f""", m AS (SELECT position_id, debt, sign(borrow_ltv * tvl / 100) * floor(abs(borrow_ltv * tvl / 100) * 100.0) / 100.0 AS most FROM per_position)
SELECT position_id, most AS "limit", 0.0::DOUBLE AS mint, CASE WHEN most < debt THEN {_R("debt - most", 2)} ELSE 0.0::DOUBLE END AS repay, most < debt AS overdraft FROM m""")


    SQL["unloop_plan"] = sql_with("valued", PER_POSITION + f""", p AS (SELECT position_id, tvl, debt, borrow_ltv / 100 AS lim FROM per_position),
w AS (WITH RECURSIVE r(position_id, lim, value, debt, rounds, going, i) AS (SELECT position_id, lim, tvl, debt, 0, 1, 0 FROM p UNION ALL
  SELECT position_id, lim, CASE WHEN goes THEN value - paid ELSE value END, CASE WHEN goes THEN CASE WHEN small THEN least(debt, 100.0::DOUBLE) WHEN lim - ltv >= ltv THEN 0.0::DOUBLE ELSE debt - paid END ELSE debt END, CASE WHEN goes THEN rounds + 1 ELSE rounds END, CASE WHEN goes AND NOT small THEN 1 ELSE 0 END, i + 1
  FROM (SELECT *, going = 1 AND debt > 0 AND ltv <= lim AS goes, debt - paid > 0 AND debt - paid < 100 AS small FROM (SELECT *, least(lim - ltv, ltv) * value * 0.99::DOUBLE AS paid FROM (SELECT *, CASE WHEN value <> 0 THEN debt / value ELSE 0.0::DOUBLE END AS ltv FROM r WHERE i < 5)))) SELECT * FROM r WHERE i = 5)
SELECT position_id, rounds::BIGINT AS rounds, {_R("value", 4)} AS value, {_R("debt", 4)} AS debt, {_R("CASE WHEN value <> 0 THEN debt / value END", 6)} AS ltv FROM w""")


_with_positions()
_SMALL = "((o_orderkey % 9973 + 1) / 100000.0::DOUBLE)"
SQL["display_strings"] = f"""WITH o AS (SELECT *, {_SMALL} AS s, 0.8::DOUBLE * (o_orderkey % 101) + 0.2::DOUBLE * (o_custkey % 101) AS score, least(12, 1 - floor(log10({_SMALL})))::INT AS places FROM orders)
SELECT o_orderkey, '$' || format('{{:,.2f}}', o_totalprice) AS money, regexp_replace(format('{{:.3f}}', (o_orderkey % 1000) / 8.0::DOUBLE), '\\.?0+$', '') AS trimmed, floor(s * pow(10.0, places) + 0.5) / pow(10.0, places) AS significant,
  {_R("least(greatest(o_totalprice / 200000.0::DOUBLE, 0.0), 1.0)", 6)} AS share, CASE WHEN score >= 80 THEN 'legend' WHEN score >= 50 THEN 'core' WHEN score >= 20 THEN 'member' ELSE 'visitor' END AS tier,
  floor((o_orderkey % 1000) * 1.25::DOUBLE * (1 - 0.5::DOUBLE / 100))::DOUBLE AS at_least, {_R("least(floor((o_orderkey % 7200)::DOUBLE / 60) * 0.01::DOUBLE, 0.99::DOUBLE)", 6)} AS discount FROM o"""
