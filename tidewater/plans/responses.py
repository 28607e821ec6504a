"""Responses of each source as tables: lines of JSON are made from the star schema, read by their schema and flattened.

Each source is (table, JSON object of a row, what is read of it, the same as SQL). In what is read, r is the response.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.sources import views as V
from tidewater.sources.responses import chart, parsed

_ASSET = "named_struct('amount', {amount}, 'info', named_struct('native_token', named_struct('denom', {denom})))"


def _coin(amount: str, denom: str) -> str:
    return _ASSET.format(amount=amount, denom=denom)


SOURCES = {
    "positions": ("orders",
        f"named_struct('user', cast(o_custkey as string), 'positions', array(named_struct('position_id', cast(o_orderkey as string), 'credit_amount', cast(o_orderkey * 1000003 as string), 'avg_max_LTV', '0.8', 'cAsset_ratios', array('0.25', '0.75'), 'collateral_assets', array(named_struct('asset', {_coin('concat(o_orderkey, repeat(0, 30))', 'concat(\"a\", o_orderkey % 7)')}, 'max_LTV', '0.8', 'max_borrow_LTV', '0.65')))))",
        ["r.user", "inline(r.positions)", "user|position_id|credit_amount|collateral_assets[0].asset.info.native_token.denom AS denom|length(collateral_assets[0].asset.amount) AS digits|cAsset_ratios[1] AS ratio"],
        "SELECT o_custkey::VARCHAR AS \"user\", o_orderkey::VARCHAR AS position_id, (o_orderkey * 1000003)::VARCHAR AS credit_amount, 'a' || o_orderkey % 7 AS denom, (length(o_orderkey::VARCHAR) + 30)::INT AS digits, '0.75' AS ratio FROM orders"),
    "basket": ("part",
        "named_struct('basket_id', '1', 'collateral_supply_caps', array(named_struct('asset_info', named_struct('native_token', named_struct('denom', p_name)), 'current_supply', cast(p_size * 10 as string), 'debt_total', cast(p_partkey as string), 'supply_cap_ratio', '0.3', 'lp', p_size > 40)), 'credit_price', named_struct('price', '0.99', 'decimals', 6))",
        ["r.credit_price.decimals AS decimals", "inline(r.collateral_supply_caps)", "decimals|asset_info.native_token.denom AS denom|current_supply|debt_total|lp"],
        "SELECT 6 AS decimals, p_name AS denom, (p_size * 10)::VARCHAR AS current_supply, p_partkey::VARCHAR AS debt_total, p_size > 40 AS lp FROM part"),
    "collateral_interest": ("part", "named_struct('rates', array(cast(p_size / 1000 as string), '0.5', 'none'))",
        ["p_partkey AS asset", "r.rates AS rates", "asset|try_cast(rates[0] AS double) AS rate|try_cast(element_at(rates, cast(array_position(array('a', 'b', 'c'), 'b') as int)) AS double) AS second|try_cast(rates[2] AS double) IS NULL AS unknown"],
        "SELECT p_partkey AS asset, p_size::DOUBLE / 1000 AS rate, 0.5::DOUBLE AS second, true AS unknown FROM part"),
    "liquidation_queue": ("supplier", "named_struct('liq_premium', cast(s_suppkey % 10 as string), 'total_bid_amount', cast(s_suppkey * 7 as string), 'bids', array(named_struct('id', cast(s_suppkey as string), 'user', s_name, 'amount', cast(s_suppkey * 3 as string), 'liq_premium', 1.5D, 'wait_end', cast(null as bigint)), named_struct('id', cast(-s_suppkey as string), 'user', s_name, 'amount', '4', 'liq_premium', 2D, 'wait_end', 9L)))",
        ["r.liq_premium AS slot", "inline(r.bids)", "slot|id|user|amount|liq_premium AS premium|wait_end"],
        "SELECT (s_suppkey % 10)::VARCHAR AS slot, s_suppkey::VARCHAR AS id, s_name AS \"user\", (s_suppkey * 3)::VARCHAR AS amount, 1.5::DOUBLE AS premium, NULL::BIGINT AS wait_end FROM supplier UNION ALL SELECT (s_suppkey % 10)::VARCHAR, (-s_suppkey)::VARCHAR, s_name, '4', 2, 9 FROM supplier"),
    "staking": ("customer", "named_struct('staker', cast(c_custkey as string), 'total_staked', cast(c_custkey * 5 as string), 'deposit_list', array(named_struct('staker', cast(c_custkey as string), 'amount', cast(c_custkey as string), 'stake_time', c_custkey * 60, 'unstake_start_time', CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 61 END)))",
        ["r.total_staked AS total", "inline(r.deposit_list)", "staker|total|amount|stake_time|unstake_start_time IS NOT NULL AS unstaking"],
        "SELECT c_custkey::VARCHAR AS staker, (c_custkey * 5)::VARCHAR AS total, c_custkey::VARCHAR AS amount, c_custkey * 60 AS stake_time, c_custkey % 3 = 0 AS unstaking FROM customer"),
    "governance": ("orders", "named_struct('proposal_count', '2', 'proposal_list', array(named_struct('proposal_id', cast(o_orderkey as string), 'status', CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'active' ELSE 'rejected' END, 'for_power', cast(o_orderkey * 9 as string), 'aligned_power', '1000000000', 'start_time', o_custkey)))",
        ["r.proposal_count AS n", "inline(r.proposal_list)", "proposal_id|status|cast(for_power as decimal(38,0)) < cast(aligned_power as decimal(38,0)) AS below|start_time"],
        "SELECT o_orderkey::VARCHAR AS proposal_id, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'active' ELSE 'rejected' END AS status, o_orderkey * 9 < 1000000000 AS below, o_custkey AS start_time FROM orders"),
    "oracle": ("part", "named_struct('price', cast(p_partkey as string), 'decimals', 6, 'prices', array(named_struct('source', 'pool', 'price', cast(p_size as string)), named_struct('source', 'feed', 'price', '2')))",
        ["r.price AS price", "inline(r.prices)", "price|source|prices_price"],
        "SELECT p_partkey::VARCHAR AS price, 'pool' AS source, p_size::VARCHAR AS prices_price FROM part UNION ALL SELECT p_partkey::VARCHAR, 'feed', '2' FROM part"),
    "points": ("customer", "named_struct('user', cast(c_custkey as string), 'stats', named_struct('total_points', cast(c_custkey * 3 as string), 'claimable_points', cast(c_custkey as string)))",
        ["r.user AS user", "r.stats AS stats", "user|stats.total_points AS total|stats.claimable_points AS claimable"],
        "SELECT c_custkey::VARCHAR AS \"user\", (c_custkey * 3)::VARCHAR AS total, c_custkey::VARCHAR AS claimable FROM customer"),
    "stability_pool": ("supplier", f"named_struct('credit_asset', {_coin('cast(s_suppkey * 11 as string)', '\"credit\"')}, 'liq_premium', '0.1', 'deposits', array(named_struct('user', s_name, 'amount', cast(s_suppkey as string), 'deposit_time', s_suppkey)))",
        ["r.credit_asset.amount AS pool", "inline(r.deposits)", "pool|user|amount|deposit_time|unstake_time"],
        "SELECT (s_suppkey * 11)::VARCHAR AS pool, s_name AS \"user\", s_suppkey::VARCHAR AS amount, s_suppkey AS deposit_time, NULL::BIGINT AS unstake_time FROM supplier"),
    "vesting": ("customer", f"named_struct('recipient', cast(c_custkey as string), 'allocation', named_struct('amount', cast(c_custkey * 100 as string), 'amount_withdrawn', '7', 'start_time_of_allocation', 5L, 'vesting_period', named_struct('cliff', 90L, 'linear', 270L)), 'claimables', array({_coin('cast(c_custkey as string)', '\"x\"')}))",
        ["r.recipient AS recipient", "r.allocation AS a", "recipient|cast(a.amount as decimal(38,0)) - cast(a.amount_withdrawn as decimal(38,0)) AS left_|a.vesting_period.cliff + a.vesting_period.linear AS days"],
        "SELECT c_custkey::VARCHAR AS recipient, (c_custkey * 100 - 7)::DECIMAL(38,0) AS left_, 360::BIGINT AS days FROM customer"),
    "launch": ("orders", "named_struct('user', cast(o_custkey as string), 'deposits', array(named_struct('deposit', cast(o_orderkey as string), 'lock_up_duration', o_orderkey % 365)), 'total_tickets', cast(o_orderkey * 2 as string), 'incentives_withdrawn', '0')",
        ["r.user AS user, r.total_tickets AS tickets", "inline(r.deposits)", "user|tickets|deposit|lock_up_duration AS days"],
        "SELECT o_custkey::VARCHAR AS \"user\", (o_orderkey * 2)::VARCHAR AS tickets, o_orderkey::VARCHAR AS deposit, o_orderkey % 365 AS days FROM orders"),
    "earn": ("part", "named_struct('week_apr', CASE WHEN p_size > 25 THEN cast(p_size as string) END, 'month_apr', '0.2', 'year_apr', 'n/a')",
        ["p_partkey AS vault", "r.week_apr AS week, r.month_apr AS month, r.year_apr AS year", "vault|coalesce(try_cast(week AS double), try_cast(month AS double)) AS apr|try_cast(year AS double) AS yearly"],
        "SELECT p_partkey AS vault, CASE WHEN p_size > 25 THEN p_size::DOUBLE ELSE 0.2::DOUBLE END AS apr, NULL::DOUBLE AS yearly FROM part"),
    "auction": ("supplier", f"named_struct('auction_asset', {_coin('cast(s_suppkey as string)', 's_name')}, 'auction_start_time', s_suppkey * 10)",
        ["r.auction_asset AS a", "r.auction_start_time AS opened", "a.info.native_token.denom AS denom|a.amount AS amount|opened"],
        "SELECT s_name AS denom, s_suppkey::VARCHAR AS amount, s_suppkey * 10 AS opened FROM supplier"),
    "brane_auction": ("supplier", "named_struct('submissions', array(named_struct('submission', named_struct('submitter', s_name, 'token_uri', concat('ipfs://', s_suppkey)), 'curators', array('a', 'b'), 'votes', s_suppkey % 9, 'submission_end_time', s_suppkey)))",
        ["s_suppkey AS id", "inline(r.submissions)", "id|submission.submitter AS submitter|submission.token_uri AS uri|size(curators) AS curators|votes"],
        "SELECT s_suppkey AS id, s_name AS submitter, 'ipfs://' || s_suppkey AS uri, 2 AS curators, s_suppkey % 9 AS votes FROM supplier"),
    "oracle_history": ("events", "named_struct('prices', array(named_struct('price', cast(event_id as string), 'timestamp', event_id * 60), named_struct('price', 'x', 'timestamp', 0L)))",
        ["event_id", "inline(r.prices)", "event_id|try_cast(price AS double) AS price|timestamp AS seen"],
        "SELECT event_id, event_id::DOUBLE AS price, event_id * 60 AS seen FROM events UNION ALL SELECT event_id, NULL, 0 FROM events"),
    "ltv_queue": ("supplier", "named_struct('asset', cast(s_nationkey as string), 'slots', array(named_struct('ltv', '0.8', 'total_deposit_tokens', cast(s_suppkey as string), 'deposit_groups', array(named_struct('max_borrow_ltv', '0.6', 'total_deposit_tokens', cast(s_suppkey * 2 as string)), named_struct('max_borrow_ltv', '0.7', 'total_deposit_tokens', '5')))))",
        ["r.asset AS asset", "inline(r.slots)", "asset|ltv|inline(deposit_groups)"],
        "SELECT s_nationkey::VARCHAR AS asset, '0.8' AS ltv, '0.6' AS max_borrow_ltv, (s_suppkey * 2)::VARCHAR AS total_deposit_tokens, NULL::VARCHAR AS total_locked_vault_tokens FROM supplier UNION ALL SELECT s_nationkey::VARCHAR, '0.8', '0.7', '5', NULL FROM supplier"),
    "rate_history": ("events", "named_struct('history', array(named_struct('conversion_rate', cast(1 + event_id / 1000 as string), 'timestamp', named_struct('seconds', event_id))))",
        ["event_id", "inline(r.history)", "event_id|cast(conversion_rate as double) AS rate|timestamp.seconds AS seen"],
        "SELECT event_id, 1 + event_id::DOUBLE / 1000 AS rate, event_id AS seen FROM events"),
    "vault_lockdrop": ("orders", "named_struct('user', cast(o_custkey as string), 'deposits', array(named_struct('amount', cast(o_orderkey as string), 'intended_lock_days', cast(o_orderkey % 365 as int), 'deposit_time', o_orderkey + 0.5D)))",
        ["r.user AS user", "inline(r.deposits)", "user|amount|intended_lock_days AS days|cast(floor(deposit_time) as bigint) AS seen"],
        "SELECT o_custkey::VARCHAR AS \"user\", o_orderkey::VARCHAR AS amount, (o_orderkey % 365)::INT AS days, o_orderkey AS seen FROM orders"),
    "leveraged_yield": ("orders", "named_struct('user', cast(o_custkey as string), 'position_id', cast(o_orderkey as string), 'collateral_amount', cast(o_orderkey * 4 as string), 'debt_amount', cast(o_orderkey * 3 as string), 'timestamp', o_orderkey)",
        ["r.user AS user, r.position_id AS position_id", "r.collateral_amount AS c, r.debt_amount AS d", "user|position_id|try_divide(cast(c as double), cast(c as double) - cast(d as double)) AS leverage"],
        "SELECT o_custkey::VARCHAR AS \"user\", o_orderkey::VARCHAR AS position_id, CASE WHEN o_orderkey <> 0 THEN 4.0::DOUBLE END AS leverage FROM orders"),
    "isolated_market": ("orders", "named_struct('user', cast(o_custkey as string), 'collateral_denom', concat('c', o_orderkey % 5), 'position', named_struct('collateral_amount', cast(o_orderkey as string), 'debt_amount', '0'), 'managed', o_orderkey % 2 = 0)",
        ["r.user AS user, r.collateral_denom AS denom", "r.position AS p, r.managed AS managed", "user|denom|p.collateral_amount AS collateral|p.debt_amount = '0' AS free|managed"],
        "SELECT o_custkey::VARCHAR AS \"user\", 'c' || o_orderkey % 5 AS denom, o_orderkey::VARCHAR AS collateral, true AS free, o_orderkey % 2 = 0 AS managed FROM orders"),
    "flywheel": ("supplier", "named_struct('with_oracle', CASE WHEN s_suppkey % 2 = 0 THEN named_struct('total_insurance', cast(s_suppkey as string)) END, 'without_oracle', named_struct('pending_cdt', '9'))",
        ["s_suppkey AS id", "r.with_oracle AS w, r.without_oracle AS o", "id|coalesce(w.total_insurance, o.pending_cdt) AS insurance"],
        "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE '9' END AS insurance FROM supplier"),
    "earn_vault": ("supplier", "named_struct('vt_claim_checkpoints', array(named_struct('vt_claim_of_checkpoint', '100', 'time_since_last_checkpoint', 60D), named_struct('vt_claim_of_checkpoint', cast(100 + s_suppkey as string), 'time_since_last_checkpoint', 40D)), 'last_updated', s_suppkey)",
        ["s_suppkey AS id", "r.vt_claim_checkpoints AS c", "id|aggregate(c, 0D, (a, x) -> a + x.time_since_last_checkpoint) AS seconds|cast(c[1].vt_claim_of_checkpoint as double) / cast(c[0].vt_claim_of_checkpoint as double) AS growth"],
        "SELECT s_suppkey AS id, 100.0::DOUBLE AS seconds, (100 + s_suppkey)::DOUBLE / 100 AS growth FROM supplier"),
    "conversion_rates": ("customer", "named_struct('user', cast(c_custkey as string), 'conversion_rates', array(named_struct('vault_address', 'v', 'last_conversion_rate', cast(c_custkey as string))))",
        ["r.user AS user", "inline(r.conversion_rates)", "user|vault_address AS vault|last_conversion_rate AS rate"],
        "SELECT c_custkey::VARCHAR AS \"user\", 'v' AS vault, c_custkey::VARCHAR AS rate FROM customer"),
    "discounts": ("customer", "named_struct('user', cast(c_custkey as string), 'discount', cast(c_custkey % 100 / 100 as string))",
        ["r.user AS user", "r.discount AS discount", "user|least(cast(discount as double), 1D) AS discount"],
        "SELECT c_custkey::VARCHAR AS \"user\", (c_custkey % 100)::DOUBLE / 100 AS discount FROM customer"),
    "racing": ("orders", "named_struct('car_id', cast(o_custkey as string), 'track_id', cast(o_orderkey % 20 as string), 'stats', named_struct('solo', named_struct('tally', o_orderkey, 'win_rate', 50L)))",
        ["r.car_id AS car, r.track_id AS track", "r.stats AS s", "car|track|s.solo.tally AS tally|coalesce(s.pvp.tally, 0) AS pvp"],
        "SELECT o_custkey::VARCHAR AS car, (o_orderkey % 20)::VARCHAR AS track, o_orderkey AS tally, 0::BIGINT AS pvp FROM orders"),
    "tournament": ("supplier", "named_struct('current_round', s_suppkey % 4, 'participants', array('a', 'b', s_name), 'matches', array(named_struct('car1', 'a', 'car2', s_name, 'winner', CASE WHEN s_suppkey % 2 = 0 THEN 'a' END)))",
        ["r.current_round AS round, size(r.participants) AS n", "inline(r.matches)", "round|n|car2|winner IS NULL AS open"],
        "SELECT s_suppkey % 4 AS round, 3 AS n, s_name AS car2, s_suppkey % 2 <> 0 AS open FROM supplier"),
    "revenue_epoch": ("supplier", "named_struct('epoch_start', s_suppkey * 604800, 'revenue', array(named_struct('asset', 'a', 'amount', cast(s_suppkey as string)), named_struct('asset', 'b', 'amount', '2')))",
        ["r.epoch_start AS epoch", "r.revenue AS v", "epoch|aggregate(v, cast(0 as decimal(38,0)), (a, x) -> cast(a + cast(x.amount as decimal(37,0)) as decimal(38,0))) AS total"],
        "SELECT s_suppkey * 604800 AS epoch, (s_suppkey + 2)::DECIMAL(38,0) AS total FROM supplier"),
    "network_map": ("nation", "named_struct('rate_limits', map(n_name, named_struct('flow', cast(n_nationkey as string), 'capacity', '100')))",
        ["n_nationkey AS id", "explode(r.rate_limits) AS (name, limit)", "id|name|cast(limit.flow as double) / cast(limit.capacity as double) AS used"],
        "SELECT n_nationkey AS id, n_name AS name, n_nationkey::DOUBLE / 100 AS used FROM nation"),
    "market_ltv": ("part", "named_struct('max_ltv', cast(p_size / 100 as string), 'max_borrow_ltv', '0.4')",
        ["p_partkey AS asset", "r.max_ltv AS most, r.max_borrow_ltv AS borrow", "asset|cast(most as double) AS max_ltv|cast(borrow as double) AS max_borrow_ltv"],
        "SELECT p_partkey AS asset, p_size::DOUBLE / 100 AS max_ltv, 0.4::DOUBLE AS max_borrow_ltv FROM part"),
    "balances": ("customer", "named_struct('balances', array(named_struct('denom', 'u', 'amount', cast(c_custkey as string)), named_struct('denom', 'v', 'amount', '0')), 'pagination', named_struct('next_key', CASE WHEN c_custkey % 10 = 0 THEN 'k' END))",
        ["c_custkey AS user, r.pagination.next_key AS next", "inline(r.balances)", "user|denom|amount|next IS NOT NULL AS more"],
        "SELECT c_custkey AS \"user\", 'u' AS denom, c_custkey::VARCHAR AS amount, c_custkey % 10 = 0 AS more FROM customer UNION ALL SELECT c_custkey, 'v', '0', c_custkey % 10 = 0 FROM customer"),
    "pool": ("part", "named_struct('pool_id', cast(p_partkey as string), 'liquidity', array(named_struct('denom', 'a', 'amount', cast(p_size as string)), named_struct('denom', p_name, 'amount', '3')), 'total_shares', named_struct('amount', '10'))",
        ["r.pool_id AS pool", "inline(r.liquidity)", "pool|denom|cast(amount as double) AS amount"],
        "SELECT p_partkey::VARCHAR AS pool, 'a' AS denom, p_size::DOUBLE AS amount FROM part UNION ALL SELECT p_partkey::VARCHAR, p_name, 3 FROM part"),
    "price_history": ("events", "named_struct('prices', array(array(cast(event_id * 1000 as double), cast(value as double)), array(0D, 1D)))",
        ["event_id", "explode(r.prices) AS p", "event_id|cast(p[0] / 1000 as bigint) AS seen|p[1] AS price"],
        "SELECT event_id, event_id AS seen, value AS price FROM events UNION ALL SELECT event_id, 0, 1 FROM events"),
    "contracts": ("nation", "named_struct('name', n_name, 'address', concat('addr', n_nationkey))",
        ["r.name AS name", "r.address AS address", "name|address"],
        "SELECT n_name AS name, 'addr' || n_nationkey AS address FROM nation"),
    "token_stats": ("supplier", "named_struct('data', array(named_struct('symbol', s_name, 'price', 1.5D, 'volume_24h', cast(s_suppkey as double)), named_struct('symbol', 'other', 'price', 0D, 'volume_24h', 0D)))",
        ["s_suppkey AS id", "r.data AS d", "id|d[0].symbol AS symbol|d[0].volume_24h AS volume"],
        "SELECT s_suppkey AS id, s_name AS symbol, s_suppkey::DOUBLE AS volume FROM supplier"),
}


def _reader(source: str):
    """The query of one source; lines that don't fit its schema are left out by their mark."""
    name, payload, (keys, rows, out), _ = SOURCES[source]

    def query(spark, sf_dir):
        lines = V.table(spark, sf_dir, name).withColumn("line", F.expr(f"to_json({payload})"))
        read = lines.withColumn("r", parsed(source, "line")).filter("r.broken is null")
        if source == "oracle":
            read = read.selectExpr("r.price AS price", "explode(r.prices) AS p").selectExpr("price", "p.source AS source", "p.price AS prices_price")
        else:
            read = read.selectExpr(*_split(keys), *_split(rows))
        return read.selectExpr(*out.split("|"))

    query.__name__ = f"source_{source}"
    query.__doc__ = f"Responses of {source}, flattened."
    return query


def _split(text: str) -> list[str]:
    """Expressions parted by commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def token_registry(spark, sf_dir):
    """The token dimension with its derived columns: decimals by kind, a logo with a fallback."""
    p = V.table(spark, sf_dir, "part")
    decimal = F.when(F.col("p_type") == "ECONOMY", 18).otherwise(6)
    return p.select(F.concat(F.lit("u"), F.lower("p_name")).alias("base"), F.upper("p_name").alias("symbol"), decimal.alias("decimal"), F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("/logos/"), F.col("p_partkey"), F.lit(".svg"))).otherwise("/logos/none.svg").alias("logo"), F.col("p_name").contains(" ").alias("is_lp"))


def answer(spark, sf_dir):
    """The body of an endpoint: one row, a JSON object."""
    total = V.positions(spark, sf_dir).agg(F.sum("debt").cast("decimal(28,2)").alias("debt"), F.count(F.lit(1)).alias("positions"))
    return total.select(F.to_json(F.struct(F.col("debt").cast("string").alias("debt"), "positions")).alias("body"))


def charts(spark, sf_dir):
    """Daily sums of each kind of event as arrays in order of time."""
    daily = V.events(spark, sf_dir).groupBy("kind", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").cast("string").alias("value"))
    return chart(daily, "kind", "day", ["value"])


QUERIES = {f"source_{s}": _reader(s) for s in SOURCES} | {f.__name__: f for f in (token_registry, answer, charts)}
SQL = {f"source_{s}": spec[3] for s, spec in SOURCES.items()} | {
    "token_registry": "SELECT 'u' || lower(p_name) AS base, upper(p_name) AS symbol, CASE WHEN p_type = 'ECONOMY' THEN 18 ELSE 6 END AS \"decimal\", CASE WHEN p_size % 4 <> 0 THEN '/logos/' || p_partkey || '.svg' ELSE '/logos/none.svg' END AS logo, contains(p_name, ' ') AS is_lp FROM part",
    "answer": "SELECT '{\"debt\":\"' || (sum((o_totalprice::DECIMAL(18,2) * 0.1::DECIMAL(3,2))::DECIMAL(20,4))::DECIMAL(28,2))::VARCHAR || '\",\"positions\":' || count(*) || '}' AS body FROM orders",
    "charts": "WITH d AS (SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, sum(value::DECIMAL(18,2))::VARCHAR AS value FROM events GROUP BY 1, 2) SELECT kind, to_json(list(struct_pack(day := day, value := value) ORDER BY day))::VARCHAR AS points FROM d GROUP BY 1",
}
