"""Typed readers of contract and HTTP responses that were landed as JSON lines, and the sinks that answer in JSON.

Wide integers and decimals arrive as strings and stay strings here; times are seconds. A line that doesn't fit its
schema keeps its text in `broken` and has nulls elsewhere, so that one failed answer costs no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COIN = "struct<amount: string, info: struct<native_token: struct<denom: string>, token: struct<address: string>>>"
_COLLATERAL = f"struct<asset: {_COIN}, max_LTV: string, max_borrow_LTV: string, rate_index: string>"
_CLAIMS = "vt_claim_checkpoints array<struct<vt_claim_of_checkpoint: string, time_since_last_checkpoint: double>>, last_updated long"

#: The fields of each response that the reports read, by source and query.
SCHEMAS = {
    "positions": f"user string, positions array<struct<position_id: string, credit_amount: string, avg_borrow_LTV: string, avg_max_LTV: string, cAsset_ratios: array<string>, collateral_assets: array<{_COLLATERAL}>>>",
    "basket": f"basket_id string, collateral_types array<{_COLLATERAL}>, collateral_supply_caps array<struct<asset_info: struct<native_token: struct<denom: string>>, current_supply: string, debt_total: string, supply_cap_ratio: string, lp: boolean>>, credit_price struct<price: string, decimals: int>",
    "collateral_interest": "rates array<string>",
    "liquidation_queue": "liq_premium string, total_bid_amount string, bids array<struct<id: string, user: string, amount: string, liq_premium: double, wait_end: long>>, current_epoch string",
    "staking": "deposit_list array<struct<staker: string, amount: string, stake_time: long, unstake_start_time: long>>, staker string, total_staked string",
    "governance": "proposal_count string, proposal_list array<struct<proposal_id: string, status: string, title: string, for_power: string, against_power: string, amendment_power: string, removal_power: string, aligned_power: string, start_time: long, end_block: long, delayed_end_block: long>>",
    "oracle": "price string, decimals int, prices array<struct<source: string, price: string>>",
    "points": "user string, stats struct<total_points: string, claimable_points: string>",
    "stability_pool": f"credit_asset {_COIN}, liq_premium string, deposits array<struct<user: string, amount: string, deposit_time: long, unstake_time: long>>",
    "vesting": f"recipient string, allocation struct<amount: string, amount_withdrawn: string, start_time_of_allocation: long, vesting_period: struct<cliff: long, linear: long>>, claimables array<{_COIN}>",
    "launch": "user string, deposits array<struct<deposit: string, lock_up_duration: long>>, total_tickets string, incentives_withdrawn string",
    "earn": "week_apr string, month_apr string, three_month_apr string, year_apr string",
    "auction": f"auction_asset {_COIN}, auction_start_time long",
    "brane_auction": "submissions array<struct<submission: struct<submitter: string, proceed_recipient: string, token_uri: string>, curators: array<string>, votes: long, submission_end_time: long>>",
    "oracle_history": "prices array<struct<price: string, timestamp: long>>",
    "ltv_queue": "asset string, slots array<struct<ltv: string, total_deposit_tokens: string, deposit_groups: array<struct<max_borrow_ltv: string, total_deposit_tokens: string, total_locked_vault_tokens: string>>>>",
    "rate_history": "history array<struct<conversion_rate: string, timestamp: struct<seconds: long>>>",
    "vault_lockdrop": "user string, deposits array<struct<amount: string, intended_lock_days: int, deposit_time: double>>",
    "leveraged_yield": "user string, position_id string, collateral_amount string, debt_amount string, timestamp long",
    "isolated_market": "user string, collateral_denom string, position struct<collateral_amount: string, debt_amount: string>, managed boolean",
    "flywheel": "with_oracle struct<total_insurance: string>, without_oracle struct<pending_cdt: string>",
    "earn_vault": _CLAIMS,
    "conversion_rates": "user string, conversion_rates array<struct<vault_address: string, last_conversion_rate: string>>",
    "discounts": "user string, discount string",
    "racing": "car_id string, track_id string, stats struct<solo: struct<tally: long, win_rate: long, fastest: long, first_time: long>, pvp: struct<tally: long, win_rate: long, fastest: long, first_time: long>>",
    "tournament": "current_round long, participants array<string>, matches array<struct<car1: string, car2: string, winner: string>>",
    "revenue_epoch": "epoch_start long, revenue array<struct<asset: string, amount: string>>",
    "network_map": "rate_limits map<string, struct<flow: string, capacity: string>>",
    "market_ltv": "max_ltv string, max_borrow_ltv string",
    "balances": "balances array<struct<denom: string, amount: string>>, pagination struct<next_key: string>",
    "pool": "pool_id string, liquidity array<struct<denom: string, amount: string>>, total_shares struct<amount: string>",
    "price_history": "prices array<array<double>>",
    "contracts": "name string, address string",
    "token_stats": "data array<struct<symbol: string, price: double, volume_24h: double>>",
}


def read_responses(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Landed responses of one source, a JSON object a line, with broken lines marked."""
    return spark.read.schema(f"{SCHEMAS[source]}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)


def parsed(source: str, line: Column | str) -> Column:
    """The same from a string column."""
    return F.from_json(line, f"{SCHEMAS[source]}, broken string", {"columnNameOfCorruptRecord": "broken"})


def write_answer(row: DataFrame, path: str) -> None:
    """A one-row report as a JSON object, the body of an endpoint's answer."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def chart(df: DataFrame, key: str, by: str, values: list[str]) -> DataFrame:
    """One row per key with an array of points in order of `by`, as charts take them. A key's series must fit a row."""
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(by, *values)))).alias("points"))
