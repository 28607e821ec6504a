"""Typed reads of four contracts: what each answers, which part of the answer holds the items, and the items' cursor."""

from __future__ import annotations

from dataclasses import dataclass

_INFO = "struct<native_token: struct<denom: string>, token: struct<address: string>>"
_ASSET = f"struct<amount: string, info: {_INFO}>"
_DENOM = "struct<denom: string>"
_CASSET = f"struct<asset: struct<amount: string, info: {_DENOM}>, max_LTV: string, max_borrow_LTV: string, pool_info: struct<asset_infos: array<struct<decimals: long, info: {_DENOM}, ratio: string>>, pool_id: long>, rate_index: string, force_redemptions: boolean>"
_POSITION = f"struct<avg_borrow_LTV: string, avg_max_LTV: string, cAsset_ratios: array<string>, collateral_assets: array<{_CASSET}>, credit_amount: string, position_id: string>"
_PRICE = "struct<decimals: long, price: string, prices: array<struct<price: string, source: string>>>"
_BID = "amount: string, epoch_snapshot: string, id: string, liq_premium: long, pending_liquidated_collateral: string, product_snapshot: string, scale_snapshot: string, sum_snapshot: string, user: string, wait_end: long"
_SLOT = f"bids: array<struct<{_BID}>>, current_epoch: string, current_scale: string, liq_premium: string, product_snapshot: string, residue_bid: string, residue_collateral: string, sum_snapshot: string, total_bid_amount: string, waiting_bids: array<struct<{_BID}>>"
_QUEUE = f"bid_asset: {_ASSET}, bid_threshold: string, current_bid_id: string, max_premium: string"
_STAKE = "amount: string, stake_time: long, staker: string, unstake_start_time: long"
_SHARE = "struct<duration: long, rate: string>"
_DELEGATION = "struct<amount: string, delegate: string, fluidity: boolean, time_of_delegation: long, voting_power_delegation: boolean>"
#: A queue as the second element of a pair of an asset and its queue, whose parts have no common type.
LTV_QUEUE = "struct<slots: array<struct<ltv: string, total_deposit_tokens: string, deposit_groups: array<struct<max_borrow_ltv: string, total_deposit_tokens: string, total_locked_vault_tokens: string>>>>>"
_DEPOSIT = f"vault_tokens: string, asset: {_ASSET}, max_ltv: string, max_borrow_ltv: string, start_time: long, last_claimed: long"


@dataclass(frozen=True)
class Read:
    """schema: of the answer, as column definitions. bare: the answer is the list of items itself, which `items` then
    names. items: the list among the columns, null if the answer is one row. cursor: an expression over an item; null
    if the read has no pages. numeric: whether cursors are numbers."""

    schema: str
    items: str | None = None
    cursor: str | None = None
    numeric: bool = False
    bare: bool = False


def _list(fields: str, cursor: str | None = None, numeric: bool = False) -> Read:
    return Read(f"items array<struct<{fields}>>", "items", cursor, numeric, bare=True)


#: The answers' fields, by contract and query.
READS: dict[tuple[str, str], Read] = {
    ("positions", "config"): Read("base_debt_cap_multiplier string, collateral_twap_timeframe long, cpc_multiplier string, credit_twap_timeframe long, credit_price string, liq_queue string"),
    ("positions", "get_basket_redeemability"): Read("premium_infos array<struct<premium: long, users_of_premium: array<struct<position_infos: array<struct<position_id: string, remaining_loan_repayment: string, restricted_collateral_assets: array<string>>>, position_owner: string>>>>", "premium_infos", "item.premium", True),
    ("positions", "get_basket_positions"): _list(f"positions: array<{_POSITION}>, user: string", "item.user"),
    ("positions", "get_basket"): Read(f"basket_id string, collateral_supply_caps array<struct<asset_info: {_DENOM}, current_supply: string, debt_total: string, lp: boolean, stability_pool_ratio_for_debt_cap: string, supply_cap_ratio: string>>, collateral_types array<{_CASSET}>, credit_asset struct<amount: string, info: {_DENOM}>, credit_price {_PRICE}, current_position_id string, frozen boolean, liq_queue string, multi_asset_supply_caps array<struct<assets: array<{_DENOM}>, supply_cap_ratio: string>>, oracle_set boolean, pending_revenue string, rev_to_stakers boolean"),
    ("positions", "get_basket_debt_caps"): _list(f"cap: string, collateral: {_DENOM}, debt_total: string"),
    ("positions", "get_credit_rate"): Read("credit_interest string, negative_rate boolean"),
    ("positions", "get_collateral_interest"): Read("rates array<string>"),
    ("liquidation_queue", "config"): Read(f"added_assets array<{_INFO}>, bid_asset {_INFO}, maximum_waiting_bids long, minimum_bid string, owner string, positions_contract string, waiting_period long"),
    ("liquidation_queue", "bid"): Read(_BID.replace(": ", " ")),
    ("liquidation_queue", "bids_by_user"): _list(_BID, "item.id", True),
    ("liquidation_queue", "queue"): Read(f"bid_asset {_ASSET}, bid_threshold string, current_bid_id string, max_premium string"),
    ("liquidation_queue", "queues"): _list(_QUEUE, "coalesce(item.bid_asset.info.native_token.denom, item.bid_asset.info.token.address)"),
    ("liquidation_queue", "check_liquidatible"): Read("leftover_collateral string, total_debt_repaid string"),
    ("liquidation_queue", "user_claims"): _list("bid_for: string, pending_liquidated_collateral: string"),
    ("liquidation_queue", "premium_slot"): Read(f"bids array<struct<{_BID}>>, current_epoch string, current_scale string, liq_premium string, product_snapshot string, residue_bid string, residue_collateral string, sum_snapshot string, total_bid_amount string, waiting_bids array<struct<{_BID}>>"),
    ("liquidation_queue", "premium_slots"): _list(_SLOT, "item.liq_premium", True),
    ("staking", "config"): Read(f"auction_contract string, fee_wait_period long, governance_contract string, incentive_schedule {_SHARE}, keep_raw_cdt boolean, max_commission_rate string, mbrn_denom string, osmosis_proxy string, owner string, positions_contract string, unstaking_period long, vesting_contract string, vesting_rev_multiplier string"),
    ("staking", "user_stake"): Read(f"deposit_list array<struct<{_STAKE}>>, staker string, total_staked string"),
    ("staking", "user_rewards"): Read(f"accrued_interest string, claimables array<{_ASSET}>"),
    ("staking", "staked"): Read(f"stakers array<struct<{_STAKE}>>", "stakers", "item.stake_time", True),
    ("staking", "delegations"): _list(f"delegation_info: struct<commission: string, delegated: array<{_DELEGATION}>, delegated_to: array<{_DELEGATION}>>, user: string", "item.user"),
    ("staking", "fee_events"): Read(f"fee_events array<struct<fee: {_ASSET}, time_of_event: long>>", "fee_events", "item.time_of_event", True),
    ("staking", "total_staked"): Read("total_not_including_vested string, vested_total string"),
    ("staking", "incentive_schedule"): Read(f"ownership_distribution {_SHARE}, start_time long"),
    ("ltv_queue", "get_ltv_queue"): Read("queues array<array<string>>", "queues", "item[0]"),
    ("ltv_queue", "get_backing_deposits_by_user"): Read(f"deposits array<struct<{_DEPOSIT}>>", "deposits", "item.start_time", True),
    ("ltv_queue", "get_locked_deposits"): Read("locked_deposits array<struct<asset: string, ltv: string, max_borrow_ltv: string, deposit: struct<vault_tokens: string, start_time: long, locked: struct<locked_until: long, perpetual_lock: boolean>>>>", "locked_deposits"),
    ("ltv_queue", "get_user_lifetime_revenue"): _list("timestamp: long, total_claimed: string"),
    ("ltv_queue", "pending_claims"): Read("claims array<struct<max_ltv: string, max_borrow_ltv: string, pending_amount: string>>", "claims"),
    ("ltv_queue", "get_daily_tvl"): Read("entries array<struct<timestamp: long, time: long, tvl: string, value: string>>", "entries"),
    ("ltv_queue", "get_daily_ltv"): Read("entries array<struct<timestamp: long, average_max_ltv: string, average_max_borrow_ltv: string>>", "entries"),
    ("ltv_queue", "get_revenue_events"): Read("events array<struct<timestamp: long, time: long, revenue: string, amount: string>>", "events"),
    ("ltv_queue", "get_cumulative_revenue"): Read("entries array<struct<timestamp: long, revenue: string, total_revenue: string, total_claimed: string>>", "entries"),
    ("ltv_queue", "get_assets"): Read("assets array<string>", "assets"),
}
