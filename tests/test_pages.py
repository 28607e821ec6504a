"""Pages of contracts: read from files, followed by cursors, quarantined, and fetched by the data source."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from tidewater.sources import pages
from tidewater.sources.live import ContractPages
from tidewater.sources.reads import LTV_QUEUE, READS

BID = {"amount": "5", "epoch_snapshot": "0", "id": "3", "liq_premium": 2, "pending_liquidated_collateral": "0", "product_snapshot": "1", "scale_snapshot": "0", "sum_snapshot": "0", "user": "u", "wait_end": None}
SLOT = {"bids": [BID], "current_epoch": "0", "current_scale": "0", "liq_premium": "2", "product_snapshot": "1", "residue_bid": "0", "residue_collateral": "0", "sum_snapshot": "0", "total_bid_amount": "5", "waiting_bids": []}
ASSET = {"amount": "340282366920938463463374607431768211455", "info": {"native_token": {"denom": "ucoin"}}}
CASSET = {"asset": {"amount": "7", "info": {"denom": "ucoin"}}, "max_LTV": "0.8", "max_borrow_LTV": "0.6", "rate_index": "1", "pool_info": None, "force_redemptions": None}
QUEUE = {"bid_asset": ASSET, "bid_threshold": "1", "current_bid_id": "9", "max_premium": "10"}
STAKE = {"amount": "5", "stake_time": 12, "staker": "s", "unstake_start_time": None}
DELEGATION = {"amount": "5", "delegate": "d", "fluidity": True, "time_of_delegation": 5, "voting_power_delegation": False}
#: An answer of each read as a contract gives it, and the number of rows in it.
ANSWERS = {
    ("positions", "config"): ({"base_debt_cap_multiplier": "3", "collateral_twap_timeframe": 60, "cpc_multiplier": "1", "credit_twap_timeframe": 60, "credit_price": "1", "liq_queue": None}, 1),
    ("positions", "get_basket_redeemability"): ({"premium_infos": [{"premium": 1, "users_of_premium": [{"position_infos": [{"position_id": "1", "remaining_loan_repayment": "2", "restricted_collateral_assets": []}], "position_owner": "o"}]}]}, 1),
    ("positions", "get_basket_positions"): ([{"user": u, "positions": [{"avg_borrow_LTV": "0.4", "avg_max_LTV": "0.6", "cAsset_ratios": ["1"], "collateral_assets": [CASSET], "credit_amount": "7", "position_id": "1"}]} for u in "ab"], 2),
    ("positions", "get_basket"): ({"basket_id": "1", "collateral_supply_caps": [], "collateral_types": [CASSET], "credit_asset": {"amount": "1", "info": {"denom": "c"}}, "credit_price": {"decimals": 6, "price": "1", "prices": []}, "current_position_id": "4", "frozen": False, "multi_asset_supply_caps": [], "oracle_set": True, "pending_revenue": "0", "rev_to_stakers": True}, 1),
    ("positions", "get_basket_debt_caps"): ([{"cap": "5", "collateral": {"denom": "c"}, "debt_total": "2"}], 1),
    ("positions", "get_credit_rate"): ({"credit_interest": "0.01", "negative_rate": False}, 1),
    ("positions", "get_collateral_interest"): ({"rates": ["0.1", "0.2"]}, 1),
    ("liquidation_queue", "config"): ({"bid_asset": {"native_token": {"denom": "c"}}, "maximum_waiting_bids": 5, "minimum_bid": "1", "owner": "o", "positions_contract": "p", "waiting_period": 9}, 1),
    ("liquidation_queue", "bid"): (BID, 1),
    ("liquidation_queue", "bids_by_user"): ([BID, BID | {"id": "11"}], 2),
    ("liquidation_queue", "queue"): (QUEUE, 1),
    ("liquidation_queue", "queues"): ([QUEUE], 1),
    ("liquidation_queue", "check_liquidatible"): ({"leftover_collateral": "0", "total_debt_repaid": "5"}, 1),
    ("liquidation_queue", "user_claims"): ([{"bid_for": "ucoin", "pending_liquidated_collateral": "3"}], 1),
    ("liquidation_queue", "premium_slot"): (SLOT, 1),
    ("liquidation_queue", "premium_slots"): ([SLOT], 1),
    ("staking", "config"): ({"fee_wait_period": 1, "incentive_schedule": {"duration": 5, "rate": "0.1"}, "keep_raw_cdt": True, "max_commission_rate": "0.1", "mbrn_denom": "m", "owner": "o", "unstaking_period": 4, "vesting_rev_multiplier": "1"}, 1),
    ("staking", "user_stake"): ({"deposit_list": [STAKE], "staker": "s", "total_staked": "5"}, 1),
    ("staking", "user_rewards"): ({"accrued_interest": "1", "claimables": [ASSET]}, 1),
    ("staking", "staked"): ({"stakers": [STAKE]}, 1),
    ("staking", "delegations"): ([{"delegation_info": {"commission": "0.1", "delegated": [DELEGATION], "delegated_to": []}, "user": "u"}], 1),
    ("staking", "fee_events"): ({"fee_events": [{"fee": ASSET, "time_of_event": 8}]}, 1),
    ("staking", "total_staked"): ({"total_not_including_vested": "5", "vested_total": "2"}, 1),
    ("staking", "incentive_schedule"): ({"ownership_distribution": {"duration": 5, "rate": "0.1"}, "start_time": 3}, 1),
    ("ltv_queue", "get_ltv_queue"): ({"queues": [["ucoin", {"slots": [{"ltv": "0.8", "total_deposit_tokens": "5", "deposit_groups": []}]}]]}, 1),
    ("ltv_queue", "get_backing_deposits_by_user"): ({"deposits": [{"vault_tokens": "5", "asset": ASSET, "max_ltv": "0.8", "max_borrow_ltv": "0.7", "start_time": 4, "last_claimed": 5}]}, 1),
    ("ltv_queue", "get_locked_deposits"): ({"locked_deposits": [{"asset": "a", "ltv": "0.8", "max_borrow_ltv": "0.7", "deposit": {"vault_tokens": "5", "start_time": 3, "locked": {"locked_until": 9, "perpetual_lock": False}}}]}, 1),
    ("ltv_queue", "get_user_lifetime_revenue"): ([{"timestamp": 1, "total_claimed": "5"}], 1),
    ("ltv_queue", "pending_claims"): ({"claims": [{"max_ltv": "0.75", "max_borrow_ltv": "0.7", "pending_amount": "5"}]}, 1),
    ("ltv_queue", "get_daily_tvl"): ({"entries": [{"timestamp": 1, "tvl": "5"}, {"time": 2, "value": "6"}]}, 2),
    ("ltv_queue", "get_daily_ltv"): ({"entries": [{"timestamp": 1, "average_max_ltv": "0.8", "average_max_borrow_ltv": "0.7"}]}, 1),
    ("ltv_queue", "get_revenue_events"): ({"events": [{"timestamp": 1, "amount": "5"}]}, 1),
    ("ltv_queue", "get_cumulative_revenue"): ({"entries": [{"timestamp": 1, "total_revenue": "5"}]}, 1),
    ("ltv_queue", "get_assets"): ({"assets": ["a", "b"]}, 2),
}


def write(folder, contract, query, *landings):
    path = folder / f"contract={contract}" / f"query={query}"
    os.makedirs(path, exist_ok=True)
    with open(path / f"{len(os.listdir(path))}.json", "w") as f:
        for x in landings:
            f.write((x if isinstance(x, str) else json.dumps(x)) + "\n")


def page(answer, **asked):
    return {"limit": 2, "landed_at": 1, "body": answer if isinstance(answer, str) else json.dumps(answer)} | asked


def leaves(value):
    """The numbers, texts and flags in an answer."""
    if isinstance(value, dict):
        return sorted(x for v in value.values() for x in leaves(v))
    if isinstance(value, (list, tuple)):
        return sorted(x for v in value for x in leaves(v))
    return [] if value is None else [str(value)]


def test_every_read_has_an_answer_here():
    assert set(ANSWERS) == set(READS) and [sum(c == k for c, _ in READS) for k in ("positions", "liquidation_queue", "staking", "ltv_queue")] == [7, 9, 8, 10]


def test_answers_are_read_whole_by_type(spark, tmp_path):
    """Of each read, all that the answer holds comes back in typed columns."""
    for (contract, query), (answer, _) in ANSWERS.items():
        write(tmp_path, contract, query, page(answer, limit=9))
    landed = pages.landed_pages(spark, str(tmp_path))
    for (contract, query), (answer, n) in ANSWERS.items():
        rows = pages.read_rows(landed, contract, query)
        got = [r.asDict(recursive=True) for r in rows.collect()]
        assert len(got) == n, query
        if query != "get_ltv_queue":  # the queue in it is text until it is parsed
            items = READS[contract, query].items
            held = answer if not items or isinstance(answer, list) else answer[items]
            assert leaves([{k: v for k, v in r.items() if k != "asked_user"} for r in got]) == leaves(held), query
    queue = pages.read_rows(landed, "ltv_queue", "get_ltv_queue").select(F.col("item")[0].alias("asset"), F.from_json(F.col("item")[1], LTV_QUEUE).alias("q")).first()
    assert queue.asset == "ucoin" and queue.q.slots[0].ltv == "0.8"


def test_pages_are_followed(spark, tmp_path):
    bids = lambda *ids: [BID | {"id": str(i)} for i in ids]
    where = ("liquidation_queue", "bids_by_user")
    write(tmp_path, *where, page(bids(2, 9), user="a"), page(bids(10, 11), user="a", start_after="9"), page(bids(100), user="a", start_after="11"))
    write(tmp_path, *where, page(bids(1, 2), user="gap"), page(bids(7, 8), user="gap", start_after="5"), page(bids(9), user="gap", start_after="8"))
    write(tmp_path, *where, page(bids(5), user="headless", start_after="4"), page([], user="empty"))
    write(tmp_path, *where, "{this is no page", page('[{"id": "1"', user="b"), page(bids(6, 7), user="b", landed_at=3), page(bids(8), user="b", landed_at=2), page('[{"id": "1"', user="b", landed_at=9))
    write(tmp_path, *where, page(bids(8), user="b", start_after="7", limit=None), page({"user": "c", "body": None}, user="c", body=None, error="timeout"), page('{"not": "a list"}', user="d"))
    landed = pages.landed_pages(spark, str(tmp_path))
    got = {}
    for r in pages.read_rows(landed, *where).collect():
        got.setdefault(r.asked_user, []).append(int(r.id))
    assert {u: sorted(x) for u, x in got.items()} == {"a": [2, 9, 10, 11, 100], "gap": [1, 2], "b": [6, 7, 8]}
    kept = pages.followed(landed, *where, share_rows=1).select("user", "start_after", "reached", "ended").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(map(tuple, pages.followed(landed, *where).select("user", "start_after", "reached", "ended").collect()), key=str)
    assert {(r.user, r.start_after): (r.reached, r.ended) for r in kept if r.user in ("a", "gap")} == {("a", None): (True, False), ("a", "9"): (True, False), ("a", "11"): (True, True), ("gap", None): (True, False), ("gap", "5"): (False, False), ("gap", "8"): (False, True)}
    counts = {r.reason: r.n for r in pages.quarantine_counts(landed, [where]).collect()}
    assert counts == {"no page": 1, "unfit answer": 3, "error": 1, "unreached": 3}
    assert pages.quarantine(landed, *where).filter("reason = 'no page'").first().text == "{this is no page"


def test_a_read_opens_its_own_files_only(spark, tmp_path):
    for query in ("bid", "queue"):
        write(tmp_path, "liquidation_queue", query, page(BID))
    plan = pages.read_rows(pages.landed_pages(spark, str(tmp_path)), "liquidation_queue", "bid")
    assert "PartitionFilters: [isnotnull(contract" in plan._jdf.queryExecution().toString()
    write(tmp_path, "liquidation_queue", "queue", "{broken")
    assert pages.quarantine_counts(pages.landed_pages(spark, str(tmp_path)), [("liquidation_queue", "bid")]).collect() == []


@pytest.mark.parametrize("few", [0, 300_000])
def test_of_good_landings_of_a_page_the_newest_counts(spark, tmp_path, monkeypatch, few):
    """Landed twice: a copy, a later one, one of the same time; with and without a broadcast of what is left out."""
    monkeypatch.setattr(pages, "BROADCAST_PAGES", few, raising=False)
    bids = lambda *ids: [BID | {"id": str(i)} for i in ids]
    where = ("liquidation_queue", "bids_by_user")
    write(tmp_path, *where, page(bids(1, 2), user="copy"), page(bids(3), user="copy", start_after="2"), page(bids(1, 2), user="copy"))
    write(tmp_path, *where, page(bids(1, 2), user="late"), page(bids(1, 4), user="late", landed_at=2), page(bids(5), user="late", start_after="4"), page(bids(3), user="late", start_after="2"))
    write(tmp_path, *where, page(bids(1, 3), user="tie"), page(bids(1, 2), user="tie"), page(bids(9), user="tie", start_after="3"), page("[{", user="tie", landed_at=7))
    write(tmp_path, *where, page(bids(6), user=None), page(bids(7), user=None, landed_at=2), page(bids(8), user="one"), page([], user="none"))
    landed = pages.landed_pages(spark, str(tmp_path))
    got = sorted((str(r.asked_user), int(r.id)) for r in pages.read_rows(landed, *where).collect())
    assert got == sorted([("copy", 1), ("copy", 2), ("copy", 3), ("late", 1), ("late", 4), ("tie", 1), ("tie", 3), ("tie", 9), ("None", 7), ("one", 8)])
    kept = [(r.user, r.start_after) for r in pages.followed(landed, *where).filter("reached").collect()]
    assert len(kept) == len(set(kept)) == 8
    assert {r.reason: r.n for r in pages.quarantine_counts(landed, [where]).collect()} == {"unfit answer": 1, "unreached": 2}
    assert sorted((r.user, r.start_after) for r in pages.quarantine(landed, *where).filter("reason = 'unreached'").collect()) == [("late", "2"), ("late", "4")]


def test_pages_of_one_read_are_landed_as_pages_of_several(spark, tmp_path):
    """One read's pages go to its folder unsorted, in files that end after so many pages; all are read again."""
    rows = spark.range(7).selectExpr("'staking' AS contract", "'staked' AS query", "CAST(null AS STRING) AS user", "CAST(nullif(id, 0) AS STRING) AS start_after", "CAST(null AS STRING) AS until", "1L AS limit", "1L AS landed_at", """concat('{"stakers":[{"stake_time":', id + 1, '}]}') AS body""", "CAST(null AS STRING) AS error")
    pages.land(rows, str(tmp_path / "a"))
    pages.land(rows, str(tmp_path / "b"), "staking", "staked")
    found = [sorted(r.stake_time for r in pages.read_rows(pages.landed_pages(spark, str(tmp_path / x)), "staking", "staked").collect()) for x in "ab"]
    assert found[0] == found[1] == list(range(1, 8))


# ------------------------------------------------------------------ the data source

CLIENT = '''
import json
CALLS = {calls!r}
def ask(contract, query, params):
    with open(CALLS, "a") as f:
        f.write(json.dumps([contract, params["user"], params["start_after"]]) + "\\n")
    if contract == "down":
        raise TimeoutError("no answer")
    if contract == "odd":
        return "[{{"
    after = int(params["start_after"] or 0)
    keys = [k for k in range(1, 12) if k > after and (params["user"] is None or params["user"] == "u%d" % (k % 2))]
    return json.dumps([{{"id": str(k), "user": "u%d" % (k % 2), "liq_premium": 1}} for k in keys[: params["limit"]]])
'''


@pytest.fixture
def client(spark, tmp_path):
    (tmp_path / "code").mkdir()
    module = "page_client_" + tmp_path.name
    (tmp_path / "code" / f"{module}.py").write_text(CLIENT.format(calls=str(tmp_path / "calls")))
    spark.sparkContext.addPyFile(str(tmp_path / "code" / f"{module}.py"))
    sys.path.insert(0, str(tmp_path / "code"))
    spark.dataSource.register(ContractPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda **more: spark.read.format("contract_pages").options(client=f"{module}:ask", query="bids_by_user", limit="3", cursor="id", numeric="true", **more).load()
    sys.path.remove(str(tmp_path / "code"))


def calls(tmp_path):
    return [json.loads(x) for x in (tmp_path / "calls").read_text().splitlines()]


def test_the_data_source_follows_pages_and_pushes_filters(spark, tmp_path, client):
    pages.land(client(contracts="liquidation_queue,down,odd"), str(tmp_path / "landed"))
    landed = pages.landed_pages(spark, str(tmp_path / "landed"))
    assert sorted(int(r.id) for r in pages.read_rows(landed, "liquidation_queue", "bids_by_user").collect()) == list(range(1, 12))
    assert {(r.contract, r.error, r.body) for r in landed.filter("contract <> 'liquidation_queue'").collect()} == {("down", "TimeoutError: no answer", None), ("odd", None, "[{")}
    os.remove(tmp_path / "calls")
    mine = client(contracts="liquidation_queue,down").filter("contract = 'liquidation_queue' and user = 'u1'").collect()
    assert {c[:2][1] for c in calls(tmp_path)} == {"u1"} and {c[0] for c in calls(tmp_path)} == {"liquidation_queue"}
    assert [x["id"] for r in mine for x in json.loads(r.body)] == ["1", "3", "5", "7", "9", "11"]


def test_ranges_of_cursors_meet_without_a_gap_or_a_copy(spark, tmp_path, client):
    split = client(contracts="liquidation_queue", bounds='["4", "9"]')
    assert split.rdd.getNumPartitions() == 3
    pages.land(split, str(tmp_path / "landed"))
    landed = pages.landed_pages(spark, str(tmp_path / "landed"))
    assert sorted(int(r.id) for r in pages.read_rows(landed, "liquidation_queue", "bids_by_user").collect()) == list(range(1, 12))
    assert pages.quarantine_counts(landed, [("liquidation_queue", "bids_by_user")]).collect() == []
