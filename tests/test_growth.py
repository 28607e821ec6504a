"""Steps whose work must not outgrow their input."""

import os
import random
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewater.functions.wide import wide_product, wide_quotient
from tidewater.operators import grid, ranges, scan
from tidewater.plans import bands, further, lending, measures, racing, series
from tidewater.plans import paged as paged_plans
from tidewater.sources import scratch, views

SF = "/root/testdata/sf0.001"


def _regions_plainly(cells):
    left, out = set(cells), {}
    while left:
        todo, region = [left.pop()], []
        while todo:
            x, y = todo.pop()
            region.append((x, y))
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        least = min(y * 1_000_000 + x for x, y in region)
        out |= dict.fromkeys(region, least)
    return out


@pytest.mark.parametrize(("width", "height"), [(9, 7), (64, 64), (150, 130)])
def test_regions_of_any_size_equal_a_plain_fill(spark, width, height):
    rng = random.Random(width)
    rows = [(k, x, y, "wall" if rng.random() < 0.4 else "road") for k in ("a", "b") for x in range(width) for y in range(height)]
    df = spark.createDataFrame(rows, "k string, x int, y int, tile string").repartition(3)
    got = grid.regions(df, ["k"], F.col("tile") != "wall").collect()
    for key in ("a", "b"):
        want = _regions_plainly([(x, y) for k, x, y, t in rows if k == key and t != "wall"])
        assert {(r.cell % 1_000_000, r.cell // 1_000_000): r.region for r in got if r.k == key} == want
    assert len(got) == sum(r[3] != "wall" for r in rows)


def test_regions_within_a_block_need_no_rounds(spark, monkeypatch):
    written, stash = [], grid.stash
    monkeypatch.setattr(grid, "stash", lambda df, label: written.append(label) or stash(df, label))
    snake = [(1, x, y) for y in range(0, 30, 2) for x in range(30)] + [(1, 29 if y % 4 == 1 else 0, y) for y in range(1, 29, 2)]
    df = spark.createDataFrame(snake, "k int, x int, y int")
    assert {r.region for r in grid.regions(df, ["k"], F.lit(True)).collect()} == {0}
    assert "regions" not in written
    assert grid.regions(df.limit(0), ["k"], F.lit(True)).collect() == []


def test_wide_products_and_quotients_take_no_step_for_each_digit(spark):
    a, b = "9" * 5000, "7" * 2400
    df = spark.createDataFrame([(a, b), (b, a), (a, "0"), (None, b)], "a string, b string").withColumn("i", F.monotonically_increasing_id())
    out = df.select("i", wide_product(F.col("a"), F.col("b")).alias("p"), wide_quotient(F.col("a"), F.col("b")).alias("q"))
    assert "aggregate(" not in out._jdf.queryExecution().executedPlan().toString()
    sys.set_int_max_str_digits(0)
    rows = [r[1:] for r in out.orderBy("i").collect()]
    assert rows == [(str(int(a) * int(b)), str(int(a) // int(b))), (str(int(a) * int(b)), "0"), ("0", None), (None, None)]


def test_tiles_are_not_broadcast(spark):
    plan = racing._grid(spark, SF).filter("tile <> 'wall'")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_a_position_is_held_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    assert views.tasks(spark, SF) == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100) > 50
    for df in (lending.risky_positions(spark, SF), measures.liquidation_prices(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"{views.tasks(spark, SF)}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_what_looks_ahead_runs_over_the_rows_the_other_way_round(spark):
    df = spark.range(200).withColumn("v", F.when(F.col("id") % 7 == 3, F.col("id"))).withColumn("k", F.col("id") % 2)
    for out in (scan.running(df, ["k"], ["id"], {"next": scan.upcoming("v")}), scan.scanned(df, ["k"], ["id"], {"next": scan.upcoming("v")}, 5)):
        want = {i: min((j for j in range(i, 200, 2) if j % 7 == 3), default=None) for i in range(200)}
        assert {r.id: r.next for r in out.collect()} == want
        assert out.columns == ["id", "v", "k", "next"]
    plan = scan.running(df, ["k"], ["id"], {"next": scan.upcoming("v")})._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan


def test_rates_and_places_by_shares_are_the_same(spark):
    for query in (series.revenue_rate, further.positional_rates):
        whole, shares = query(spark, SF), query(spark, SF, share_rows=150)
        assert sorted(map(str, whole.collect())) == sorted(map(str, shares.collect()))
    plan = series.revenue_rate(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" not in plan
    assert "array_position" not in further.positional_rates(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("share_rows", [10**6, 40])
def test_sums_of_ranges_equal_all_pairs(spark, share_rows):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice([None, float("nan"), 0.0, -0.0, 2.0, rng.uniform(-9, 9)]), Decimal(rng.randint(0, 9**9)) / 10000) for _ in range(300)]
    ends = [(rng.choice("xyz"), rng.choice([None, 0.0, 2.0, rng.uniform(-9, 9)]), rng.choice([None, 0.0, 2.0, rng.uniform(-9, 9)])) for _ in range(120)]
    r = spark.createDataFrame(rows, "k string, v double, d decimal(20,4)")
    s = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "of int, k string, low double, high double")
    out = ranges.range_sums(r, s, "v", "low", "high", {"d": "d"}, ["k"], share_rows)
    got = {x.of: (x.n, x.d) for x in out.collect()}
    for i, (k, a, b) in enumerate(ends):
        inside = [d for q, v, d in rows if q == k and v is not None and v == v and (a is None or v >= a) and (b is None or v < b)]
        assert got[i] == (len(inside), sum(inside) if inside else None), (i, k, a, b)


def test_bands_meet_no_positions_and_few_ranges_take_no_bins(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "_level" not in plan(bands.band_matches(spark, SF)) and "_level" not in plan(bands.threshold_matches(spark, SF))


def test_pages_are_made_once(spark):
    items = paged_plans.LANDED["liquidation_queue", "bids_by_user"](spark, SF)
    pages = paged_plans.paged(items, "liquidation_queue", "bids_by_user")
    assert "Window" not in pages.unionByName(pages)._jdf.queryExecution().optimizedPlan().toString()


def test_bids_move_once_and_their_answers_never(spark):
    """lines are moved once to be paged; what is read of the landed pages goes through no shuffle."""
    moved = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in f" {x.strip(' +-:')}"]
    numbered = scan.running(paged_plans.LANDED["liquidation_queue", "bids_by_user"](spark, SF), ["user"], ["key"], {"i": scan.count()})
    assert len(moved(numbered)) == 1 and moved(paged_plans.pages_bids(spark, SF)) == []


def test_landed_bids_take_little_room(spark, tmp_path, monkeypatch):
    """everything that is written for a row, about 110 bytes before."""
    monkeypatch.setattr(paged_plans, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    rows = paged_plans.pages_bids(spark, SF).count()
    written = sum(os.path.getsize(os.path.join(folder, f)) for folder, _, files in os.walk(tmp_path) for f in files)
    assert rows > 5000 and written < 45 * rows, written / rows


def test_bids_in_shares_are_the_same_pages(spark, monkeypatch):
    """A user with more bids than a task holds: grouped without being brought together, then scanned."""
    want = sorted(map(tuple, paged_plans.pages_bids(spark, SF).collect()), key=str)
    shares = scan.running.__defaults__, scan.together.__defaults__
    monkeypatch.setattr(scan.running, "__defaults__", (5, *shares[0][1:]))
    monkeypatch.setattr(scan.together, "__defaults__", (5, *shares[1][1:]))
    assert sorted(map(tuple, paged_plans.pages_bids(spark, SF).collect()), key=str) == want


def test_tasks_of_positions_sort_nothing(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    n = views.tasks(spark, SF)
    for query in (lending.risky_positions, further.loop_plan, measures.mint_and_repay, measures.unloop_plan, further.slider_changes, lending.annual_interest, lending.intents):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert len(joins) >= 3 and all("ShuffledHashJoin" in line for line in joins), query.__name__
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "market" not in line]
        assert dealt and all(f", {n}), " in line for line in dealt), query.__name__


def test_tasks_follow_the_largest_table(spark, tmp_path, monkeypatch):
    for name, n in (("lineitem", 3), ("orders", 900), ("part", 5)):
        spark.range(n).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    assert views.tasks(spark, str(tmp_path)) == 9


def _repeated(spark, folder, times):
    """The tables of positions so many times over, with shifted keys."""
    for name, keys in (("lineitem", ("l_orderkey", "l_partkey")), ("orders", ("o_orderkey",)), ("part", ("p_partkey",))):
        rows = spark.read.parquet(f"{SF}/{name}.parquet").crossJoin(spark.range(times))
        rows.withColumns({k: F.col(k) + F.col("id") * 10**6 for k in keys}).drop("id").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("query", [measures.mint_and_repay, lending.risky_positions, further.slider_changes])
def test_no_task_of_a_report_on_positions_grows_with_the_input(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(views, "TASK_ROWS", 1000, raising=False)
    rows, most = [], []
    for times in (1, 6):
        tasks = query(spark, _repeated(spark, tmp_path / str(times), times)).groupBy(F.spark_partition_id()).count().collect()
        rows.append(sum(r["count"] for r in tasks))
        most.append(max(r["count"] for r in tasks))
    assert rows[1] == 6 * rows[0] > 0 and most[1] < 2 * most[0], (rows, most)


def _with_a_hot_part(spark, folder, times, part):
    """The same, where nine lines of ten name one part."""
    _repeated(spark, folder, times)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    lines.withColumn("l_partkey", F.when(F.xxhash64(F.col("l_orderkey") % 10**6, "l_linenumber") % 10 != 0, F.lit(part).cast("long")).otherwise(F.col("l_partkey"))).write.parquet(f"{folder}/hot/lineitem.parquet")
    for name in ("orders", "part"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{folder}/hot/{name}.parquet")
    return f"{folder}/hot"


@pytest.mark.parametrize("part", [7, None])
def test_a_part_that_most_lines_name_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    rows, most = [], []
    for times in (1, 6):
        folder = _with_a_hot_part(spark, tmp_path / str(times), times, part)
        priced = views.priced(spark, folder, views.tasks(spark, folder))
        tasks = [r["count"] for r in priced.groupBy(F.spark_partition_id()).count().collect()]
        rows.append(sum(tasks))
        most.append(max(tasks))
    assert rows[1] >= 6 * rows[0] > 0 and most[1] < 2 * most[0] < rows[0], (rows, most)


@pytest.mark.parametrize("part", [7, None])
def test_reports_on_positions_are_the_same_with_a_part_dealt_to_several_tasks(spark, tmp_path, monkeypatch, part):
    folder = _with_a_hot_part(spark, tmp_path / "1", 1, part)
    reports = (views.valued, measures.mint_and_repay, lending.risky_positions, further.slider_changes, lending.vault_summary)
    found = []
    for most in (10**9, 500):
        monkeypatch.setattr(views, "TASK_ROWS", most)
        found.append([sorted(map(str, report(spark, folder).collect())) for report in reports])
    assert "_share" in views.priced(spark, folder, 12)._jdf.queryExecution().analyzed().toString()
    assert all(found[0]) and found[0] == found[1]
