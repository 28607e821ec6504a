"""Hand-computed cases of the functions and operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.functions import bits, formats, lending, numeric
from tidewater.operators import joins, paging, scan, windows
from tidewater.operators.grid import cells, neighbours, regions, turned
from tidewater.operators.rules import Rule, best_for_page, evaluate
from tidewater.operators.series import buckets_zero_fill, parallel_arrays
from tidewater.operators.windows import numbered
from tidewater.plans import catalogue
from tidewater.plans.catalogue import QUERIES
from tidewater.plans.series import paired_series
from tidewater.sources.views import events

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_truncation_goes_toward_zero(spark):
    assert one(spark, numeric.trunc_dp(F.lit(-1.239), 2), numeric.trunc_dp(F.lit(1.239), 2), numeric.trunc_dp(F.lit(1e300), 2)) == (-1.23, 1.23, 1e300)


def test_wide_integers_and_division(spark):
    big = F.lit("340282366920938463463374607431768211455")
    assert one(spark, numeric.uint(big), numeric.overflows(big), numeric.overflows(F.lit("12")), numeric.safe_div(F.lit(1), F.lit(0))) == (None, True, False, 0.0)
    assert one(spark, numeric.shift_digits(F.lit("1"), -18), numeric.shift_digits(F.lit("oops"), 2), numeric.is_numeric(F.lit(" "))) == (0.0, 0.0, True)


def test_formats(spark):
    assert one(spark, formats.ordinal(F.lit(112)), formats.ordinal(F.lit(23)), formats.countdown(F.lit(3671)), formats.parse_display(F.lit("$5.4M"))) == ("112th", "23rd", "01:01:11", 5_400_000.0)
    assert one(spark, formats.interpolated(F.lit("{a} {b}"), {"a": F.lit(1)}), formats.first_match(F.lit("Out of GAS"), [("gas", "fee"), ("out", "x")])) == ("1 {b}", "fee")
    assert one(spark, formats.to_second_significant(F.lit(0.0012345)), formats.trimmed(F.lit(1.5))) == (0.0012, "1.5")


def test_lending_formulas(spark):
    assert one(spark, lending.ltv(F.lit(0.0), F.lit(0.0)), lending.ltv(F.lit(50.0), F.lit(0.0)), lending.ltv(F.lit(1.0), F.lit(3.0))) == (0.0, None, 33.33)
    assert one(spark, lending.auction_discount(F.lit(250.0), 100.0, 0.1), lending.level(F.lit(99)), lending.market_leverage(F.lit(1.0))) == (0.2, 11, None)


def test_generator_matches_the_published_steps(spark):
    x = 1
    for shift, mask in ((13, 1), (-17, 1), (5, 1)):
        x ^= (x << shift if shift > 0 else x >> -shift) & 0xFFFFFFFF
    assert one(spark, bits.xorshift32(F.lit(1)), bits.little_endian(F.array(F.lit(1), F.lit(2)).cast("array<long>"))) == (x & 0xFFFFFFFF, 513)
    assert one(spark, bits.weighted_pick(F.lit(7), [("a", 3), ("b", 4), ("c", 1)])) == ("c",)


def test_asof_join_never_looks_ahead(spark):
    facts = spark.createDataFrame([("s", 2, 20.0), ("s", 5, 50.0)], "k string, ts long, v double")
    probes = spark.createDataFrame([("s", 1), ("s", 2), ("s", 4), ("s", 9), ("t", 3)], "k string, ts long")
    got = {(r.k, r.ts): r.v for r in joins.asof_join(probes, facts, ["k"], "ts", ["v"]).collect()}
    assert got == {("s", 1): 20.0, ("s", 2): 20.0, ("s", 4): 20.0, ("s", 9): 50.0, ("t", 3): None}
    assert joins.asof_join(probes, facts, ["k"], "ts", ["v"], fallback_first=False).filter("ts = 1").first().v is None


def test_interpolation_holds_both_ends(spark):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    points = spark.createDataFrame([("s", t(0), 0.0), ("s", t(10), 10.0)], "k string, ts timestamp, v double")
    probes = spark.createDataFrame([("s", t(-5)), ("s", t(4)), ("s", t(10)), ("s", t(99))], "k string, ts timestamp")
    got = sorted(r.v for r in joins.interpolating_join(probes, points, ["k"], "ts", "v").collect())
    assert got == [0.0, 4.0, 10.0, 10.0]


def test_lookup_takes_the_first_row_only(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5.0, 2), (1, 7.0, 1)], "k int, price double, o int")
    got = {r.k: r.price for r in joins.lookup_join(left, right, ["k"], {"price": 0.0}, [F.col("o")]).collect()}
    assert got == {1: 7.0, 2: 0.0}


def test_ranking_equals_a_global_window(spark):
    rows = [(i, float(i * 7919 % 100) if i % 10 else None) for i in range(500)]
    got = windows.ranked(spark.createDataFrame(rows, "id long, score double"), "score", "id").orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.score) for r in got] == want and [r["rank"] for r in got] == list(range(1, 501))


def test_ranking_of_an_empty_table(spark):
    assert windows.ranked(spark.createDataFrame([], "id long, score double"), "score", "id").collect() == []


def test_fifo_takes_what_is_asked(spark):
    df = spark.createDataFrame([("u", 1, 10), ("u", 2, 10), ("u", 3, 10)], "u string, t int, a int")
    rows = scan.running(df, ["u"], ["t"], {"up_to": scan.total("a")})
    got = [r.x for r in rows.select("t", windows.fifo_taken("a", F.lit(15), scan.ahead("a", F.col("up_to"))).alias("x")).orderBy("t").collect()]
    assert got == [10, 5, 0]


def test_pages_and_search(spark):
    df = spark.createDataFrame([(i, "Ab" if i % 2 else None) for i in range(10)], "k int, s string")
    assert paging.narrowed(df, query="aB").count() == 5
    assert [r.k for r in paging.page(df, [F.col("k")], 2, 4).collect()] == [4, 5, 6, 7]
    assert [r.k for r in paging.after_key(df, "k", 7, 5).collect()] == [8, 9]
    assert tuple(paging.pages(df, 4).first()) == (10, 3)


def test_empty_buckets_are_zero(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 30),)], "ts timestamp_ntz")
    got = buckets_zero_fill(df, F.col("ts"), "2024-01-01 00:00:00", "2024-01-01 03:00:00", 3, {"n": F.count(F.lit(1))}).orderBy("bucket").collect()
    assert [r.n for r in got] == [1, 0, 0]


def test_shorter_arrays_are_filled(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0])], "k int, a array<double>, b array<double>")
    assert [(r.a, r.b) for r in parallel_arrays(df, ["a", "b"]).orderBy("i").collect()] == [(1.0, 3.0), (2.0, 0.0)]


def test_rules_prefer_the_page(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, x int")
    rules = [Rule("any", "info", 9, F.col("x") > 1), Rule("here", "info", 1, F.col("x") > 1, "p")]
    got = best_for_page(evaluate(df, rules), ["k"], F.lit("p")).collect()
    assert [(r.k, r.rule) for r in got] == [(1, "here")]


def test_grid(spark):
    df = cells(spark.createDataFrame([(1, [["a", "wall"], ["wall", "b"]])], "k int, g array<array<string>>"), ["k"], "g")
    assert {(r.x, r.y): r.tile for r in turned(df, 1, F.lit(2), F.lit(2)).collect()} == {(0, 0): "wall", (1, 0): "a", (0, 1): "b", (1, 1): "wall"}
    assert neighbours(df, ["k"]).filter("x = 0 and y = 0").select("right", "up").first()[:] == ("wall", "wall")
    assert regions(df, ["k"], F.col("tile") != "wall").select("region").distinct().count() == 2


def test_paired_series_number_every_event_without_arrays(spark):
    rows = [(i, i % 2, ("view", "click", "error")[i // 2 % 3], float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, market int, kind string, value double").repartition(5)
    want = {}
    for k, kind in enumerate(("view", "click")):
        for m in (0, 1):
            for i, v in enumerate(v for _, mm, kk, v in rows if (mm, kk) == (m, kind)):
                want.setdefault((m, i), [0.0, 0.0])[k] = v
    assert {(r.market, r.i): [r.views, r.clicks] for r in paired_series(df).collect()} == want
    assert numbered(df.limit(0), ["market"], "event_id").count() == 0


def test_whole_reports_read_every_row(spark):
    sf = "/root/testdata/sf0.001"
    kinds = {r["kind"]: r["total"] for r in events(spark, sf).groupBy("kind").agg(F.sum("value").cast("double").alias("total")).collect()}
    seen = QUERIES["timeline_whole"](spark, sf).agg(F.sum("views"), F.sum("clicks")).first()
    assert seen[:] == pytest.approx((kinds["view"], kinds["click"]))
    total = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]
    assert QUERIES["outer_merge_whole"](spark, sf).agg(F.sum("amount")).first()[0] == pytest.approx(float(total))


def test_ranks_over_ties_and_nulls(spark):
    rows = [(i, None if i == 3 else float(i % 4)) for i in range(40)]
    got = {r.k: r.rank for r in windows.ranked(spark.createDataFrame(rows, "k int, x double").repartition(7), "x", "k").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {k: i + 1 for i, (k, _) in enumerate(want)} and windows.ranked(spark.createDataFrame([], "k int, x double"), "x", "k").count() == 0


def test_responses_read_from_landed_files(spark, tmp_path):
    from tidewater.sources.responses import chart, read_responses, write_answer

    lines = ['{"user": "u", "stats": {"total_points": "340282366920938463463374607431768211455", "claimable_points": "1"}}', '{"user": "v"', '{"user": "w", "other": 1}']
    (tmp_path / "points.json").write_text("\n".join(lines))
    rows = {r.user: r for r in read_responses(spark, "points", str(tmp_path / "points.json")).collect()}
    assert rows["u"].stats.total_points == "340282366920938463463374607431768211455" and rows["w"].stats is None and rows[None].broken == lines[1]
    write_answer(spark.createDataFrame([(1, "x")], "apr int, asset string"), str(tmp_path / "answer"))
    assert spark.read.json(str(tmp_path / "answer")).first().asset == "x"
    assert chart(spark.createDataFrame([("a", 2, 1.0), ("a", 1, 5.0)], "k string, at int, v double"), "k", "at", ["v"]).first().points == '[{"at":1,"v":5.0},{"at":2,"v":1.0}]'


def test_sort_column_and_direction_are_chosen_at_run_time(spark):
    table = lambda **by: [r.row for r in QUERIES["sorted_table"](spark, "/root/testdata/sf0.001", **by).orderBy("place").collect()]
    assert table(by="multiplier", descending=False) != table(by="multiplier") and table(by=None) == sorted(table(by=None))


def hot_series():
    """Rows of nine series, one of which has a third of all, with ties in time and nulls in key and value."""
    rows, n = [], 600
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 17 == 0 else f"s{i % 8}"
        rows.append((key, (i * 7919 % n) // 2, i, None if i % 4 == 0 else i * 31 % 97))
    return rows


@pytest.mark.parametrize("shares", [1, 2, 7, 40])
def test_scan_over_shares_equals_windows(spark, shares):
    df = spark.createDataFrame(hot_series(), "k string, ts long, id long, v long")
    values = {"total": scan.total("v"), "n": scan.count(), "top": scan.highest("v"), "last": scan.latest("v"), "next": scan.upcoming("v")}
    for order in (["ts", "id"], [F.desc("v"), F.col("ts"), F.desc("id")]):
        want = scan.running(df, ["k"], order, values).collect()
        got = scan.scanned(df, ["k"], order, values, shares).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    got = {r.id: (r.total, r.n, r.top) for r in scan.scanned(df, ["k"], ["ts", "id"], values, shares).collect()}
    seen = {}
    for k, _, i, v in sorted(hot_series(), key=lambda r: (r[1], r[2])):
        seen.setdefault(k, []).append(v)
        known = [x for x in seen[k] if x is not None]
        assert got[i] == (sum(known) if known else None, len(seen[k]), max(known, default=None))


def test_scan_deals_a_hot_group_over_tasks(spark):
    df = spark.createDataFrame(hot_series(), "k string, ts long, id long, v long")
    dealt = df.repartitionByRange(12, "k", "ts", "id").groupBy(F.spark_partition_id().alias("share"), "k").count().collect()
    assert max(r["count"] for r in dealt) <= 2 * 600 / 12
    assert scan.running(df.limit(0), ["k"], ["ts"], {"n": scan.count()}, 1).collect() == []


@pytest.mark.parametrize("report", ["loss_absorption", "fifo_unstake", "running_winrate", "running_max", "ffill", "profit_chart_asof", "interp_performance", "curve_lookup"])
def test_reports_are_the_same_in_shares(spark, report):
    whole = catalogue.QUERIES[report](spark, SF)
    parts = catalogue.QUERIES[report](spark, SF, share_rows=97)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_joins_over_a_hot_series(spark):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    facts = spark.createDataFrame([("hot" if i % 3 else f"s{i}", t(i * 10), float(i)) for i in range(60)], "k string, ts timestamp, v double")
    probes = spark.createDataFrame([("hot" if i % 3 else f"s{i}", t(i * 7 - 5)) for i in range(90)], "k string, ts timestamp")
    for join in (lambda n: joins.asof_join(probes, facts, ["k"], "ts", ["v"], share_rows=n), lambda n: joins.interpolating_join(probes, facts, ["k"], "ts", "v", n)):
        assert sorted(map(str, join(10**6).collect())) == sorted(map(str, join(11).collect()))
