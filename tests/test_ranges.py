"""Range joins against all pairs."""

import random

import pytest

from tidewater.operators.ranges import overlap_join, range_join
from tidewater.plans import catalogue

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


def holds(v, low, high, closed):
    if v is None or v != v:
        return False
    after = low is None or (v >= low if closed in ("left", "both") else v > low)
    return after and (high is None or (v <= high if closed in ("right", "both") else v < high))


def made(seed):
    rng = random.Random(seed)
    number = lambda: rng.choice([rng.uniform(-5, 5), rng.uniform(-1e9, 1e9), rng.uniform(0, 1e-7), float(rng.randint(-3, 3)), 7.0])
    rows = [(i, rng.choice("xy"), rng.choice([None, NAN, 7.0, 7.0, number(), number(), number()])) for i in range(150)]
    ends = [sorted((number(), number())) for _ in range(60)] + [[3.0, 3.0], [5.0, 4.0], [7.0, 7.0]]
    ranges = [(j, rng.choice("xy"), rng.choice([a, a, a, None]), rng.choice([b, b, b, None])) for j, (a, b) in enumerate(ends)]
    return rows, ranges


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
def test_range_join_equals_all_pairs(spark, closed):
    rows, ranges = made(closed)
    r, s = spark.createDataFrame(rows, "id int, k string, v double"), spark.createDataFrame(ranges, "of int, k string, low double, high double")
    got = range_join(r, s, "v", "low", "high", ["k"], closed)
    assert sorted((x.id, x.of) for x in got.collect()) == sorted((i, j) for i, k, v in rows for j, q, a, b in ranges if k == q and holds(v, a, b, closed))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    every = range_join(r, s.drop("k"), "v", "low", "high", closed=closed, how="left")
    pairs = [(i, j) for i, _, v in rows for j, _, a, b in ranges if holds(v, a, b, closed)]
    alone = {i for i, *_ in rows} - {i for i, _ in pairs}
    assert sorted(((x.id, x.of) for x in every.collect()), key=str) == sorted([*pairs, *((i, None) for i in alone)], key=str)


def test_empty_sides(spark):
    r, s = spark.createDataFrame([(1, 2.0)], "id int, v double"), spark.createDataFrame([(1, 0.0, 9.0)], "of int, low double, high double")
    assert range_join(r.limit(0), s, "v", "low", "high").collect() == range_join(r, s.limit(0), "v", "low", "high").collect() == []
    assert [tuple(x) for x in range_join(r, s.limit(0), "v", "low", "high", how="left").collect()] == [(1, 2.0, None, None, None)]


def test_overlaps_come_once(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), a := rng.choice([rng.randint(0, 30), rng.uniform(0, 30)]), a + rng.choice([0, 1, 0.3, 25])) for i in range(80)]
    a = spark.createDataFrame([(i, k, float(x), float(y)) for i, k, x, y in rows], "i int, k string, a double, b double")
    b = a.toDF("j", "k", "c", "d")
    got = sorted((x.i, x.j) for x in overlap_join(a, b, ("a", "b"), ("c", "d"), ["k"]).collect())
    assert got == sorted((i, j) for i, k, x, y in rows for j, q, u, v in rows if k == q and x < v and u < y and x < y and u < v)


def test_reports_have_no_nested_loop(spark):
    for name in ("threshold_matches", "band_matches", "band_overlaps"):
        assert "NestedLoop" not in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
