"""Wide numbers against Python's, conditions as text, routes."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions.wide import wide_add, wide_compare, wide_product, wide_quotient
from tidewater.operators import conditions
from tidewater.operators.routes import least_routes


def test_wide_numbers_equal_pythons(spark):
    r = random.Random(7)
    n = lambda: str(r.randrange(10 ** r.choice([1, 2, 6, 7, 12, 18, 39, 60, 60])))
    rows = [(n(), n()) for _ in range(150)] + [("0", "5"), ("7", "0"), ("-1", "3"), ("x", "2"), (None, "2"), ("", "1"), ("000123", "0"), ("9" * 60, "9" * 60), ("1" + "0" * 60, "9" * 59)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", wide_product(a, b).alias("p"), wide_quotient(a, b).alias("q"), wide_add(a, b).alias("s"), wide_compare(a, b).alias("c")).collect()
    for x in got:
        if x.a and x.a.isdigit():
            m, k = int(x.a), int(x.b)
            assert (x.p, x.s, x.c, x.q) == (str(m * k), str(m + k), (m > k) - (m < k), str(m // k) if k else None), x
        else:
            assert (x.p, x.q, x.s, x.c) == (None,) * 4, x


FACTS = [("m", 1, 5.0, 3, "view", None), ("m", 2, 9.0, 3, "click", 1), ("m", 3, 1.0, 0, None, 2), ("n", 1, 0.0, 7, "view", 3)]


def held(spark, text):
    facts = spark.createDataFrame(FACTS, "k string, day int, tvl double, errors long, busiest string, late int")
    wide, names = conditions.names_of(facts, {"most": 4.0}, ["k"], ["day"])
    return [(r.k, r.day) for r in wide.filter(conditions.condition(text, names)).orderBy("k", "day").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("tvl > 4", [("m", 1), ("m", 2)]),
        ("tvl > thresholds.most && errors >= 3", [("m", 1), ("m", 2)]),
        ("tvl_delta < 0", [("m", 3)]),
        ("errors_changed", [("m", 3)]),
        ("!(errors_changed) && k == 'm'", [("m", 1), ("m", 2)]),
        ("busiest === 'view' || errors === 0", [("m", 1), ("m", 3), ("n", 1)]),
        ("busiest == null", [("m", 3)]),
        ("busiest !== \"view\"", [("m", 2), ("m", 3)]),
        ("2 + 3 * 2 == 8 && tvl > 4", [("m", 1), ("m", 2)]),
        ("(2 + 3) * 2 == 10 && tvl / errors > 2", [("m", 2)]),
        ("tvl % 4 == 1 && -tvl < -4", [("m", 1), ("m", 2)]),
        ("errors / 0 > 1", []),
        ("late > 1", [("m", 3), ("n", 1)]),
        ("errors", [("m", 1), ("m", 2), ("n", 1)]),
        ("true && !false && busiest", [("m", 1), ("m", 2), ("n", 1)]),
        ("errors * 9223372036854775807 * 9223372036854775807 > 0 || tvl > 8", [("m", 1), ("m", 2), ("n", 1)]),
    ],
)
def test_conditions(spark, text, want):
    assert held(spark, text) == want


@pytest.mark.parametrize("text", ["", "tvl >", "tvl > 1 2", "unknown > 1", "tvl.constructor", "__class__", "eval('1')", "tvl; 1", "(tvl > 1", "tvl > 'a'", "busiest + 1 > 0", "busiest == 1", "`tvl`", "tvl = 1", "'open", "k\\", "1 < (" * 60, "a" * 3000, "constructor.constructor('return 1')()", "tvl > 1 -- x", "tvl[0]", "x => 1", "${tvl}", "thresholds.none > 1"])
def test_hostile_or_broken_conditions_are_refused(spark, text):
    with pytest.raises(conditions.BadCondition):
        held(spark, text)


def test_rules_of_a_table(spark):
    facts = spark.createDataFrame(FACTS, "k string, day int, tvl double, errors long, busiest string, late int")
    rows = [("a", "info", 1, "", "tvl > 4"), ("b", "info", 2, None, "os.system('x')"), ("c", "warning", 3, "p", None)]
    table = spark.createDataFrame(rows, "rule string, kind string, priority int, page string, condition string")
    _, names = conditions.names_of(facts, {}, ["k"], ["day"])
    rules, refused = conditions.rules_of(table, names)
    assert [r.name for r in rules] == ["a"] and [n for n, _ in refused] == ["b", "c"]
    assert sorted((r.k, r.day, r.rule) for r in conditions.evaluate_table(facts, table, {}, ["k"], ["day"]).collect()) == [("m", 1, "a"), ("m", 2, "a")]
    assert conditions.evaluate_table(facts, table.filter("rule = 'b'"), {}, ["k"], ["day"]).collect() == []
    many = spark.range(conditions.MAX_RULES + 1).selectExpr("cast(id AS string) AS rule", "'i' AS kind", "1 AS priority", "'' AS page", "'true' AS condition")
    with pytest.raises(ValueError, match="more than"):
        conditions.rules_of(many, names)


def test_routes_equal_all_walks(spark):
    r = random.Random(3)
    edges = [(r.randrange(12), r.randrange(12), r.randrange(0, 9)) for _ in range(40)] + [(5, 5, 0), (1, 2, None)]
    frame = spark.createDataFrame(edges, "a long, b long, cost long")
    best = {0: (0, 0, "0")}
    for _ in range(3):
        new = dict(best)
        for a, b, c in edges:
            if a != b and c is not None and b in best:
                new[a] = min(new.get(a, (1 << 60, 0, "")), (best[b][0] + c, best[b][1] + 1, f"{a}>{best[b][2]}"))
        best = new
    assert {x.place: (x.cost, x.hops, x.route) for x in least_routes(frame, 0, 3).collect()} == best
    assert [tuple(x) for x in least_routes(frame.limit(0), 0, 3).collect()] == [(0, 0, 0, "0")]
