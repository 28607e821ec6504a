"""Reports on tracks, traits and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import bits as B
from tidewater.functions.numeric import half_up
from tidewater.operators import grid as G
from tidewater.sources import views as V

SIDE = 12
#: Tiles of a kind, and sides, beyond which a track gets a warning.
MOST_STARTS, MOST_FINISHES, LEAST_SIDE, MOST_SIDE = 10, 5, 5, 50


def _grid(spark, sf_dir):
    """A track for each supplier, SIDE x SIDE: its lines fall on tiles by order and part, and how many lie on a tile
    makes it a wall, a boost or road. Tiles without lines are there, too. They come from a small file but are many, so
    both sides are dealt by track and merged, not broadcast."""
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    n = V.tasks(spark, sf_dir)
    every = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track")).repartition(n, "track").select("track", F.explode(side).alias("x")).withColumn("y", F.explode(side))
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("track"), (F.col("l_orderkey") % SIDE).cast("int").alias("x"), (F.col("l_partkey") % SIDE).cast("int").alias("y")).repartition(n, "track").groupBy("track", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return every.hint("merge").join(lines, ["track", "x", "y"], "left").select("track", "y", "x", F.when(n % 4 == 0, "wall").when(n % 5 == 3, "boost").otherwise("road").alias("tile"))


_GRID_SQL = f"""l AS (SELECT l_suppkey AS track, (l_orderkey % {SIDE})::INT AS x, (l_partkey % {SIDE})::INT AS y, count(*) AS n FROM lineitem GROUP BY ALL), c0 AS (SELECT s_suppkey AS track, x::INT AS x, y::INT AS y FROM supplier, range({SIDE}) a(x), range({SIDE}) b(y)),
g AS (SELECT track, x, y, CASE WHEN coalesce(n, 0) % 4 = 0 THEN 'wall' WHEN coalesce(n, 0) % 5 = 3 THEN 'boost' ELSE 'road' END AS tile FROM c0 LEFT JOIN l USING (track, x, y))"""


def grid_transforms(spark, sf_dir):
    """Tracks turned by a quarter, mirrored, with a filled rectangle."""
    n = F.lit(SIDE)
    return G.filled(G.mirrored(G.turned(_grid(spark, sf_dir), 1, n, n), n), 2, 2, 5, 5, "boost", only="road").select("track", "x", "y", "tile")


def track_iq(spark, sf_dir):
    """States (packed neighbourhoods) of each track: tiles by kind, distinct states, share of 625."""
    code = lambda c: F.when(F.col(c) == "wall", 0).when(F.col(c) == "boost", 2).otherwise(1)
    near = G.neighbours(_grid(spark, sf_dir), ["track"]).withColumn("state", B.pack_nibbles([code(c) for c in ("up", "right", "down", "left")]))
    count = lambda t: F.count(F.when(F.col("tile") == t, 1))
    return near.groupBy("track").agg(count("wall").alias("walls"), count("boost").alias("boosts"), F.countDistinct(F.when(F.col("tile") != "wall", F.col("state"))).alias("states")).withColumn("coverage", half_up(F.least(F.col("states") / 625 * 100, F.lit(100.0)), 4))


def flood_fill(spark, sf_dir):
    """Regions of tiles that aren't walls: how many, and the largest."""
    sizes = G.regions(_grid(spark, sf_dir), ["track"], F.col("tile") != "wall").groupBy("track", "region").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("track").agg(F.count(F.lit(1)).alias("n_regions"), F.max("n").alias("largest"), F.sum("n").alias("n_cells"))


#: The options of each trait with their weights, in the order of the draws.
WEIGHTS = {
    "base_color": [("White", 1600), ("Black", 1600), ("Silver", 1200), ("Gray", 1200), ("Red", 900), ("Blue", 900), ("Green", 600), ("Orange", 400), ("Yellow", 300), ("Purple", 300), ("Teal", 300), ("Gold", 100)],
    "accent_pattern": [("None", 3500), ("Stripes", 2200), ("Flames", 1200), ("Camo", 900), ("Geometric", 900), ("Gradient", 300)],
    "paint_finish": [("Solid", 5000), ("Metallic", 3000), ("Matte", 1500), ("Pearlescent", 500)],
    "headlight_color": [("White", 6000), ("Blue", 2500), ("NeonGreen", 900), ("Pink", 600)],
    "underglow": [("None", 6000), ("Blue", 1200), ("Purple", 900), ("Red", 900), ("Green", 700), ("White", 300)],
    "brake_light_style": [("ClassicRect", 4000), ("SlimStrip", 3200), ("Circular", 1800), ("SplitPanel", 1000)],
    "front_bumper": [("Standard", 5000), ("SportAggressive", 2500), ("Retro", 1500), ("OffroadReinforced", 1000)],
    "spoiler": [("None", 4200), ("SmallLip", 3200), ("Ducktail", 1800), ("LargeGtWing", 800)],
    "roof": [("Hardtop", 5200), ("Sunroof", 2200), ("Targa", 900), ("Convertible", 700)],
    "fender": [("Stock", 5200), ("Widebody", 2200), ("RetroFlare", 1600), ("AeroCutout", 1000)],
    "exhaust_length": [("Mid", 5000), ("Short", 3000), ("Long", 2000)],
    "exhaust_tip": [("Round", 4500), ("Square", 2000), ("Angled", 2000), ("DualPipe", 1500)],
    "engine_visuals": [("Covered", 5200), ("PaintedValveCover", 2000), ("ChromePipes", 1600), ("VisibleIntercooler", 1200)],
    "rim_style": [("Classic5Spoke", 4000), ("Mesh", 3000), ("DeepDish", 1800), ("FuturisticSolid", 1200)],
    "rim_color": [("Black", 3800), ("Chrome", 3400), ("Gold", 1400), ("Custom", 1400)],
    "tire": [("SemiSlicks", 4200), ("Slicks", 3200), ("OffroadTread", 1800), ("Whitewall", 800)],
    "number_font": [("BoldBlock", 4200), ("Digital", 2400), ("RetroStencil", 2000), ("ScriptItalic", 1400)],
    "roof_accessory": [("None", 6000), ("Antenna", 1600), ("LightBar", 1200), ("RoofRack", 1200)],
    "side_mirror": [("Standard", 5200), ("AeroSmall", 2200), ("RetroRound", 1600), ("WideRacing", 1000)],
    "window_tint": [("None", 3000), ("Light", 2800), ("Medium", 2600), ("Dark", 1400), ("Colored", 200)],
    "trail_effect": [("None", 6000), ("Smoke", 1800), ("Sparks", 1400), ("NeonStreak", 800)],
    "decal": [("FlamesA", 1500), ("FlamesB", 1200), ("CamoDesert", 1100), ("CamoUrban", 1100), ("GeometricLines", 900), ("SponsorPackA", 800), ("SponsorPackB", 800), ("Custom", 600)],
}


def trait_gen(spark, sf_dir):
    """Traits of each user from a chain of draws seeded by the user's number."""
    seed = (F.col("c_custkey") + 1).cast("long")
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(len(WEIGHTS))), F.array(seed), lambda states, _: F.concat(states, F.array(B.xorshift32(F.element_at(states, -1)))))
    out = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), chain.alias("states"))
    return out.select("user", *(B.weighted_pick(F.element_at("states", i + 2), options).alias(name) for i, (name, options) in enumerate(WEIGHTS.items())))


def top_times(spark, sf_dir):
    """The best order of each user with what is known about it, zeros where nothing is."""
    o = V.table(spark, sf_dir, "orders")
    best = o.groupBy(F.col("o_custkey").alias("user")).agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("race"), F.min("o_totalprice").alias("time"))
    stats = V.table(spark, sf_dir, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("race")).agg(F.count(F.lit(1)).alias("laps"))
    return best.join(stats, "race", "left").select("user", "race", "time", F.coalesce("laps", F.lit(0)).alias("laps"))


def route_walk(spark, sf_dir, most: int = 12):
    """Walks over a fixed swap graph (each nation trades into one other) until they close, at most `most` hops."""
    edges = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("b"))
    return spark.sql("""WITH RECURSIVE walk (start, place, hops) AS (
      SELECT a, b, 1L FROM {edges} UNION ALL SELECT start, b, hops + 1 FROM walk JOIN {edges} ON a = place WHERE place <> start AND hops < {most})
      SELECT start, max(hops) AS hops, max_by(place, hops) = start AS closed FROM walk GROUP BY start""", edges=edges, most=most)


def _marked(spark, sf_dir):
    """The tracks with start and finish tiles: some without either, some with many."""
    n, x, y = F.col("track"), F.col("x"), F.col("y")
    kind = F.when((n % 4 != 1) & (x == 0) & (y < n % 13), "start").when((n % 5 != 2) & (x == SIDE - 1) & (y < n % 8), "finish").otherwise(F.col("tile"))
    return _grid(spark, sf_dir).withColumn("tile", kind)


def track_checks(spark, sf_dir):
    """What is wrong with each track, as lists of errors and warnings, and whether it can be used."""
    cells = _marked(spark, sf_dir)
    count = lambda t: F.count(F.when(F.col("tile") == t, 1))
    t = cells.groupBy("track").agg(count("start").alias("starts"), count("finish").alias("finishes"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    walled = G.regions(cells, ["track"], F.col("tile") != "wall").groupBy("track").agg((F.countDistinct("region") - 1).alias("walled_in"))
    said = lambda test, text: F.when(test, F.lit(text))
    errors = F.array_compact(F.array(said(F.col("starts") == 0, "no start"), said(F.col("finishes") == 0, "no finish")))
    warnings = F.array_compact(F.array(said(F.col("starts") > MOST_STARTS, "many starts"), said(F.col("finishes") > MOST_FINISHES, "many finishes"), said(F.col("walled_in") > 0, "walled-in areas"), said((F.col("width") < LEAST_SIDE) | (F.col("height") < LEAST_SIDE), "very small"), said((F.col("width") > MOST_SIDE) | (F.col("height") > MOST_SIDE), "very large")))
    return t.join(walled, "track", "left").select("track", F.array_join(errors, "; ").alias("errors"), F.array_join(warnings, "; ").alias("warnings"), (F.size(errors) == 0).alias("valid"))


def completed_paths(spark, sf_dir):
    """Tracks with a plain way from the last start to the last finish tile, along the row first and then the column;
    tracks without either stay as they are."""
    cells = _marked(spark, sf_dir)
    last = lambda t: F.max(F.when(F.col("tile") == t, F.struct("y", "x")))
    ends = cells.groupBy("track").agg(last("start").alias("a"), last("finish").alias("b"))
    x, y = F.col("x"), F.col("y")
    along = (y == F.col("a.y")) & x.between(F.least("a.x", "b.x"), F.greatest("a.x", "b.x"))
    down = (x == F.col("b.x")) & y.between(F.least("a.y", "b.y"), F.greatest("a.y", "b.y"))
    road = F.coalesce((along | down) & ~F.col("tile").isin("start", "finish"), F.lit(False))
    return cells.join(ends, "track").select("track", "x", "y", F.when(road, "road").otherwise(F.col("tile")).alias("tile"))


def connectivity(spark, sf_dir):
    """Whether each track's start tiles can reach a finish tile."""
    cells = _marked(spark, sf_dir)
    where = cells.filter("tile in ('start', 'finish')").select("track", (F.col("y") * 1_000_000 + F.col("x")).cast("long").alias("cell"), "tile")
    ends = G.regions(cells, ["track"], F.col("tile") != "wall").join(where.hint("merge"), ["track", "cell"])
    both = ends.groupBy("track", "region").agg((F.countDistinct("tile") == 2).alias("joined")).groupBy("track").agg(F.max("joined").alias("connected"))
    return cells.select("track").distinct().join(both, "track", "left").select("track", F.coalesce("connected", F.lit(False)).alias("connected"))


QUERIES = {f.__name__: f for f in (grid_transforms, track_iq, flood_fill, trait_gen, top_times, route_walk, track_checks, completed_paths, connectivity)}

_STEP = lambda s, a, b: f"{b} AS (SELECT *, xor(y_{b}, (y_{b} << 5)) & 4294967295 AS {s} FROM (SELECT *, xor(x_{b}, x_{b} >> 17) AS y_{b} FROM (SELECT *, xor({a}, ({a} << 13) & 4294967295) AS x_{b} FROM %s)))"


def _pick_sql(state: str, options: list[tuple[str, int]]) -> str:
    bound, out = 0, "CASE"
    for name, weight in options:
        bound += weight
        out += f" WHEN {state} % {sum(w for _, w in options)} < {bound} THEN '{name}'"
    return out + " END"


_MARKED_SQL = f"m AS (SELECT track, x, y, CASE WHEN track % 4 <> 1 AND x = 0 AND y < track % 13 THEN 'start' WHEN track % 5 <> 2 AND x = {SIDE - 1} AND y < track % 8 THEN 'finish' ELSE tile END AS tile FROM g)"
_REACH_SQL = """p AS (SELECT track, x, y, tile, y * 1000000 + x AS cell FROM m WHERE tile <> 'wall'), e AS (SELECT a.track, a.cell AS a, b.cell AS b FROM p a JOIN p b ON a.track = b.track AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach(track, a, b) AS (SELECT track, cell, cell FROM p UNION SELECT r.track, r.a, e.b FROM reach r JOIN e ON e.track = r.track AND e.a = r.b)"""
SQL = {
    "grid_transforms": f"WITH {_GRID_SQL}, m AS (SELECT track, {SIDE - 1} - ({SIDE - 1} - y) AS x, x AS y, tile FROM g) SELECT track, x, y, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AND tile = 'road' THEN 'boost' ELSE tile END AS tile FROM m",
    "track_iq": f"""WITH {_GRID_SQL}, c AS (SELECT *, CASE tile WHEN 'wall' THEN 0 WHEN 'boost' THEN 2 ELSE 1 END AS code FROM g),
n AS (SELECT a.track, a.tile, coalesce(u.code, 0) AS u, coalesce(r.code, 0) AS r, coalesce(d.code, 0) AS d, coalesce(l.code, 0) AS l FROM c a LEFT JOIN c u ON u.track = a.track AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN c r ON r.track = a.track AND r.x = a.x + 1 AND r.y = a.y
  LEFT JOIN c d ON d.track = a.track AND d.x = a.x AND d.y = a.y + 1 LEFT JOIN c l ON l.track = a.track AND l.x = a.x - 1 AND l.y = a.y)
SELECT track, count(*) FILTER (tile = 'wall') AS walls, count(*) FILTER (tile = 'boost') AS boosts, count(DISTINCT (u, r, d, l)) FILTER (tile <> 'wall') AS states, floor(least(count(DISTINCT (u, r, d, l)) FILTER (tile <> 'wall') / 625 * 100, 100.0) * 1e4 + 0.5) / 1e4 AS coverage FROM n GROUP BY 1""",
    "flood_fill": f"""WITH RECURSIVE {_GRID_SQL}, p AS (SELECT track, x, y, y * 1000000 + x AS cell FROM g WHERE tile <> 'wall'), e AS (SELECT a.track, a.cell AS a, b.cell AS b FROM p a JOIN p b ON a.track = b.track AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach(track, a, b) AS (SELECT track, cell, cell FROM p UNION SELECT r.track, r.a, e.b FROM reach r JOIN e ON e.track = r.track AND e.a = r.b),
s AS (SELECT track, region, count(*) AS n FROM (SELECT track, a, min(b) AS region FROM reach GROUP BY 1, 2) GROUP BY 1, 2) SELECT track, count(*) AS n_regions, max(n) AS largest, sum(n)::BIGINT AS n_cells FROM s GROUP BY 1""",
    "trait_gen": "WITH s0 AS (SELECT c_custkey AS \"user\", c_custkey + 1 AS z0 FROM customer), " + ", ".join(_STEP(f"z{i + 1}", f"z{i}", f"s{i + 1}") % f"s{i}" for i in range(len(WEIGHTS))) + ' SELECT "user", ' + ", ".join(f"{_pick_sql(f'z{i + 1}', o)} AS {n}" for i, (n, o) in enumerate(WEIGHTS.items())) + f" FROM s{len(WEIGHTS)}",
    "top_times": "WITH b AS (SELECT o_custkey AS \"user\", arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS race, min(o_totalprice) AS time FROM orders GROUP BY 1), s AS (SELECT l_orderkey AS race, count(*) AS laps FROM lineitem WHERE l_quantity > 25 GROUP BY 1) SELECT \"user\", race, time, coalesce(laps, 0) AS laps FROM b LEFT JOIN s USING (race)",
    "track_checks": f"""WITH RECURSIVE {_GRID_SQL}, {_MARKED_SQL}, {_REACH_SQL},
w AS (SELECT track, count(DISTINCT region) - 1 AS walled FROM (SELECT track, a, min(b) AS region FROM reach GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT track, count(*) FILTER (tile = 'start') AS s, count(*) FILTER (tile = 'finish') AS f FROM m GROUP BY 1)
SELECT track, concat_ws('; ', CASE WHEN s = 0 THEN 'no start' END, CASE WHEN f = 0 THEN 'no finish' END) AS errors, concat_ws('; ', CASE WHEN s > 10 THEN 'many starts' END, CASE WHEN f > 5 THEN 'many finishes' END, CASE WHEN walled > 0 THEN 'walled-in areas' END) AS warnings, s > 0 AND f > 0 AS valid FROM t LEFT JOIN w USING (track)""",
    "completed_paths": f"""WITH {_GRID_SQL}, {_MARKED_SQL}, e AS (SELECT track, max((y, x)) FILTER (tile = 'start') AS a, max((y, x)) FILTER (tile = 'finish') AS b FROM m GROUP BY 1),
p AS (SELECT m.*, a[1] AS ay, a[2] AS ax, b[1] AS by_, b[2] AS bx FROM m JOIN e USING (track))
SELECT track, x, y, CASE WHEN tile NOT IN ('start', 'finish') AND (y = ay AND x BETWEEN least(ax, bx) AND greatest(ax, bx) OR x = bx AND y BETWEEN least(ay, by_) AND greatest(ay, by_)) AND ax IS NOT NULL AND bx IS NOT NULL THEN 'road' ELSE tile END AS tile FROM p""",
    "connectivity": f"""WITH RECURSIVE {_GRID_SQL}, {_MARKED_SQL}, {_REACH_SQL}
SELECT t.track, EXISTS (SELECT 1 FROM reach r JOIN p a ON a.track = r.track AND a.cell = r.a JOIN p b ON b.track = r.track AND b.cell = r.b WHERE r.track = t.track AND a.tile = 'start' AND b.tile = 'finish') AS connected FROM (SELECT DISTINCT track FROM m) t""",
    "route_walk": "WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, ((n_nationkey * 3 + 1) % 25)::BIGINT AS b FROM nation), walk(start, place, hops) AS (SELECT a, b, 1::BIGINT FROM e UNION ALL SELECT start, b, hops + 1 FROM walk JOIN e ON a = place WHERE place <> start AND hops < 12) SELECT start, max(hops) AS hops, arg_max(place, hops) = start AS closed FROM walk GROUP BY 1",
}
