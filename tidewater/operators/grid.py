"""Two-dimensional grids as rows of cells: turning, filling, neighbours, connected regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources.scratch import stash


def cells(df: DataFrame, key: list[str], grid: str) -> DataFrame:
    """An array of rows of values as y, x, tile."""
    rows = df.select(*key, F.posexplode(grid).alias("y", "_row"))
    return rows.select(*key, "y", F.posexplode("_row").alias("x", "tile"))


def turned(df: DataFrame, quarter_turns: int, width: Column, height: Column) -> DataFrame:
    """Cells turned clockwise; after an odd number of turns width and height change places."""
    x, y = F.col("x"), F.col("y")
    to = [(x, y), (height - 1 - y, x), (width - 1 - x, height - 1 - y), (y, width - 1 - x)][quarter_turns % 4]
    return df.withColumns({"x": to[0], "y": to[1]})


def mirrored(df: DataFrame, width: Column) -> DataFrame:
    return df.withColumn("x", width - 1 - F.col("x"))


def filled(df: DataFrame, x0: int, y0: int, x1: int, y1: int, tile: str, only: str | None = None) -> DataFrame:
    """A rectangle, ends included, replaced; `only` where that tile stood."""
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    return df.withColumn("tile", F.when(inside if only is None else inside & (F.col("tile") == only), tile).otherwise(F.col("tile")))


def neighbours(df: DataFrame, key: list[str], outside: str = "wall") -> DataFrame:
    """Each cell with the tiles above, right, below and left of it. One join with the cells' own shifted copies
    (four rows per cell, not pairs)."""
    steps = F.array(*(F.struct(F.lit(n).alias("side"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in (("up", 0, 1), ("right", -1, 0), ("down", 0, -1), ("left", 1, 0))))
    sent = df.select(*key, F.col("tile").alias("_t"), "x", "y", F.explode(steps).alias("s")).select(*key, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("s.side").alias("_side"), "_t")
    around = sent.groupBy(*key, "x", "y").agg(*(F.max(F.when(F.col("_side") == n, F.col("_t"))).alias(n) for n in ("up", "right", "down", "left")))
    return df.join(around, [*key, "x", "y"], "left").fillna(outside, ["up", "right", "down", "left"])


#: Sides of the blocks whose cells one row of an array column holds.
BLOCK = 64


@F.pandas_udf(T.ArrayType(T.LongType()))
def _block_regions(cells: pd.Series) -> pd.Series:
    """For each array of a block's cells, (y << 32 | x) in ascending order, the least cell of each cell's region within
    the block. All blocks of a batch at once: roots of neighbours hook to the lesser root, then labels are compressed."""
    sizes = cells.map(len).to_numpy()
    cell = np.concatenate([*cells, np.empty(0, np.int64)]).astype(np.int64)
    y, x = (cell >> 32) % BLOCK, (cell & 0xFFFFFFFF) % BLOCK
    at = (np.repeat(np.arange(len(sizes)), sizes) * BLOCK + y) * BLOCK + x
    ends = []
    for step, inside in ((1, x < BLOCK - 1), (BLOCK, y < BLOCK - 1)):
        a = np.flatnonzero(inside)
        b = np.searchsorted(at, at[a] + step)
        there = (b < len(at)) & (at[np.minimum(b, len(at) - 1)] == at[a] + step)
        ends.append((a[there], b[there]))
    a, b = (np.concatenate(e) for e in zip(*ends))
    label = np.arange(len(at))
    while (label[a] != label[b]).any():
        p, q = label[a], label[b]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    return pd.Series(np.split(cell[label], np.cumsum(sizes)[:-1]))


def regions(df: DataFrame, key: list[str], passable: Column, max_rounds: int = 64) -> DataFrame:
    """Passable cells with the number of their 4-connected region: the least cell number in it.

    A grid is cut into blocks of BLOCK x BLOCK cells, a row each, whose regions come from one pass. Only regions that
    touch across the blocks' borders are linked further: labels spread along these links and then jump along labels,
    each round written to the shared folder. Grids within one block need no round. x and y must be 0 or more, x below
    1,000,000.
    """
    number = lambda c: F.shiftright(c, 32) * 1_000_000 + c.bitwiseAND(0xFFFFFFFF)
    block = [F.floor(F.col(c) / BLOCK).alias(f"_b{c}") for c in ("y", "x")]
    packed = F.shiftleft(F.col("y").cast("long"), 32).bitwiseOR(F.col("x").cast("long"))
    blocks = df.filter(passable).groupBy(*key, *block).agg(F.sort_array(F.collect_set(packed)).alias("_cells"))
    found = blocks.withColumn("_regions", _block_regions("_cells")).select(*key, F.inline(F.arrays_zip(F.col("_cells").alias("c"), F.col("_regions").alias("r"))))
    found = stash(found.select(*key, number(F.col("c")).alias("cell"), number(F.col("r")).alias("region")), "cells")
    x, y = F.col("cell") % 1_000_000, F.floor(F.col("cell") / 1_000_000)
    across = F.array_compact(F.array(F.when(x % BLOCK == BLOCK - 1, F.col("cell") + 1), F.when(y % BLOCK == BLOCK - 1, F.col("cell") + 1_000_000)))
    edge = (x % BLOCK == 0) | (y % BLOCK == 0)
    sent = found.select(*key, F.col("region").alias("a"), F.explode(across).alias("cell"))
    met = sent.join(found.filter(edge).select(*key, "cell", F.col("region").alias("b")).hint("merge"), [*key, "cell"])
    links = stash(met.select(*key, F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select(*key, "l.*").distinct(), "links")
    if links.isEmpty():
        return found
    label = links.select(*key, "a").distinct().select(*key, "a", F.col("a").alias("region"))
    for _ in range(max_rounds):
        least = links.join(label.select(*key, F.col("a").alias("b"), F.col("region").alias("_r")).hint("merge"), [*key, "b"]).groupBy(*key, "a").agg(F.min("_r").alias("_r"))
        near = label.join(least.hint("merge"), [*key, "a"]).select(*key, "a", F.least("region", "_r").alias("via"), F.col("region").alias("old"))
        jump = label.select(*key, F.col("a").alias("via"), F.col("region").alias("far"))
        step = stash(near.join(jump.hint("merge"), [*key, "via"]).select(*key, "a", "old", F.least("via", "far").alias("region")), "regions")
        label = step.drop("old")
        if step.filter("old <> region").isEmpty():
            whole = label.select(*key, F.col("a").alias("region"), F.col("region").alias("_r"))
            return found.join(whole.hint("merge"), [*key, "region"], "left").select(*key, "cell", F.coalesce("_r", "region").alias("region"))
    raise RuntimeError(f"regions still changed after {max_rounds} rounds")
