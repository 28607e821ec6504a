"""Joins that reports need beyond equality: first-match lookups, as-of, interpolation, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators import scan


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by the given order."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def lookup_join(left: DataFrame, dimension: DataFrame, keys: list[str], defaults: dict[str, object], order: list[Column] | None = None) -> DataFrame:
    """Left join that never multiplies rows: the dimension counts with its first row per key, misses with defaults.
    Whether the dimension is broadcast is left to Spark, which knows its size when the join starts."""
    if order is not None:
        dimension = first_per_key(dimension, keys, order)
    out = left.join(dimension, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def asof_join(probes: DataFrame, facts: DataFrame, by: list[str], ts: str, values: list[str], fallback_first: bool = True, share_rows: int = scan.SHARE_ROWS) -> DataFrame:
    """Each probe with the values of the latest fact at or before it, within its series.

    Both sides are put on one time line, sorted by series (facts before probes at equal times), and the last fact is
    carried forward: no pairs of rows, and by a scan over shares where a series has over `share_rows` rows. Probes
    before the first fact get the earliest fact, the next one for them (fallback_first), or nulls.
    """
    packed = F.struct(*(F.col(v) for v in values))
    line = facts.select(*by, ts, F.lit(0).alias("_probe"), packed.alias("_fact")).unionByName(probes.withColumn("_probe", F.lit(1)), allowMissingColumns=True)
    wanted = {"_found": scan.latest("_fact")} | ({"_next": scan.upcoming("_fact")} if fallback_first else {})
    at = scan.running(line, by, [ts, "_probe"], wanted, share_rows).filter("_probe = 1")
    found = F.coalesce(*(F.col(c) for c in wanted))
    return at.withColumn("_found", found).select(*probes.columns, *(F.col(f"_found.{v}").alias(v) for v in values))


def interpolating_join(probes: DataFrame, points: DataFrame, by: list[str], ts: str, value: str, share_rows: int = scan.SHARE_ROWS) -> DataFrame:
    """Each probe with the value on the straight line between its neighbours, held at both ends. Points must have one
    row per series and time. Times are compared as numbers of microseconds. The neighbours come from one pass over a
    common time line, as in asof_join; a point at the probe's own time is the one before it."""
    line = points.select(*by, ts, F.lit(0).alias("_probe"), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("_point")).unionByName(probes.withColumn("_probe", F.lit(1)), allowMissingColumns=True)
    at = scan.running(line, by, [ts, "_probe"], {"_a": scan.latest("_point"), "_b": scan.upcoming("_point")}, share_rows).filter("_probe = 1")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = (micros(ts) - micros("_a.t")) / (micros("_b.t") - micros("_a.t"))
    inside = F.col("_a.v") + part * (F.col("_b.v") - F.col("_a.v"))
    lerp = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull() | (F.col("_a.t") == F.col(ts)), F.col("_a.v")).otherwise(inside)
    return at.select(*probes.columns, lerp.alias(value))


def layer_join(rows: DataFrame, value: Column, width: float, start: float, layers: int) -> DataFrame:
    """Rows with the number of the equal layer [start + i * width, ...) they fall in, null outside: a computed key
    takes the place of a range join."""
    i = F.floor((value - start) / width + 1e-9)
    return rows.withColumn("layer", F.when(i.between(0, layers - 1), i.cast("int")))


def positional(frame: DataFrame, keys: Column, values: Column, names: tuple[str, str]) -> DataFrame:
    """Two arrays related by index as rows."""
    return frame.select("*", F.inline(F.arrays_zip(keys.alias(names[0]), values.alias(names[1]))))


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether both sides have the same distinct rows."""
    odd = left.distinct().exceptAll(right.distinct()).unionAll(right.distinct().exceptAll(left.distinct()))
    return odd.agg((F.count(F.lit(1)) == 0).alias("same"))
