"""Time buckets, dense ticks, arrays as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def buckets_zero_fill(events: DataFrame, ts: Column, start, end, count: int, aggregates: dict[str, Column]) -> DataFrame:
    """`count` equal buckets of [start, end), oldest first, those without events with zeros."""
    spark: SparkSession = events.sparkSession
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    low, high = micros(F.lit(start).cast("timestamp_ntz")), micros(F.lit(end).cast("timestamp_ntz"))
    bucket = F.floor((micros(ts) - low) * count / (high - low)).cast("int")
    sums = events.filter((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))).groupBy(bucket.alias("bucket")).agg(*(a.alias(n) for n, a in aggregates.items()))
    every = spark.range(count).select(F.col("id").cast("int").alias("bucket"))
    return every.join(sums, "bucket", "left").select("bucket", *(F.coalesce(F.col(n), F.lit(0).cast(sums.schema[n].dataType)).alias(n) for n in aggregates))


def parallel_arrays(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Index-aligned arrays as rows; where one is shorter, 0."""
    rest = [c for c in df.columns if c not in arrays]
    zipped = df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("i", "_z"))
    return zipped.select(*rest, "i", *(F.coalesce(F.col(f"_z.{a}"), F.lit(0)).alias(a) for a in arrays))


def dense_ticks(df: DataFrame, by: list[str], tick: str) -> DataFrame:
    """All ticks from each series' first to its last, values joined where there are any."""
    spans = df.groupBy(*by).agg(F.min(tick).alias("_a"), F.max(tick).alias("_b"))
    ticks = spans.select(*by, F.explode(F.sequence("_a", "_b")).alias(tick))
    return ticks.join(df, [*by, tick], "left")
