"""Running and ranking operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators import scan
from tidewater.sources.scratch import stash

#: Shares of a series that are numbered side by side.
SHARES = 256


def ranked(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """rank by score (descending, nulls last), ties by `tie` (ascending), over all rows.

    A single global window would put all rows in one task. Rows are dealt once by ranges of (score, tie), sorted
    within each range and written with their number there; the ranges' sizes, a row for each, then give the ranks.
    """
    order = [F.desc_nulls_last(score), F.asc(tie)]
    at = F.monotonically_increasing_id()
    placed = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranked")
    share = F.shiftright("_at", 33).alias("_share")
    sizes = placed.groupBy(share).agg(F.count(F.lit(1)).alias("_n"))
    above = sizes.select("_share", F.coalesce(F.sum("_n").over(W.orderBy("_share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    return placed.withColumn("_share", share).join(F.broadcast(above), "_share").withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1) + 1 + F.col("_above")).drop("_share", "_at", "_above")


def numbered(df: DataFrame, by: list[str], order: str, shares: int = SHARES) -> DataFrame:
    """i: the row's number within its group, from 0, in ascending `order`; no group has to fit in a task.

    Rows are dealt by where `order` falls among approximate quantiles of all rows, numbered within group
    and share, and moved on by the size of the group's shares before: at most `shares` rows per group.
    """
    steps = [i / shares for i in range(1, shares)]
    bounds = df.agg(F.percentile_approx(order, steps, 10_000).alias("_bounds"))
    dealt = df.crossJoin(F.broadcast(bounds)).withColumn("_share", F.size(F.filter(F.coalesce(F.array_distinct("_bounds"), F.array()), lambda b: b < F.col(order)))).drop("_bounds")
    sizes = dealt.groupBy(*by, "_share").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", ahead_sum(by, [F.col("_share")], "_n")).drop("_n")
    within = F.row_number().over(W.partitionBy(*by, "_share").orderBy(order))
    return dealt.withColumn("_within", within).join(before, [*by, "_share"]).withColumn("i", (F.col("_within") - 1 + F.col("_before")).cast("int")).drop("_share", "_within", "_before")


def ahead_sum(by: list[str], order: list[Column], value: str) -> Column:
    """Of each row, the sum of the rows before it."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def running(by: list[str], order: list[Column]):
    return W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def running_ratio(df: DataFrame, hit: Column, by: list[str], order: list[Column | str], name: str, share_rows: int = scan.SHARE_ROWS) -> DataFrame:
    """Percent of hits so far. Hits and rows are counted as whole numbers, in shares where a group outgrows a task."""
    held = scan.running(df.withColumn("_hit", F.when(hit, 100).otherwise(0).cast("long")), by, order, {"_hits": scan.total("_hit"), "_rows": scan.count()}, share_rows)
    return held.withColumn(name, F.col("_hits").cast("double") / F.col("_rows")).drop("_hit", "_hits", "_rows")


def running_max(df: DataFrame, value: str, by: list[str], order: list[Column | str], name: str, share_rows: int = scan.SHARE_ROWS) -> DataFrame:
    """The highest value so far, at least 0."""
    return scan.running(df, by, order, {name: scan.highest(value)}, share_rows).withColumn(name, F.greatest(F.lit(0.0), name))


def filled_forward(df: DataFrame, value: str, by: list[str], order: list[Column | str], share_rows: int = scan.SHARE_ROWS) -> DataFrame:
    """value, or the last one before it that isn't null."""
    return scan.running(df, by, order, {"_filled": scan.latest(value)}, share_rows).withColumn(value, F.col("_filled")).drop("_filled")


def fifo_taken(amount: str, request: Column, before: Column) -> Column:
    """What a request takes from a row if rows with `before` in all go first."""
    return F.least(F.greatest(request - before, F.lit(0)), F.col(amount))


def changed(value: str, by: list[str], order: list[Column]) -> tuple[Column, Column]:
    """Whether a value differs from the row before, and by how much; the first row has neither."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    return F.coalesce(F.col(value) != before, F.lit(False)), F.col(value) - before


def session_starts(ts: str, idle_seconds: int, by: list[str]) -> Column:
    """1 where a row opens a session: the first of its key, or after a gap of more than idle_seconds."""
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(W.partitionBy(*by).orderBy(ts)).cast("timestamp"))
    return F.when(F.coalesce(gap > idle_seconds * 1_000_000, F.lit(True)), 1).otherwise(0)
