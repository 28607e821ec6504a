"""Running values over ordered groups of any size: a prefix scan over shares of the sorted rows.

A window puts all rows of its group in one task. Here rows are dealt by ranges of (group, order), so that a group that
outgrows a task's share goes on in the next ones; each share is scanned on its own, the last (or first) value of each
group's part is its fold, the folds are scanned over the shares, and what they carry is joined back. A range has at
most one group that began before it and one that goes on after it, so there are fewer folds with something to carry
than shares, and the join can always be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.sources.scratch import stash

#: Rows of a group that one task may window. Where no group has more, one plain window gives the same result.
SHARE_ROWS = 2_000_000
#: Rows of small groups that one task holds, about.
TASK_ROWS = 250_000


@dataclass(frozen=True)
class Running:
    """A running value. local: over a part of a group; forward: whether it looks back (and folds at the part's last row)
    or ahead; carry: the folds of several parts, in order, as one; joined: what is carried with what is local."""

    local: Callable[[Column], Column]
    carry: Callable[[Column], Column]
    joined: Callable[[Column, Column], Column]
    forward: bool = True


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def total(value: Column | str) -> Running:
    """The sum of all rows up to this one."""
    return Running(lambda w: F.sum(_column(value)).over(w), F.sum, lambda carried, local: F.coalesce(carried + local, local, carried))


def count() -> Running:
    """The number of the row in its group, from 1."""
    return total(F.lit(1).cast("long"))


def highest(value: Column | str) -> Running:
    return Running(lambda w: F.max(_column(value)).over(w), F.max, lambda carried, local: F.greatest(carried, local))


def latest(value: Column | str) -> Running:
    """The value of the last row up to this one where it isn't null."""
    return Running(lambda w: F.last(_column(value), ignorenulls=True).over(w), lambda x: F.last(x, ignorenulls=True), lambda carried, local: F.coalesce(local, carried))


def upcoming(value: Column | str) -> Running:
    """The value of the first row from this one on where it isn't null."""
    return Running(lambda w: F.last(_column(value), ignorenulls=True).over(w), lambda x: F.first(x, ignorenulls=True), lambda carried, local: F.coalesce(local, carried), forward=False)


def _local(df: DataFrame, by: list[str], order: list[Column | str], values: dict[str, Running]) -> DataFrame:
    """df with the running values of each group, and `_at`, the row's number in it. What looks ahead runs over the rows
    the other way round: Spark computes a frame that ends at the group's last row anew for each row."""
    w = W.partitionBy(*by)
    df = df.withColumn("_at", F.row_number().over(w.orderBy(*order)))
    up = W.unboundedPreceding, W.currentRow
    return df.withColumns({name: v.local(w.orderBy("_at" if v.forward else F.desc("_at")).rowsBetween(*up)) for name, v in values.items()})


def _sizes(df: DataFrame, by: list[str]):
    """The rows of the largest group, and all rows."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()


def together(df: DataFrame, by: list[str], share_rows: int = SHARE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """df with each group's rows in one task, so that finer groups and windows over it share one shuffle, in tasks of
    about `task_rows` rows; as it is where a group has over `share_rows` rows."""
    sizes = _sizes(df, by)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes["all"] or 0) // task_rows))
    return df.repartition(tasks, *by) if (sizes["most"] or 0) <= share_rows else df


def running(df: DataFrame, by: list[str], order: list[Column | str], values: dict[str, Running], share_rows: int = SHARE_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """df with a column for each running value, over the rows of each group `by` in `order` (which should leave no
    ties; nulls where Spark sorts them).

    Groups are counted first, with partial aggregation. If none has over `share_rows` rows, a window holds each. Else
    all rows are scanned in shares of about that many. Both give the same rows; sums of floating-point numbers may be
    added in another order, so sum exact numbers. Null keys are a group like others. An empty table gives none.
    Where df is the outcome of a shuffle, `counted` saves making it twice: rows that are counted in its place, with as
    many in each group or more.
    """
    sizes = _sizes(df if counted is None else counted, by)
    if (sizes["most"] or 0) <= share_rows:
        return _local(df, by, order, values).drop("_at")
    return scanned(df, by, order, values, -(-sizes["all"] // share_rows))


def scanned(df: DataFrame, by: list[str], order: list[Column | str], values: dict[str, Running], shares: int) -> DataFrame:
    """running, by a scan over so many shares."""
    dealt = df.repartitionByRange(shares, *by, *order).withColumn("_share", F.spark_partition_id())
    local = stash(_local(dealt, [*by, "_share"], order, {f"_local_{i}": v for i, v in enumerate(values.values())}), "scan")
    folds = local.groupBy(*by, "_share").agg(*((F.max_by if v.forward else F.min_by)(F.struct(F.col(f"_local_{i}").alias("x")), "_at").alias(f"_fold_{i}") for i, v in enumerate(values.values())))
    parts = W.partitionBy(*by).orderBy("_share")
    carried = {f"_carry_{i}": v.carry(F.col(f"_fold_{i}.x")).over(parts.rowsBetween(W.unboundedPreceding, -1) if v.forward else parts.rowsBetween(1, W.unboundedFollowing)) for i, v in enumerate(values.values())}
    several = folds.withColumns(carried | {"_parts": F.count(F.lit(1)).over(W.partitionBy(*by))}).filter("_parts > 1")
    small = several.select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), F.col("_share").alias("_of"), *carried)
    same = F.col("_share") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    out = local.join(F.broadcast(small), same, "left")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(v.joined(F.col(f"_carry_{i}"), F.col(f"_local_{i}")).alias(name) for i, (name, v) in enumerate(values.items())))


def ahead(value: str, up_to: Column) -> Column:
    """Of a running total, what stands before the row."""
    return up_to - F.coalesce(F.col(value), F.lit(0))
