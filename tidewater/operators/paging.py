"""Search, filters from parameters, sorting by lists, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matches_anywhere(df: DataFrame, query: str) -> Column:
    """Whether any string column contains the query, case ignored."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False)) for c in strings), F.lit(False))


def narrowed(df: DataFrame, query: str | None = None, equal: dict[str, object] | None = None, one_of: dict[str, list] | None = None) -> DataFrame:
    """A search wins over filters; a list with 'All' in it, or an empty one, doesn't filter."""
    if query:
        return df.filter(matches_anywhere(df, query))
    for column, value in (equal or {}).items():
        df = df.filter(F.col(column) == value)
    for column, values in (one_of or {}).items():
        if values and "All" not in values:
            df = df.filter(F.col(column).isin(values))
    return df


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(df: DataFrame, size: int) -> DataFrame:
    """One row: rows and pages."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.ceil(F.col("n_rows") / size).alias("n_pages"))


def after_key(df: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """The next `size` rows after a key: the filter reaches the scan, nothing before the cursor is sorted."""
    return (df if cursor is None else df.filter(F.col(key) > cursor)).orderBy(key).limit(size)


def by_list(column: str, order: list) -> Column:
    """A sort key: place in a list, what isn't in it last."""
    place = F.array_position(F.lit(order), F.col(column))
    return F.when(place == 0, len(order) + 1).otherwise(place)
