"""Arithmetic on whole numbers of any length, in strings: limbs of six digits in arrays, carries by folds.

A number is a string of digits; anything else (signs, blanks, nothing) counts as null. Sums and
comparisons are built-in expressions. Products and quotients take a step for each pair of limbs or digit, for which
Spark interprets an expression; Python's own whole numbers, a batch of rows at a time, are far faster there.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS, BASE = 6, 1_000_000


def digits(text: Column) -> Column:
    """The number without leading zeros, null if the text is no whole number."""
    return F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=.)", ""))


def limbs(text: Column, n: Column | None = None) -> Column:
    """The limbs of a number, the least first, at least n of them."""
    size = F.ceil(F.length(text) / DIGITS).cast("int")
    size = size if n is None else F.greatest(size, n)
    padded = F.lpad(text, size * DIGITS, "0")
    return F.transform(F.sequence(size - 1, F.lit(0), F.lit(-1)), lambda i: F.substring(padded, i * DIGITS + 1, F.lit(DIGITS)).cast("long"))


def carried(sums: Column) -> Column:
    """Limbs below BASE from limbs of any size, the least first."""
    empty = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        total = x + state["carry"]
        low = F.pmod(total, F.lit(BASE))
        return F.struct(((total - low) / BASE).cast("long").alias("carry"), F.concat(state["out"], F.array(low)).alias("out"))

    folded = F.aggregate(F.concat(sums, F.array_repeat(F.lit(0).cast("long"), 3)), empty, step)
    return folded["out"]


def number(parts: Column) -> Column:
    """The string of limbs, the least first."""
    text = F.array_join(F.transform(F.reverse(parts), lambda x: F.lpad(x.cast("string"), DIGITS, "0")), "")
    return F.regexp_replace(text, "^0+(?=.)", "")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wide_add(*texts: Column) -> Column:
    """The sum of whole numbers of any length; null if one of them is none."""

    def added(known: Column) -> Column:
        size = F.ceil(F.array_max(F.transform(known, F.length)) / DIGITS).cast("int")
        zero = F.array_repeat(F.lit(0).cast("long"), size)
        sums = F.aggregate(known, zero, lambda s, t: F.zip_with(s, limbs(t, size), lambda x, y: x + y))
        return F.when(~F.exists(known, F.isnull), number(carried(sums)))

    return _let(F.array(*map(digits, texts)), added)


@F.pandas_udf(T.StringType())
def _products(a: pd.Series, b: pd.Series) -> pd.Series:
    return _whole(a, b, lambda x, y: x * y)


@F.pandas_udf(T.StringType())
def _quotients(a: pd.Series, b: pd.Series) -> pd.Series:
    return _whole(a, b, lambda x, y: x // y if y else None)


def _whole(a: pd.Series, b: pd.Series, of) -> pd.Series:
    """of(a, b) as strings, row by row; null where either is null or the result is."""
    sys.set_int_max_str_digits(0)
    results = (None if x is None or y is None else of(int(x), int(y)) for x, y in zip(a, b))
    return pd.Series([None if r is None else str(r) for r in results], dtype=object)


def wide_product(a: Column, b: Column) -> Column:
    """a * b, whole numbers of any length."""
    return _products(digits(a), digits(b))


def wide_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is less than, equal to or greater than b."""

    def compared(p: Column, q: Column) -> Column:
        longer = F.signum(F.length(p) - F.length(q)).cast("int")
        same = F.when(p < q, -1).when(p > q, 1).otherwise(0)
        return F.when(p.isNotNull() & q.isNotNull(), F.when(longer != 0, longer).otherwise(same))

    return _let(digits(a), lambda p: _let(digits(b), lambda q: compared(p, q)))


def wide_quotient(a: Column, b: Column) -> Column:
    """The whole part of a / b, whole numbers of any length; null for a zero divisor."""
    return _quotients(digits(a), digits(b))
