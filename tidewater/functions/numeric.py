"""Numbers as the reports need them: truncating decimals, guarded division, wide integers in strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on a double has no decimal places.
_WHOLE = 9e15


def trunc_dp(x: Column, places: int) -> Column:
    """Cut to so many decimal places, toward zero: -1.239 becomes -1.23. Too large to have such places: as it is."""
    scale = F.lit(10.0**places)
    return F.when(F.abs(x) * scale < _WHOLE, F.sign(x) * F.floor(F.abs(x) * scale) / scale).otherwise(x)


def half_up(x: Column, places: int = 0) -> Column:
    """Round to the nearest, halves toward plus infinity. Too large to have such places: as it is."""
    scale = F.lit(10.0**places)
    return F.when(F.abs(x) * scale < _WHOLE, F.floor(x * scale + F.lit(0.5)) / scale).otherwise(x)


def shift_digits(amount: Column, places: int, keep: int = 6) -> Column:
    """amount * 10**places, cut to `keep` decimal places; 0 where the amount is no number."""
    return trunc_dp(F.coalesce(amount.try_cast("double"), F.lit(0.0)) * F.lit(10.0**places), keep)


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b; the default where b is 0 or either is null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def clamp(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def uint(text: Column) -> Column:
    """A wide unsigned integer in a string; null where it isn't one or needs more than 38 digits."""
    return text.try_cast("decimal(38,0)")


def overflows(text: Column) -> Column:
    """Whether the string is an unsigned integer that uint() can't hold: such rows belong in quarantine."""
    return text.rlike("^[0-9]+$") & uint(text).isNull()


def is_numeric(text: Column) -> Column:
    """Whether a string reads as a number; an empty or blank one does, as 0."""
    return (F.trim(text) == "") | text.try_cast("double").isNotNull()


def exact(x: Column, scale: int = 4) -> Column:
    """A money amount as a decimal, so that sums don't depend on the order of rows."""
    return x.cast(f"decimal(18,{scale})")


def wide_sum(text: Column) -> Column:
    """The exact sum of unsigned integers of up to 47 digits in strings, as a string: an aggregate of the upper digits
    and of the lower 19, with the carry brought over at the end."""
    padded = F.lpad(text, 47, "0")
    low = F.sum(F.substring(padded, 29, 19).cast("decimal(19,0)")).cast("decimal(38,0)").cast("string")
    high = F.sum(F.substring(padded, 1, 28).cast("decimal(28,0)"))
    carry = F.substring(F.lpad(low, 38, "0"), 1, 19).cast("decimal(19,0)")
    digits = F.concat((high + carry).cast("string"), F.substring(F.lpad(low, 38, "0"), 20, 19))
    return F.regexp_replace(digits, "^0+(?=.)", "")
