"""Display strings, their parsing, and ordered classification of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency(x: Column, places: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, places))


def abbreviated(x: Column) -> Column:
    """950, 1.2K, 3.4M, 5.6B: one decimal place, cut."""
    cut = lambda y: F.regexp_replace(F.format_string("%.1f", F.floor(y * 10) / 10), r"\.0$", "")
    return F.when(x >= 1e9, F.concat(cut(x / 1e9), F.lit("B"))).when(x >= 1e6, F.concat(cut(x / 1e6), F.lit("M"))).when(x >= 1e3, F.concat(cut(x / 1e3), F.lit("K"))).otherwise(cut(x))


def percent_floor(x: Column, places: int = 2) -> Column:
    """A percentage (already times 100), floored."""
    return F.concat(F.format_string(f"%.{places}f", F.floor(x * 10.0**places) / 10.0**places), F.lit("%"))


def trimmed(x: Column, places: int = 6) -> Column:
    """Fixed decimal places without zeros at the end."""
    return F.regexp_replace(F.format_string(f"%.{places}f", x), r"\.?0+$", "")


def to_second_significant(x: Column) -> Column:
    """Below 1: rounded to the second significant decimal. From 1 on: to two decimal places."""
    places = F.when(F.abs(x) >= 1, F.lit(2)).otherwise(F.least(F.lit(12), 1 - F.floor(F.log10(F.abs(x))))).cast("int")
    scale = F.pow(F.lit(10.0), places)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x * scale + 0.5) / scale)


def parse_display(text: Column) -> Column:
    """'$5.4M', '2.5x', '0.18%', '1,234' as numbers; null where nothing numeric is there."""
    digits = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
    scale = F.when(text.endswith("B"), 1e9).when(text.endswith("M"), 1e6).when(text.endswith("K"), 1e3).otherwise(1.0)
    return digits * scale


def ordinal(n: Column) -> Column:
    teens = (n % 100).between(11, 13)
    tail = F.when(teens, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def shortened(address: Column, prefix: Column | str) -> Column:
    """prefix...last4"""
    return F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("..."), F.substring(address, -4, 4))


def countdown(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def time_left(seconds: Column) -> tuple[Column, Column, Column]:
    """Whole days, hours and minutes, at least 0."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)


def relative_time(seconds: Column) -> Column:
    step = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.when(s < 60, "just now").when(s < 3600, step(F.floor(s / 60), "minute")).when(s < 86400, step(F.floor(s / 3600), "hour")).otherwise(step(F.floor(s / 86400), "day"))


def range_midpoint(text: Column) -> Column:
    """'60% - 75%': the mean of both ends."""
    ends = [F.regexp_extract(text, r"([0-9.]+)%\s*-\s*([0-9.]+)%", i).try_cast("double") for i in (1, 2)]
    return (ends[0] + ends[1]) / 2


def first_match(text: Column, patterns: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern, in the given order, that is found in the text, case ignored."""
    out = None
    for pattern, label in patterns:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def interpolated(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by its value; names without a value stay as they are."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("{" + name + "}")))
    return template


def decoded(code: Column, labels: dict[int, str], default: str = "unknown") -> Column:
    out = F.lit(default)
    for key, label in labels.items():
        out = F.when(code == key, label).otherwise(out)
    return out
