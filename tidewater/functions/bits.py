"""Packed flags, a 32-bit generator step and weighted picks, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def pack_nibbles(values: list[Column]) -> Column:
    """Four-bit values in one number, the first in the lowest bits."""
    out = F.lit(0)
    for i, v in enumerate(values):
        out = out.bitwiseOR(F.shiftleft(v.cast("int").bitwiseAND(15), 4 * i))
    return out


def nibble(packed: Column, i: int) -> Column:
    return F.shiftright(packed, 4 * i).bitwiseAND(15)


def xorshift32(state: Column) -> Column:
    """One step (13, 17, 5) on an unsigned 32-bit state in a long."""
    x = state.cast("long").bitwiseAND(_LOW)
    x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(_LOW)
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(_LOW)


def weighted_pick(roll: Column, options: list[tuple[str, int]]) -> Column:
    """The option in whose share of the total weight roll % total falls."""
    r = roll % sum(w for _, w in options)
    out, bound = None, 0
    for name, weight in options[:-1]:
        bound += weight
        out = F.when(r < bound, name) if out is None else out.when(r < bound, name)
    return F.lit(options[-1][0]) if out is None else out.otherwise(options[-1][0])


def little_endian(digits: Column) -> Column:
    """An array of bytes, lowest first, as a number."""
    return F.aggregate(F.reverse(digits), F.lit(0).cast("long"), lambda acc, b: acc * 256 + b)
