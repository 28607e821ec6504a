"""Formulas of the lending reports, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.numeric import clamp, safe_div, trunc_dp


def ltv(debt_value: Column, tvl: Column) -> Column:
    """Percent, cut to two places; 0 without debt, null without collateral."""
    return F.when(debt_value == 0, F.lit(0.0)).otherwise(trunc_dp(F.try_divide(debt_value, tvl) * 100, 2))


def liquidation_value(debt: Column, credit_price: Column, liquidation_ltv: Column) -> Column:
    return F.try_divide(debt * credit_price, liquidation_ltv / 100)


def max_mint(tvl: Column, borrow_ltv: Column, credit_price: Column) -> Column:
    return F.try_divide(tvl * (borrow_ltv / 100), credit_price)


def mintable(tvl: Column, borrow_ltv: Column, credit_price: Column, debt: Column) -> Column:
    """What can still be borrowed; the credit's price counts as 1 at least."""
    return tvl * (borrow_ltv / 100) / F.greatest(credit_price, F.lit(1.0)) - debt


def liquidation_fee(ltv_: Column, liquidation_ltv: Column, debt_value: Column) -> Column:
    gap = ltv_ - liquidation_ltv
    return gap / 100 * (gap / ltv_ * debt_value)


def health(ltv_: Column, liquidation_ltv: Column) -> Column:
    return 100 - F.try_divide(ltv_, liquidation_ltv) * 100


def leverage(collateral: Column, debt: Column) -> Column:
    return collateral / F.greatest(F.lit(0.01), collateral - debt)


def liquidation_price(debt: Column, amount: Column, max_ltv: Column) -> Column:
    return F.try_divide(debt, amount * max_ltv)


def market_leverage(max_ltv: Column) -> Column:
    return F.try_divide(F.lit(1.0), 1 - max_ltv)


def interest_rate(utilisation: Column, base: Column, slope: Column, kink: Column, steep: Column) -> Column:
    """Piecewise linear with a kink."""
    return F.when(utilisation <= kink, base + slope * utilisation).otherwise(base + slope * kink + steep * (utilisation - kink))


def simple_apr(revenue: Column, tvl: Column, days: Column) -> Column:
    """Percent a year; null without tvl. Spans under a day count as one."""
    return F.try_divide(revenue, tvl) * (365 / F.greatest(days, F.lit(1.0))) * 100


def annualised(now: Column, past: Column, days: Column) -> Column:
    """Percent a year, compounded; null without a past rate or a span."""
    return F.when((past != 0) & (days > 0), (F.pow(now / past, 365 / days) - 1) * 100)


def lock_boost(lock_days: Column, elapsed_days: Column, ceiling: float, perpetual: Column) -> Column:
    """1 to 2: the lock and the time passed, against a ceiling; perpetual locks have it all."""
    return F.when(perpetual, F.lit(2.0)).otherwise(1 + F.least(F.lit(1.0), lock_days / ceiling + F.greatest(elapsed_days, F.lit(0.0)) / ceiling))


def lock_multiplier(remaining_days: Column, perpetual: Column, ceiling: float = 365.0) -> Column:
    return F.when(perpetual, F.lit(ceiling + 1)).otherwise(F.greatest(remaining_days, F.lit(0.0)) + 1)


def lockdrop_points(deposit: Column, days: Column, ceiling: float) -> Column:
    return deposit * (1 + days / ceiling)


def level(points: Column) -> Column:
    return (F.floor((points + 1) / 10) + 1).cast("long")


def tier(score: Column) -> Column:
    return F.when(score >= 80, "legend").when(score >= 50, "core").when(score >= 20, "member").otherwise("visitor")


def minimum_output(amount: Column, price: Column, slippage_percent: Column, decimals_gap: int = 0) -> Column:
    return F.floor(amount * price * (1 - slippage_percent / 100) * 10.0**decimals_gap)


def auction_discount(elapsed: Column, step_seconds: float, step: float, most: float = 0.99) -> Column:
    """Rises by `step` with each whole step of time since the start, up to `most`."""
    return F.least(F.floor(F.greatest(elapsed, F.lit(0.0)) / step_seconds) * step, F.lit(most))


def pool_health(pool: Column, value: Column) -> Column:
    return F.when(pool > 0, F.greatest((pool - value) / pool * 100, F.lit(0.0))).otherwise(F.lit(0.0))


def share(part: Column, total: Column) -> Column:
    return clamp(safe_div(part, total), 0.0, 1.0)
