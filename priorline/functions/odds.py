"""Odds arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def american_to_decimal(odds: Column) -> Column:
    """+150 -> 2.5, -200 -> 1.5, 0 -> null."""
    return F.when(odds > 0, 1 + odds / 100.0).when(odds < 0, 1 + 100.0 / F.abs(odds))


def mixed_to_decimal(odds: Column) -> Column:
    """Absolute values of 100 and more are American; a result of 1 or less is null."""
    decimal = F.when(F.abs(odds) >= 100, american_to_decimal(odds)).otherwise(odds)
    return F.when(decimal > 1, decimal)


def implied_probability(decimal: Column) -> Column:
    return F.when(decimal > 1, 1 / decimal)


def no_vig(a: Column, b: Column) -> Column:
    """Share of ``a`` in the two-way book."""
    return F.when(a + b > 0, a / (a + b))


def vig(a: Column, b: Column) -> Column:
    return a + b - 1


def log_price_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.log(a / b))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def z_score(value: Column, center: Column, spread: Column) -> Column:
    return safe_divide(value - center, spread)


def number(text: Column) -> Column:
    """Numeric coercion: anything unreadable, NaN and infinities become null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def pick_of(diff: Column) -> Column:
    """OVER above zero, UNDER below, PUSH at zero, null for null."""
    return F.when(diff > 0, "OVER").when(diff < 0, "UNDER").when(diff == 0, "PUSH")
