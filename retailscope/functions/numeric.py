"""Exact decimal arithmetic on Spark columns.

Money stays decimal until the last step. Ratios are rounded once, half away from zero, by
integer division: a decimal quotient in Spark keeps only some digits, and a second rounding of it
can be off by one unit in the last place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "decimal(33,0)"


def whole(value: Column) -> Column:
    return value.cast(WHOLE)


def cents(money: Column) -> Column:
    """Money (two decimals) as a whole number of cents."""
    return (money * 100).cast(WHOLE)


def rounded_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """`round(num / den, digits)` of two whole numbers as double; NULL when `den` is 0 or NULL."""
    scale = 10**digits
    n, d = whole(num), whole(den)
    units = F.call_function("div", F.abs(n) * (2 * scale) + F.abs(d), F.nullif(F.abs(d) * 2, F.lit(0)))
    return F.signum(n.cast("double")) * F.signum(d.cast("double")) * units.cast("double") / F.lit(float(scale)) + F.lit(0.0)


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """`round(100 * part / total, digits)` of two whole numbers."""
    return rounded_ratio(whole(part) * 100, total, digits)


def money_percent(part: Column, total: Column, digits: int = 2) -> Column:
    return percent(cents(part), cents(total), digits)


def money_mean(total: Column, count: Column, digits: int = 2) -> Column:
    """`round(total / count, digits)` for a decimal sum and a row count."""
    return rounded_ratio(cents(total), whole(count) * 100, digits)


def money(total: Column) -> Column:
    """Decimal result as double, the output type of every report."""
    return total.cast("double")


def safe_divide(num: Column, den: Column) -> Column:
    """Double quotient; NULL for a zero or missing divisor."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def rows() -> Column:
    return F.count(F.lit(1))


def count_where(condition: Column) -> Column:
    """Rows that satisfy a condition; 0 (not NULL) when there are none."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))
