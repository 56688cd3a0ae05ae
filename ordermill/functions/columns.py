"""Small expressions over order columns; all of them stay inside generated code.

Totals that feed a shuffle are summed as whole cents: a bigint buffer is half the size of
the wide decimal that ``sum`` of a decimal needs, and stays in Spark's fast hash map. The
declared DECIMAL(15,2) of every total is exceeded long before a bigint of cents is.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_amount() -> Column:
    """Price plus freight of one line; null when either is null."""
    return F.col("price") + F.col("freight_value")


def cents(value: Column) -> Column:
    """A decimal with two places as whole cents."""
    return (value * 100).cast("bigint")


def price_cents() -> Column:
    """Price of one line in cents, through its declared type."""
    return cents(F.col("price").cast("decimal(10,2)"))


def line_cents() -> Column:
    """Price plus freight of one line in cents; null when either is null."""
    declared = [F.col(c).cast("decimal(10,2)") for c in ("price", "freight_value")]
    return cents(declared[0] + declared[1])


def money(value: Column) -> Column:
    """Declared type of a total."""
    return value.cast("decimal(15,2)")


def money_of_cents(total: Column) -> Column:
    return money(total.cast("decimal(20,0)") * F.lit(Decimal("0.01")))


def mean_of_cents(total: Column, n: Column) -> Column:
    """Average in currency units of ``n`` values that sum to ``total`` cents; null for none.

    Both operands are whole numbers, exact as doubles, so their one division is the
    double nearest to the true average, on any partitioning.
    """
    return total.cast("double") / F.nullif(n * 100, F.lit(0))


def mean(total: Column, n: Column) -> Column:
    """As ``mean_of_cents``, from a decimal total with two places."""
    return mean_of_cents(total * 100, n)


def sale_date() -> Column:
    """Calendar day of purchase, in the session time zone."""
    return F.to_date("order_purchase_timestamp")


def days_between(end: str, start: str) -> Column:
    """Whole calendar days; time of day plays no part."""
    return F.datediff(F.col(end), F.col(start))
