"""Line-revenue columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_revenue(price: Column, quantity: Column, discount: Column) -> Column:
    """Revenue of one line: price x quantity x (1 - discount)."""
    return price * quantity * (F.lit(1) - discount)


def extended_revenue(extended: Column, discount: Column) -> Column:
    """Line revenue where the price is already multiplied by the quantity.

    Both inputs carry two decimals, so the product is exact as DECIMAL(18,4) and a
    sum does not depend on the order in which partitions are merged.
    """
    return extended.cast("decimal(12,2)") * (
        F.lit(1).cast("decimal(4,2)") - discount.cast("decimal(4,2)")
    )


def line_money(revenue: Column) -> Column:
    """Revenue rounded to whole cents, by way of a four-decimal money value of a hundredth."""
    return (revenue / F.lit(100)).cast("decimal(19,4)") * F.lit(100)


def full_name(first: Column, last: Column) -> Column:
    """First and last name; null when either part is null."""
    return F.concat(first, F.lit(" "), last)
