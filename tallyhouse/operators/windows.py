"""Running sums over long ordered groups, cut into slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame, keys: Sequence[str], slice_of: Column, order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """SUM(value) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING).

    ``slice_of`` must not decrease along the order. A window runs within each (key,
    slice); the sum of the slices before it, one number per slice, is added. A key with
    very many rows is thus spread over as many tasks as it has slices.
    """
    cut = df.withColumn("_slice", slice_of).withColumn("_value", value)
    sums = cut.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry")
    carry = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"), carried)
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = cut.withColumn("_run", F.sum("_value").over(within))
    cond = F.col("_slice") == F.col("_s")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(carry, cond).select(
        *[local[c] for c in df.columns], (F.col("_run") + F.col("_carry")).alias(out)
    )
