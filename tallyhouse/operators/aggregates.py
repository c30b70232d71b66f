"""Grouped aggregates.

Sums that need a parent's attribute are taken in two steps: once per foreign key,
where map-side combine folds a heavily repeated key, and once more per attribute
after the join. The second step sees one row per key instead of one per line.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(df: DataFrame, value: Column, out: str) -> DataFrame:
    """One global sum; nulls are left out."""
    return df.agg(F.sum(value).alias(out))


def sum_by(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Sum per key."""
    return df.groupBy(*keys).agg(F.sum(value).alias(out))


def sum_by_parent(
    child: DataFrame, fk: str, value: Column, parent: DataFrame, pk: str,
    keys: Sequence[str], out: str,
) -> DataFrame:
    """Sum of a child's value per attribute of its parent, folded per key before the join."""
    sub = child.groupBy(F.col(fk).alias("_fk")).agg(F.sum(value).alias("_v"))
    dim = parent.select(F.col(pk).alias("_pk"), *keys)
    return sub.join(dim, F.col("_fk") == F.col("_pk")).groupBy(*keys).agg(F.sum("_v").alias(out))


def count_by(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Number of non-null values per key."""
    return df.groupBy(*keys).agg(F.count(col).alias(out))


def count_by_parent(
    child: DataFrame, fk: str, col: str, parent: DataFrame, pk: str, keys: Sequence[str], out: str
) -> DataFrame:
    """Number of children per attribute of the parent, folded per key before the join."""
    sub = child.groupBy(F.col(fk).alias("_fk")).agg(F.count(col).alias("_n"))
    dim = parent.select(F.col(pk).alias("_pk"), *keys)
    return sub.join(dim, F.col("_fk") == F.col("_pk")).groupBy(*keys).agg(F.sum("_n").alias(out))


def count_all(df: DataFrame) -> DataFrame:
    """Number of rows as ``record_count``."""
    return df.agg(F.count("*").alias("record_count"))


def avg_by(
    df: DataFrame, keys: Sequence[str], col: Column, out: str, where: Column | None = None
) -> DataFrame:
    """Average per key after an optional filter."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg((F.sum(col).cast("double") / F.count(col)).alias(out))


def avg_of_sums(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Average of the per-key sums."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_s"))
    return sums.agg((F.sum("_s").cast("double") / F.count("_s")).alias(out))


def count_where(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """SUM(CASE WHEN p THEN 1 ELSE 0 END) for several conditions; null on empty input."""
    return df.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()])


def min_max_by(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Least and greatest value per key."""
    return df.groupBy(*keys).agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))


def metrics_by(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """Several named aggregates in one pass."""
    return df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in metrics.items()])


def by_period(
    child: DataFrame, fk: str, value: Column, parent: DataFrame, pk: str, date: str,
    parts: Mapping[str, Column], out: str,
) -> DataFrame:
    """Sum of a child's value per calendar period of its parent's date; null dates dropped."""
    sub = child.groupBy(F.col(fk).alias("_fk")).agg(F.sum(value).alias("_v"))
    dim = parent.filter(F.col(date).isNotNull()).select(
        F.col(pk).alias("_pk"), *[c.alias(n) for n, c in parts.items()]
    )
    joined = sub.join(dim, F.col("_fk") == F.col("_pk"))
    return joined.groupBy(*parts).agg(F.sum("_v").alias(out))
