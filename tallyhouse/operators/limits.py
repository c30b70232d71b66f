"""Sorting, top-k and row caps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

R = TypeVar("R")


def top_n(df: DataFrame, metric: str, n: int, tie: Sequence[str]) -> DataFrame:
    """Highest ``n`` rows by ``metric``; ``tie`` settles equal values."""
    return df.orderBy(F.col(metric).desc_nulls_last(), *[F.col(t).asc() for t in tie]).limit(n)


def bottom_n(df: DataFrame, metric: str, n: int, tie: Sequence[str]) -> DataFrame:
    """Lowest ``n`` rows by ``metric``."""
    return df.orderBy(F.col(metric).asc_nulls_first(), *[F.col(t).asc() for t in tie]).limit(n)


def first_n_by(df: DataFrame, order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY ...) with ``rn <= n``.

    The n rows are found by a distributed top-n first; only they enter the
    unpartitioned window.
    """
    head = df.orderBy(*order).limit(n)
    return head.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def top_k(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """Best ``k`` rows per group; each map task trims its own rows before the shuffle."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _into_nothing(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


class Capped:
    """A capped result whose status is observed while its rows are read, in the same job.

    ``rows`` may be shaped further (``shaped``) and read by any action; ``run`` does so and
    knows that the status is there. The status is that of the first run that ends well.
    """

    def __init__(self, rows: DataFrame, seen: Observation, max_rows: int, columns: Sequence[str] | None = None) -> None:
        self.rows, self._seen, self._max_rows, self._columns = rows, seen, max_rows, columns
        self._ran = [False]

    def shaped(self, shape: Callable[[DataFrame], DataFrame]) -> Capped:
        """The same result with its rows transformed; both share one status."""
        out = Capped(shape(self.rows), self._seen, self._max_rows, self._columns)
        out._ran = self._ran
        return out

    def run(self, action: Callable[[DataFrame], R] = DataFrame.collect) -> R:
        """Read the rows once: collected, or by any action, such as a write."""
        got = action(self.rows)
        self._ran[0] = True
        return got

    def counts(self) -> dict[str, int | bool | str]:
        """row_count, truncated (set once the cap is reached) and, for a preview, columns."""
        if not self._ran[0]:
            self.run(_into_nothing)
        # A plan that is known to be empty holds nothing to observe.
        n = min(self._seen.get.get("row_count") or 0, self._max_rows)
        status = {"row_count": n, "truncated": n >= self._max_rows}
        return status if self._columns is None else status | {"columns": ",".join(self._columns)}

    def status(self) -> DataFrame:
        """``counts`` as a frame of one row."""
        cells = [F.lit(v).cast("long" if k == "row_count" else "boolean" if k == "truncated" else "string").alias(k) for k, v in self.counts().items()]
        return self.rows.sparkSession.range(1).select(*cells)


def cap_rows(df: DataFrame, max_rows: int) -> Capped:
    """Hard row cap; rows and status come from one run."""
    seen = Observation()
    return Capped(df.limit(max_rows).observe(seen, F.count(F.lit(1)).alias("row_count")), seen, max_rows)


def with_default_limit(df: DataFrame, n: int, has_limit: bool) -> DataFrame:
    """Cap a result that carries no limit of its own; unions and CTEs are capped too."""
    return df if has_limit else df.limit(n)


def distinct_capped(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """SELECT DISTINCT, then the cap."""
    return df.select(*cols).distinct().limit(n)


def preview(df: DataFrame, order: Sequence[Column], n: int = 10, max_rows: int = 10_000) -> Capped:
    """First rows of a sorted result beside its row count, columns and truncation flag, from one run.

    The cap bounds what is counted; the sample is the head of the whole result.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("row_count"))
    return Capped(counted.orderBy(*order).limit(n), seen, max_rows, df.columns)
