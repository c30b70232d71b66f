"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import materialize


def content_key(col: str | Column) -> Column:
    """128 bits that stand for a text's content, as two longs in one struct."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.coalesce(c, F.lit(""))
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, lengthened until no column of the caller's is called that."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish = f"_{wish}"
    return wish


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """Schema of ``df`` with ``name`` as its last column, replacing any of that name."""
    kept = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    return T.StructType([*kept, T.StructField(name, kind, True)])


def row_slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes add up to about ``limit`` at most."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of a text column of about ``limit`` bytes at most, with their texts; null is empty."""
    for a, b in row_slices([n or 0 for n in pc.binary_length(column).to_pylist()], limit):
        yield a, b, [t or "" for t in column[a:b].to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: workers stay alive after a task, beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def append_array(batch: pa.RecordBatch, keep: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    """The columns ``keep`` of ``batch`` and ``values`` as ``name``."""
    cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*cols, values], names=[*keep, name])


def running(df: DataFrame, order: list[str | Column], label: str, out_col: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``out_col``: how many rows, or how much of ``weight``, stand before each row in ``order``.

    Rows are dealt to ranges of the order, written in order, and counted by range, so no
    task holds more than its range; a number per range is all that is added up in one place.
    Rows alike in ``order`` stand in any order.
    """
    part, place, offset = (free_name([*df.columns, out_col], c) for c in ("_part", "_place", "_offset"))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), label)
    size = F.lit(1).cast("long") if weight is None else F.col(weight)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part).agg(F.sum(size).alias(offset))
    parts = parts.select(part, F.coalesce(F.sum(offset).over(earlier), F.lit(0)).alias(offset))
    if weight is None:
        # Places of a range are consecutive from its number shifted by 33 bits.
        inside = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    else:
        ahead = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(ahead), F.lit(0))
    return rows.withColumn(out_col, inside).join(parts, part).withColumn(out_col, F.col(out_col) + F.col(offset)).drop(part, place, offset)
