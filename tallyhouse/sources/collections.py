"""Document collections: keyed upsert, reset, and result sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import materialize

BUCKETS = 64


def upsert_documents(existing: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """Existing documents with the batch written over them; the last write per id wins.

    A write with a null order comes before all others, and writes of one order are settled by
    their values, so the result does not depend on the order of rows. Repeats inside the
    batch fold by aggregation: an id written many times does not gather its rows in one task.
    Applying the same batch again changes nothing.
    """
    cols = list(existing.columns)
    latest = batch.groupBy("id").agg(F.max(_write(cols, order_col)).alias("_w"))
    written = latest.select("id", "_w.rest.*").select(*cols)
    return existing.join(written.select("id"), "id", "left_anti").select(*cols).unionByName(written)


def _write(cols: list[str], order_col: str) -> Column:
    rest = F.struct(*[F.col(c) for c in cols if c != "id"])
    return F.struct(F.col(order_col).isNotNull().alias("known"), F.col(order_col).alias("at"), rest.alias("rest"))


def create_collection(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write a collection whose rows lie in folders by a hash of ``id``, for ``upsert_collection``.

    The number of buckets is part of the folders' names, so every later batch finds it. Each
    bucket is one file; choose so many that a bucket is a comfortable task.
    """
    name = f"bucket_of_{buckets}"
    rows = df.withColumn(name, _bucket(buckets)).repartition(buckets, name)
    rows.write.mode("errorifexists").partitionBy(name).parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a bucketed collection."""
    rows = spark.read.parquet(path)
    return rows.drop(_bucket_column(rows))


def upsert_collection(batch: DataFrame, path: str, order_col: str) -> None:
    """Write a batch over a bucketed collection; as ``upsert_documents``, but in place.

    Only the buckets that the batch has ids for are read and written, the files of all others
    stay as they are. The merged buckets are written aside first, then take the place of the old
    ones. Applying the same batch again changes no document; after a failure, apply it again.
    An empty batch writes nothing. One writer at a time.
    """
    spark = batch.sparkSession
    existing = spark.read.parquet(path)
    name = _bucket_column(existing)
    buckets = int(name.rsplit("_", 1)[1])
    cols = [c for c in existing.columns if c != name]
    batch = materialize(batch.select(*dict.fromkeys([*cols, order_col])), "batch")
    # At most as many numbers as there are buckets.
    touched = [r[0] for r in batch.select(_bucket(buckets)).distinct().collect()]
    if not touched:
        return
    merged = upsert_documents(existing.filter(F.col(name).isin(touched)).select(*cols), batch, order_col)
    merged = materialize(merged.withColumn(name, _bucket(buckets)).repartition(len(touched), name), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _bucket_column(rows: DataFrame) -> str:
    names = [c for c in rows.columns if re.fullmatch(r"bucket_of_\d+", c)]
    if not names:
        raise ValueError("no bucketed collection: write it with create_collection")
    return names[-1]


def written_count(batch: DataFrame) -> DataFrame:
    """How many documents a batch writes: one per id."""
    return batch.agg(F.countDistinct("id").alias("written"))


def write_collection(df: DataFrame, path: str, force: bool = False) -> None:
    """Write a collection to a folder; ``force`` empties it first.

    Never write to the folder ``df`` was read from: go through a new one.
    """
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header, every value quoted, null as the empty string."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    writer = text.write.option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("emptyValue", "").csv(path)


def write_report(summary: DataFrame, items: DataFrame, path: str) -> None:
    """A report folder: ``summary`` and ``results`` as JSON lines."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    items.write.mode("overwrite").json(f"{path}/results")


