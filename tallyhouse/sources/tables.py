"""Readers for the source tables: Parquet folders with declared schemas, and JDBC."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.session import fan_out

# Declared schemas: no inference pass over the files.
TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


class Tables(Mapping[str, DataFrame]):
    """The tables of one data folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            schema = TABLE_SCHEMAS[name]
            path = f"{self.folder}/{name}.parquet"
            self._open[name] = self.spark.read.schema(schema).parquet(path)
        return self._open[name]

    def spread(self, name: str) -> DataFrame:
        """A table for heavy per-row work; see ``fan_out``."""
        return fan_out(self[name])

    def __iter__(self) -> Iterator[str]:
        return iter(TABLE_SCHEMAS)

    def __len__(self) -> int:
        return len(TABLE_SCHEMAS)


def read_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Read-only frames for every source table under ``sf_dir``."""
    return Tables(spark, sf_dir)


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Follow one table as a stream, be it a single file or a folder of parts.

    The path is a pattern because a file source takes a plain path to be a folder.
    """
    path = f"{sf_dir.rstrip('/')}/{{{name}}}.parquet"
    return spark.readStream.schema(TABLE_SCHEMAS[name]).parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_col: str,
    lower: int,
    upper: int,
    num_partitions: int = 64,
    fetch_size: int = 1_000,
    query_timeout: int = 30,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Partitioned JDBC scan; filters and column selection push down to the database."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", partition_col)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", num_partitions)
        .option("fetchsize", fetch_size)
        .option("queryTimeout", query_timeout)
    )
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    return reader.load()
