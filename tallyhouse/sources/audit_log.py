"""Audit records as JSON lines, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "audit_id STRING, ts_ms BIGINT, kind STRING, request_id STRING, user_id STRING, "
    "access_groups ARRAY<STRING>, question STRING, tool_name STRING, sql_hash STRING, "
    "decision STRING, violations ARRAY<STRUCT<code: STRING, severity: STRING, message: STRING>>, "
    "duration_ms DOUBLE, row_count BIGINT, error_code STRING"
)


def stamp_audit(df: DataFrame) -> DataFrame:
    """Add ``audit_id`` where it is missing and the time of writing as ``ts_ms``."""
    fresh = F.expr("uuid()")
    audit_id = F.coalesce(F.col("audit_id"), fresh) if "audit_id" in df.columns else fresh
    return df.withColumn("audit_id", audit_id).withColumn(
        "ts_ms", F.unix_millis(F.current_timestamp())
    )


def write_audit(df: DataFrame, path: str) -> None:
    """Append records to the log folder."""
    stamp_audit(df).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Read records back with a declared schema."""
    return spark.read.schema(schema).json(path)


def read_audit_stream(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Follow the log folder as a stream."""
    return spark.readStream.schema(schema).json(path)
