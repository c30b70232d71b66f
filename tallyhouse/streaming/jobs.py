"""Structured Streaming jobs: screening, windowed activity and a per-user limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyhouse.functions.payload import redact_payload
from tallyhouse.operators.activity import SECOND
from tallyhouse.operators.screening import ingress_filter

# Fixed value: a key's state goes after a day without a request.
IDLE_MS = 86_400_000


def windowed_activity(
    stream: DataFrame, width: str = "1 minute", late: str = "10 minutes",
    ts: str = "ts", key: str = "user_id",
) -> DataFrame:
    """Requests per key in tumbling windows; rows later than the watermark are left out."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = timed.groupBy(F.window(ts, width), F.col(key)).agg(F.count("*").alias("requests"))
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key,
        "requests",
    )


def rate_limit_stream(
    stream: DataFrame, limit: int, secs: int, key: str = "user_id", id_col: str = "request_id",
    ts: str = "ts", late: str = "10 minutes",
) -> DataFrame:
    """Sliding-window limiter per key as a stream: key, id, ts, allowed.

    Requests of one instant go by id. State per key is the stored hits of one window, at most ``limit`` instants. Within a
    micro-batch the rows of a key are taken in time order; bound the micro-batch with
    the source's rate options. A key idle for a day is dropped.
    """
    width = secs * SECOND
    rows = stream.select(
        F.col(key).cast("string").alias("key"), F.col(id_col).alias("id"),
        F.col(ts).cast("timestamp").alias("at"),
    ).withWatermark("at", late)
    rows = rows.withColumn("us", F.unix_micros("at"))
    id_type = rows.schema["id"].dataType.simpleString()

    def step(
        group: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(frames), ignore_index=True).sort_values(["us", "id"])
        us = batch["us"].tolist()
        allowed, first = [], 0
        for t in us:
            while first < len(hits) and hits[first] < t - width:
                first += 1
            ok = len(hits) - first < limit
            if ok:
                hits.append(t)
            allowed.append(ok)
        state.update((hits[first:],))
        idle_until = us[-1] // 1000 + IDLE_MS
        state.setTimeoutTimestamp(max(idle_until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": group[0], "id": batch["id"], "us": us, "allowed": allowed})

    return rows.groupBy("key").applyInPandasWithState(
        step, f"key string, id {id_type}, us bigint, allowed boolean", "hits array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def screen_batch(batch: DataFrame, text_col: str, meta_col: str | None = None) -> DataFrame:
    """Screening of one set of messages: limits, override attempts, redacted payload."""
    return ingress_filter(redact_payload(batch), text_col, meta_col)


def write_apart(
    out: str, text_col: str, meta_col: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch writer with two sinks; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        screened = screen_batch(batch, text_col, meta_col).persist()
        try:
            for name, rows in (("accepted", F.col("allowed")), ("rejected", ~F.col("allowed"))):
                target = f"{out}/{name}/batch_id={batch_id}"
                screened.filter(rows).write.mode("overwrite").parquet(target)
        finally:
            screened.unpersist()

    return write


def stream_screen(
    stream: DataFrame, out: str, checkpoint: str, text_col: str, meta_col: str | None = None
):
    """Start the screening of an arriving message stream; available data, then stop."""
    return (
        stream.writeStream.foreachBatch(write_apart(out, text_col, meta_col))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over the available data into a Parquet table and read it back."""
    q = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the highest ``version`` per key; tasks keep one row per key before the shuffle."""
    names = [c for c in rows.columns if c != version]
    rest = [F.col(c) for c in names if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_newest"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_newest.{c}").alias(c) for c in names])


def run_to_latest(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregating stream over the available data and give every group as it stands.

    In update mode the stream itself puts out each group that a batch has changed, open ones
    too. A batch is a folder of its own, which a repetition overwrites, and readers take a
    group's newest row; so this also serves a stream that goes on.
    """
    spark, schema = stream.sparkSession, stream.schema
    # The folder is there even if no batch ever comes.
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    q = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda rows, no: rows.write.mode("overwrite").parquet(f"{path}/batch={no}"))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    versions = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return latest(spark.read.schema(versions).parquet(path), keys, "batch")
