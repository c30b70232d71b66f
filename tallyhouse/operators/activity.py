"""Audit roll-ups, trailing windows, concurrency and limiter replay over request logs.

Per-key work over time is cut into time slices: what crosses a slice boundary is a
compact number per (key, slice), so a key that holds a large share of the log is spread
over as many tasks as it has slices.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.dates import micros
from tallyhouse.operators.windows import running_sum
from tallyhouse.session import materialize

SECOND = 1_000_000
ANONYMOUS = "anonymous"


# -------------------------------------------------------------------- roll-ups


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Records, rows and durations by kind, decision and error."""
    return audit.groupBy("kind", "decision", "error_code").agg(
        F.count("*").alias("records"),
        F.sum("row_count").alias("rows_returned"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
    )


PHASES = ("intent_ms", "context_ms", "llm_ms", "sql_ms", "present_ms", "total_ms")


def phase_timings(events: DataFrame) -> DataFrame:
    """Milliseconds per phase for each request, out of its timings text."""
    parsed = F.from_json("timings_json", "map<string,bigint>")
    rows = events.filter(F.col("timings_json").isNotNull()).withColumn("_t", parsed)
    return rows.select("request_id", *[F.try_element_at("_t", F.lit(p)).alias(p) for p in PHASES])


def phase_summary(timings: DataFrame) -> DataFrame:
    """Requests, mean and exact percentiles per phase.

    Timings fold to counts per (phase, millisecond) first; the percentile is the least value
    that the given share of requests does not exceed.
    """
    long = timings.unpivot([], list(PHASES), "phase", "ms").filter(F.col("ms").isNotNull())
    folded = long.groupBy("phase", "ms").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("phase").orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = folded.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("phase")))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("ms")))
    return shares.groupBy("phase").agg(
        F.sum("n").alias("requests"),
        (F.sum(F.col("n") * F.col("ms")) / F.sum("n")).alias("mean_ms"),
        at(F.lit("0.5").cast("decimal(3,2)")).alias("p50_ms"),
        at(F.lit("0.95").cast("decimal(3,2)")).alias("p95_ms"),
    )


def request_lifecycle(events: DataFrame) -> DataFrame:
    """One row per request: start, end, outcome and duration.

    ``events``: request_id, status (started, success, error), ts, row_count, error_type. Of
    two outcomes at one instant success is the last.
    """
    ended = F.col("status").isin("success", "error")
    rows = events.groupBy("request_id").agg(
        F.min(F.when(F.col("status") == "started", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("ended_at"),
        F.max(F.when(ended, F.struct("ts", "status")))["status"].alias("outcome"),
        F.max("row_count").alias("row_count"),
        F.max("error_type").alias("error_type"),
    )
    took = (micros(F.col("ended_at")) - micros(F.col("started_at"))) / 1000
    outcome = F.when(F.col("ended_at").isNull(), "open").otherwise(F.col("outcome"))
    return rows.withColumn("outcome", outcome).withColumn("duration_ms", F.floor(took))


def violations(audit: DataFrame) -> DataFrame:
    """Rejected requests per violation code."""
    rows = audit.filter(F.col("decision") == "rejected").select(
        "request_id", F.explode("violations").alias("v")
    )
    return rows.groupBy(F.col("v.code").alias("code"), F.col("v.severity").alias("severity")).agg(
        F.count("*").alias("violations"), F.countDistinct("request_id").alias("requests")
    )


# ------------------------------------------------------------- trailing windows


def trailing_count(
    df: DataFrame, key: str, ts: str, secs: int, out: str = "trailing", slices: int = 16
) -> DataFrame:
    """Rows of the same key in the trailing ``secs`` seconds, both ends included; a row without a
    time has no count.

    The window is ``slices`` time slices long, so for a row in slice s it ends inside s
    and begins inside s - slices. Each row therefore goes to two partitions: its own
    slice, and the slice whose windows begin where the row lies. The slices between are
    counted as a whole.
    """
    width = secs * SECOND
    step = width // slices
    if step * slices != width:
        raise ValueError("the window must divide into whole slices")
    us = micros(F.col(ts))
    # Rows at one instant fold to one, so a burst of a key is a few rows here.
    instants = df.filter(us.isNotNull()).groupBy(F.col(key).alias("_key"), us.alias("_us")).agg(F.count("*").alias("_n"))
    instants = instants.withColumn("_s", F.floor(F.col("_us") / step))
    placed = instants.select("_key", F.explode(F.array(
        F.struct(F.col("_s").alias("s"), F.col("_us").alias("pos"), F.col("_us").alias("at"),
                 F.col("_n").alias("own"), F.lit(0).cast("long").alias("far")),
        F.struct((F.col("_s") + slices).alias("s"), (F.col("_us") + width).alias("pos"), F.lit(None).cast("long").alias("at"),
                 F.lit(0).cast("long").alias("own"), F.col("_n").alias("far")),
    )).alias("p")).select("_key", "p.*")
    part = Window.partitionBy("_key", "s")
    upto = part.orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = part.orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        "_key", "s", "at",
        F.sum("own").over(upto).alias("_near"),
        (F.sum("far").over(part) - F.coalesce(F.sum("far").over(before), F.lit(0))).alias("_far"),
    ).filter(F.col("at").isNotNull())
    sizes = instants.groupBy("_key", F.col("_s").alias("s")).agg(F.sum("_n").alias("_n"))
    between = Window.partitionBy("_key").orderBy("s").rangeBetween(1 - slices, -1)
    middle = sizes.select(F.col("_key").alias("_k"), F.col("s").alias("_m"), F.coalesce(F.sum("_n").over(between), F.lit(0)).alias("_mid"))
    counted = local.join(middle, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("s") == F.col("_m")))
    counted = counted.select("_key", "at", (F.col("_near") + F.col("_far") + F.col("_mid")).alias("_count"))
    rows = df.withColumn("_at", us)
    joined = rows.join(counted, rows[key].eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("at")), "left")
    return joined.select(*[rows[c] for c in df.columns], F.col("_count").alias(out))


def limit_breaches(df: DataFrame, key: str, ts: str, limit: int, secs: int) -> DataFrame:
    """Keys that go over ``limit`` rows in a sliding window: the first such row's time, the number of
    rows beyond the limit, and the highest count. A declarative reading of the log; nothing is
    replayed, so rows that a limiter would have turned away count as well."""
    over = trailing_count(df.select(key, ts), key, ts, secs, "_hits").filter(F.col("_hits") > limit)
    return over.groupBy(key).agg(F.min(ts).alias("first_breach"), F.count("*").alias("breaches"), F.max("_hits").alias("most"))


def peak_concurrency(
    df: DataFrame, key: str, start: str, end: str, slice_seconds: int = 3_600
) -> DataFrame:
    """Most requests in flight at once per key; a release at the same instant comes first.

    Within a slice a running sum is taken; what is open at its beginning comes from the
    net change of the slices before it.
    """
    changes = df.select(F.col(key).alias("_key"), F.explode(F.array(
        F.struct(micros(F.col(start)).alias("us"), F.lit(1).alias("delta")),
        F.struct(micros(F.col(end)).alias("us"), F.lit(-1).alias("delta")),
    )).alias("c")).select("_key", "c.*").filter(F.col("us").isNotNull())
    # Changes at one instant fold to one row per direction.
    folded = changes.groupBy("_key", "us", "delta").agg(F.sum("delta").alias("d"))
    in_flight = running_sum(
        folded, ["_key"], F.floor(F.col("us") / (slice_seconds * SECOND)),
        [F.col("us"), F.col("delta")], F.col("d"), "live",
    )
    peak = F.greatest(F.max("live"), F.lit(0).cast("long"))
    return in_flight.groupBy(F.col("_key").alias(key)).agg(peak.alias("peak"))


# --------------------------------------------------------------- limiter replay


@dataclass(frozen=True)
class Limit:
    """At most ``limit`` stored hits per key in a sliding window of ``seconds``."""

    name: str
    key: Column
    limit: int
    seconds: int
    reason: str


def default_limits(
    per_user: int = 120, per_ip: int = 240, per_user_day: int = 2_000, per_group: int = 500
) -> list[Limit]:
    """The four windows in the order in which a request passes them."""
    group = F.coalesce(F.try_element_at("groups", F.lit(1)), F.lit(ANONYMOUS))
    return [
        Limit("user_minute", F.col("user_id"), per_user, 60, "Per-user minute limit exceeded."),
        Limit("ip_minute", F.col("ip"), per_ip, 60, "Per-IP minute limit exceeded."),
        Limit("user_day", F.col("user_id"), per_user_day, 86_400, "Daily user limit exceeded."),
        Limit("group_minute", group, per_group, 60, "Group limit exceeded: "),
    ]


def _busy_plan(rows: DataFrame, limit: int, width: int) -> DataFrame:
    """Which (key, bucket) pairs need a replay, and in which run.

    Buckets are one window wide, so a window reaches into its own bucket and the one
    before. Where the two hold no more rows than the limit, every row of the bucket is
    stored, whatever came before: the bucket is calm. A run is a maximal sequence of
    adjacent busy buckets; it begins with a state that is known, namely the rows of the
    calm bucket before it (``lead_in``) or nothing. A pause longer than the window parts
    two neighbouring buckets as well.
    """
    sizes = rows.groupBy("_key", "_b").agg(
        F.count("*").alias("_n"), F.min("_us").alias("_first"), F.max("_us").alias("_last")
    )
    w = Window.partitionBy("_key").orderBy("_b")
    adjacent = F.coalesce(F.col("_first") - F.lag("_last").over(w) <= width, F.lit(False))
    followed = F.coalesce(F.lead("_first").over(w) - F.col("_last") <= width, F.lit(False))
    before = F.when(adjacent, F.lag("_n").over(w)).otherwise(0)
    marked = sizes.select(
        "_key", "_b", adjacent.alias("_adj"), followed.alias("_followed"),
        (before + F.col("_n") > limit).alias("_busy"),
        F.lead("_b").over(w).alias("_next"),
    )
    starts = F.col("_busy") & ~(F.col("_adj") & F.coalesce(F.lag("_busy").over(w), F.lit(False)))
    run = F.last(F.when(starts, F.col("_b")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    next_busy = F.col("_followed") & F.coalesce(F.lead("_busy").over(w), F.lit(False))
    runs = marked.select(
        "_key", "_b", "_busy",
        F.when(F.col("_busy"), run).when(next_busy, F.col("_next")).alias("_run"),
    )
    return runs.filter(F.col("_run").isNotNull())


def _replay(slots: DataFrame, limit: int, width: int) -> DataFrame:
    """Replay runs in time order; each task streams its rows and holds one window of them."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stored, live = None, deque(), 0
        for b in batches:
            taken = []
            columns = (b["_key"], b["_run"], b["_us"], b["_n"], b["_lead_in"])
            for key, run, us, n, lead_in in zip(*[c.tolist() for c in columns], strict=True):
                if (key, run) != current:
                    current, stored, live = (key, run), deque(), 0
                while stored and stored[0][0] < us - width:
                    live -= stored.popleft()[1]
                take = n if lead_in else min(n, max(0, limit - live))
                if take:
                    stored.append((us, take))
                    live += take
                taken.append(take)
            out = b[["_key", "_us"]].assign(_take=taken)
            yield out[(~b["_lead_in"].astype(bool)) & (out["_take"] > 0)]

    key_type = slots.schema["_key"].dataType
    schema = T.StructType([
        T.StructField("_key", key_type), T.StructField("_us", T.LongType()),
        T.StructField("_take", T.LongType()),
    ])
    ordered = slots.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_us")
    return ordered.mapInPandas(stream, schema)


def _pass_limit(rows: DataFrame, rule: Limit) -> DataFrame:
    """Rows of ``rows`` (_id, _us and the key columns) that the rule lets through.

    Calm buckets stay in Spark expressions. Only busy runs are replayed, folded to one
    row per instant; rows of one instant are told apart by their id afterwards.
    """
    width = rule.seconds * SECOND
    keyed = rows.withColumn("_key", rule.key.cast("string")).withColumn(
        "_b", F.floor(F.col("_us") / width)
    )
    keyed = keyed.withColumn("_key", F.coalesce("_key", F.lit("")))
    plan = materialize(_busy_plan(keyed.select("_key", "_b", "_us"), rule.limit, width), f"busy-{rule.name}")
    placed = keyed.join(plan, ["_key", "_b"], "left")
    calm = placed.filter(~F.coalesce("_busy", F.lit(False))).select(*rows.columns)
    # Both sides of a run: its busy rows, and the lead-in that sets its first state.
    slots = placed.filter(F.col("_run").isNotNull()).groupBy("_key", "_run", "_us").agg(
        F.count("*").alias("_n"), F.first(~F.col("_busy")).alias("_lead_in")
    )
    taken = _replay(slots, rule.limit, width)
    busy = placed.filter("_busy").select("_key", *rows.columns)
    w = Window.partitionBy("_key", "_us").orderBy("_id")
    ranked = busy.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rule.limit)
    stored = ranked.join(taken, ["_key", "_us"]).filter(F.col("_rn") <= F.col("_take"))
    return calm.unionByName(stored.select(*rows.columns))


def rate_limit_replay(
    df: DataFrame, limits: Sequence[Limit] | None = None, id_col: str = "request_id", ts: str = "ts"
) -> DataFrame:
    """Replay a sliding-window limiter over a request log: adds ``allowed`` and ``reason``.

    A request passes the windows in order. Each keeps the hits of its trailing window,
    both ends included, and rejects a request when they have reached the limit. A
    rejected hit is not stored; hits stored by the windows before it stay. So the rows a
    window sees are those the window before let through, and replaying window by window
    is exact. Requests of one instant go by id.

    A request may name at most one group: several groups would couple the windows of
    different keys. More than one raises an error.
    """
    limits = default_limits() if limits is None else list(limits)
    keys = [c for c in df.columns if c not in (id_col, ts)]
    rows = df.select(F.col(id_col).alias("_id"), micros(F.col(ts)).alias("_us"), *keys)
    if "groups" in keys:
        single = F.when(F.size("groups") <= 1, F.col("groups")).when(
            F.col("groups").isNull(), F.col("groups")
        ).otherwise(F.raise_error(F.lit("a request may name one group at most")))
        rows = rows.withColumn("groups", single)
    passed: list[DataFrame] = []
    for rule in limits:
        rows = materialize(_pass_limit(rows, rule), f"passed-{rule.name}")
        passed.append(rows.select("_id"))
    levels = passed[0]
    for p in passed[1:]:
        levels = levels.unionByName(p)
    levels = levels.groupBy("_id").agg(F.count("*").alias("_level"))
    out = df.join(levels, df[id_col] == levels["_id"], "left")
    level = F.coalesce("_level", F.lit(0))
    reason = F.lit(None).cast("string")
    for i, rule in enumerate(limits):
        text = F.lit(rule.reason)
        if rule.name.startswith("group"):
            text = F.concat(text, rule.key.cast("string"))
        reason = F.when(level == i, text).otherwise(reason)
    return out.select(
        *[df[c] for c in df.columns], (level == len(limits)).alias("allowed"), reason.alias("reason")
    )
