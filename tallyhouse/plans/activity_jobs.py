"""Audit, limiter and streaming jobs over logs made from the events and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import activity as E
from tallyhouse.operators import retrieval as RT
from tallyhouse.operators import screening as S
from tallyhouse.plans.registry import query
from tallyhouse.plans.texts import INJECTION_SQL, sql_log
from tallyhouse.session import work_folder
from tallyhouse.sources.audit_log import AUDIT_SCHEMA, read_audit, write_audit
from tallyhouse.sources.tables import read_table_stream
from tallyhouse.streaming import jobs as ST

# The audit log of the events: a statement that the screening objects to is rejected.
CODES_SQL = (
    "CASE event_type WHEN 'view' THEN [] WHEN 'click' THEN ['POL001'] WHEN 'signup' THEN ['POL004', 'POL014'] "
    "WHEN 'error' THEN ['POL010', 'POL005'] ELSE CASE WHEN value > 10 THEN ['POL014'] ELSE ['POL009'] END END"
)


def audit(t) -> DataFrame:
    """One audit record per event, out of the screened SQL log."""
    rows = S.screen_sql_log(sql_log(t), "sql")
    violation = lambda c: F.struct(
        c.alias("code"), F.lit("error").alias("severity"), F.lit("").alias("message")
    )
    return rows.select(
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.lit("tool").alias("kind"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("allowed"), "allowed").otherwise("rejected").alias("decision"),
        F.transform("codes", violation).alias("violations"),
        F.when(F.col("event_type") == "error", "runner").alias("error_code"),
        F.when(F.col("allowed"), F.floor("value")).alias("row_count"),
        F.col("value").alias("duration_ms"),
    )


ROLLUP_SQL = (
    f"SELECT 'tool' AS kind, CASE WHEN len({CODES_SQL}) = 0 THEN 'allowed' ELSE 'rejected' END AS decision, "
    "CASE WHEN event_type = 'error' THEN 'runner' END AS error_code, COUNT(*) AS records, "
    f"CAST(SUM(CASE WHEN len({CODES_SQL}) = 0 THEN CAST(floor(value) AS BIGINT) END) AS BIGINT) AS rows_returned, "
    "ROUND(AVG(value), 6) AS avg_duration_ms, MAX(value) AS max_duration_ms FROM events GROUP BY 1, 2, 3"
)


@query("audit_rollup", ROLLUP_SQL)
def audit_rollup(t):
    return rounded(E.audit_rollup(audit(t)))


def rounded(rollup: DataFrame) -> DataFrame:
    """The mean as it is compared with other engines, which add in another order."""
    return rollup.withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query("audit_round_trip", ROLLUP_SQL)
def audit_round_trip(t):
    """The same figures after the log was written as JSON lines and read back."""
    path = f"{work_folder(t.spark)}/audit-{uuid.uuid4().hex}"
    write_audit(audit(t), path)
    return rounded(E.audit_rollup(read_audit(t.spark, path, AUDIT_SCHEMA)))


@query(
    "violations_explode",
    f"SELECT code, 'error' AS severity, COUNT(*) AS violations, COUNT(DISTINCT event_id) AS requests FROM "
    f"(SELECT event_id, unnest({CODES_SQL}) AS code FROM events) x GROUP BY 1",
)
def violations_explode(t):
    return E.violations(audit(t))


PHASES_SQL = (
    "SELECT event_id AS request_id, CAST(floor(value) AS BIGINT) AS intent_ms, CAST(user_id AS BIGINT) AS context_ms, CAST(NULL AS BIGINT) AS llm_ms, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS sql_ms, CAST(0 AS BIGINT) AS present_ms, CAST(floor(value) AS BIGINT) + user_id + "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_ms FROM events"
)


@query("phase_timings", PHASES_SQL)
def phase_timings(t):
    return E.phase_timings(timed_events(t))


def timed_events(t) -> DataFrame:
    """Events with a timings text; phases out of the value, user and payload."""
    k = F.get_json_object("props", "$.k")
    v = F.floor("value")
    parts = {
        "intent_ms": v, "context_ms": F.col("user_id"), "sql_ms": k.cast("long"), "present_ms": F.lit(0),
        "total_ms": v + F.col("user_id") + k.cast("long"),
    }
    text = F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))
    return t.spread("events").select(F.col("event_id").alias("request_id"), text.alias("timings_json"))


@query(
    "phase_summary",
    f"SELECT phase, COUNT(ms) AS requests, AVG(ms) AS mean_ms FROM (UNPIVOT ({PHASES_SQL}) ON intent_ms, context_ms, llm_ms, "
    "sql_ms, present_ms, total_ms INTO NAME phase VALUE ms) u GROUP BY 1",
)
def phase_summary(t):
    """Counts and means; the percentiles have a query of their own."""
    return E.phase_summary(E.phase_timings(timed_events(t))).select("phase", "requests", "mean_ms")


@query(
    "phase_percentiles",
    f"WITH u AS (UNPIVOT ({PHASES_SQL}) ON intent_ms, context_ms, llm_ms, sql_ms, present_ms, total_ms INTO NAME phase VALUE ms) "
    "SELECT phase, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms FROM u GROUP BY 1",
)
def phase_percentiles(t):
    summary = E.phase_summary(E.phase_timings(timed_events(t)))
    return summary.select("phase", "p50_ms", "p95_ms")


def lifecycle_events(t) -> DataFrame:
    """Started and finished events of the same request: one per user and payload."""
    status = (
        F.when(F.col("event_type").isin("view", "signup"), "started")
        .when(F.col("event_type") == "error", "error").otherwise("success")
    )
    return t["events"].select(
        F.concat_ws("/", F.col("user_id").cast("string"), "props").alias("request_id"), "ts",
        status.alias("status"), F.floor("value").alias("row_count"),
        F.when(F.col("event_type") == "error", "RunnerError").alias("error_type"),
    )


@query(
    "request_lifecycle",
    "WITH e AS (SELECT user_id || '/' || props AS request_id, ts, CASE WHEN event_type IN ('view', 'signup') THEN 'started' "
    "WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, CAST(floor(value) AS BIGINT) AS row_count FROM events), "
    "g AS (SELECT request_id, MIN(CASE WHEN status = 'started' THEN ts END) AS a, MAX(CASE WHEN status <> 'started' THEN ts END) AS b, "
    "arg_max(status, CASE WHEN status <> 'started' THEN ts END) AS o, MAX(row_count) AS row_count, "
    "MAX(CASE WHEN status = 'error' THEN 'RunnerError' END) AS error_type FROM e GROUP BY 1) "
    "SELECT request_id, CASE WHEN b IS NULL THEN 'open' ELSE o END AS outcome, row_count, error_type, "
    "CAST(floor((epoch_us(b) - epoch_us(a)) / 1000) AS BIGINT) AS duration_ms FROM g",
)
def request_lifecycle(t):
    return E.request_lifecycle(lifecycle_events(t)).drop("started_at", "ended_at")


@query(
    "learned_pairs",
    "SELECT 'auto:' || substr(md5('shop:' || c.text || ':' || q.sql), 1, 16) AS id, 'Question: ' || c.text || chr(10) || 'SQL: ' || q.sql AS document, "
    "'auto_learned' AS kind, MAX(q.k) AS row_count FROM (SELECT user_id, event_type, 'SELECT value FROM events WHERE event_type = ''' || event_type || '''' AS sql, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) q JOIN conversations c ON c.conv_id = q.user_id AND c.turn = 0 "
    "WHERE q.event_type NOT IN ('error', 'view') AND q.k > 0 AND length(trim(c.text)) >= 3 GROUP BY 1, 2, 3",
)
def learned_pairs(t):
    sql = F.concat(F.lit("SELECT value FROM events WHERE event_type = '"), "event_type", F.lit("'"))
    status = (
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "started")
        .otherwise("success")
    )
    events = t["events"].select(
        "user_id", status.alias("status"), sql.alias("executed_sql"),
        F.get_json_object("props", "$.k").cast("long").alias("row_count"),
    )
    first = t["conversations"].filter(F.col("turn") == 0).select(
        F.col("conv_id").alias("user_id"), F.col("text").alias("question")
    )
    return RT.learned_pairs(events.join(first, "user_id"), "shop")


@query(
    "trailing_window_count",
    "SELECT a.event_id, COUNT(*) AS trailing FROM events a JOIN events b ON a.user_id = b.user_id AND "
    "epoch_us(b.ts) <= epoch_us(a.ts) AND epoch_us(b.ts) >= epoch_us(a.ts) - 86400000000 GROUP BY 1",
)
def trailing_window_count(t):
    rows = t["events"].select("event_id", "user_id", "ts")
    return E.trailing_count(rows, "user_id", "ts", 86_400).select("event_id", "trailing")


@query(
    "limit_breaches",
    "WITH h AS (SELECT a.user_id, a.event_id, ANY_VALUE(a.ts) AS ts, COUNT(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id "
    "AND epoch_us(b.ts) <= epoch_us(a.ts) AND epoch_us(b.ts) >= epoch_us(a.ts) - 86400000000 GROUP BY 1, 2) "
    "SELECT user_id, MIN(ts) AS first_breach, COUNT(*) AS breaches, MAX(n) AS most FROM h WHERE n > 3 GROUP BY 1",
)
def limit_breaches(t):
    """Users that go over three events within a day."""
    return E.limit_breaches(t["events"].select("user_id", "ts"), "user_id", "ts", 3, 86_400)


@query(
    "concurrency_peak",
    "WITH c AS (SELECT user_id, epoch_us(ts) AS us, 1 AS d FROM events UNION ALL SELECT user_id, epoch_us(ts) + "
    "CAST(round(value * 1000) AS BIGINT) * 1000000, -1 FROM events) SELECT user_id, CAST(MAX(r) AS BIGINT) AS peak FROM (SELECT user_id, "
    "SUM(d) OVER (PARTITION BY user_id ORDER BY us, d ROWS UNBOUNDED PRECEDING) AS r FROM c) x GROUP BY 1",
)
def concurrency_peak(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    end = F.timestamp_micros(us + F.round(F.col("value") * 1000).cast("long") * 1_000_000)
    rows = t["events"].select("user_id", F.col("ts").cast("timestamp").alias("start"), end.alias("end"))
    return E.peak_concurrency(rows, "user_id", "start", "end").withColumn("peak", F.col("peak").cast("long"))


def requests(t) -> DataFrame:
    """Events as a request log; the event type stands for the group, a payload for the address."""
    return t["events"].select(
        F.col("event_id").alias("request_id"), "ts", F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("ip"), F.array("event_type").alias("groups"),
    )


def _stage_sql(i: int, key: str, limit: int, seconds: int) -> str:
    """One window of the chain: rows in time order per key, carrying the stored hits."""
    live = f"[h for h in r.hits if h >= o.us - {seconds * 1_000_000}]"
    return f"""
o{i} AS (SELECT *, {key} AS k, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY us, event_id) AS rn FROM p{i - 1}),
r{i} AS (SELECT k, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS hits, CAST(NULL AS BIGINT) AS event_id, FALSE AS ok FROM (SELECT DISTINCT k FROM o{i}) d
  UNION ALL SELECT o.k, o.rn, CASE WHEN len({live}) < {limit} THEN list_append({live}, o.us) ELSE {live} END, o.event_id, len({live}) < {limit}
  FROM r{i} r JOIN o{i} o ON o.k = r.k AND o.rn = r.rn + 1),
p{i} AS (SELECT p.* FROM p{i - 1} p JOIN r{i} r ON r.event_id = p.event_id WHERE r.ok)"""


REPLAY_SQL = (
    "WITH RECURSIVE p0 AS (SELECT event_id, epoch_us(ts) AS us, user_id, json_extract_string(props, '$.k') AS ip, event_type FROM events),"
    + ",".join([
        _stage_sql(1, "user_id", 2, 3_600), _stage_sql(2, "ip", 3, 7_200),
        _stage_sql(3, "user_id", 2, 86_400), _stage_sql(4, "event_type", 40, 86_400),
    ])
    + " SELECT event_id AS request_id, event_id IN (SELECT event_id FROM p4) AS allowed, CASE "
    "WHEN event_id NOT IN (SELECT event_id FROM p1) THEN 'Per-user minute limit exceeded.' "
    "WHEN event_id NOT IN (SELECT event_id FROM p2) THEN 'Per-IP minute limit exceeded.' "
    "WHEN event_id NOT IN (SELECT event_id FROM p3) THEN 'Daily user limit exceeded.' "
    "WHEN event_id NOT IN (SELECT event_id FROM p4) THEN 'Group limit exceeded: ' || event_type END AS reason FROM events"
)


@query("rate_limit_replay", REPLAY_SQL)
def rate_limit_replay(t):
    """The whole chain of windows, with limits that fit a sparse log."""
    group = F.try_element_at("groups", F.lit(1))
    limits = [
        E.Limit("user_hour", F.col("user_id"), 2, 3_600, "Per-user minute limit exceeded."),
        E.Limit("ip_hour", F.col("ip"), 3, 7_200, "Per-IP minute limit exceeded."),
        E.Limit("user_day", F.col("user_id"), 2, 86_400, "Daily user limit exceeded."),
        E.Limit("group_minute", group, 40, 86_400, "Group limit exceeded: "),
    ]
    return E.rate_limit_replay(requests(t), limits).select("request_id", "allowed", "reason")


@query(
    "rate_limit_single",
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, LAG(epoch_us(ts)) OVER w AS p, ROW_NUMBER() OVER w AS rn FROM events "
    "WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)), r AS (SELECT event_id, user_id, us, rn, us AS last_us, TRUE AS allowed FROM e WHERE rn = 1 "
    "UNION ALL SELECT e.event_id, e.user_id, e.us, e.rn, CASE WHEN e.us - r.last_us > 86400000000 THEN e.us ELSE r.last_us END, "
    "e.us - r.last_us > 86400000000 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) "
    "SELECT event_id AS request_id, allowed FROM r",
)
def rate_limit_single(t):
    """One hit per user and day; SQL can state this case by recursion."""
    limits = [E.Limit("user_day", F.col("user_id"), 1, 86_400, "Daily user limit exceeded.")]
    return E.rate_limit_replay(requests(t), limits).select("request_id", "allowed")


# --------------------------------------------------------------------- streaming


def event_stream(t) -> DataFrame:
    return read_table_stream(t.spark, t.folder, "events")


def _places(t, label: str) -> tuple[str, str]:
    root = f"{work_folder(t.spark)}/{label}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


@query(
    "windowed_activity",
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, user_id, COUNT(*) AS requests FROM events GROUP BY 1, 2",
)
def windowed_activity(t):
    """Every window of the log as the stream itself gives it, the last and still open ones too."""
    out, checkpoint = _places(t, "activity")
    windows = ST.windowed_activity(event_stream(t), "1 hour")
    counts = ST.run_to_latest(windows, out, checkpoint, ["window_start", "window_end", "user_id"])
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "user_id", "requests")


@query(
    "rate_limit_stream",
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events), "
    "r AS (SELECT event_id, user_id, us, rn, us AS last_us, TRUE AS allowed FROM e WHERE rn = 1 "
    "UNION ALL SELECT e.event_id, e.user_id, e.us, e.rn, CASE WHEN e.us - r.last_us > 86400000000 THEN e.us ELSE r.last_us END, "
    "e.us - r.last_us > 86400000000 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) "
    "SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS id, allowed FROM r",
)
def rate_limit_stream(t):
    out, checkpoint = _places(t, "limiter")
    stream = ST.rate_limit_stream(event_stream(t), 1, 86_400, id_col="event_id")
    return ST.run_to_table(stream, out, checkpoint).select("key", F.col("id").cast("string").alias("id"), "allowed")


@query(
    "stream_screen",
    f"SELECT conv_id, turn, CASE WHEN regexp_matches(role || ': ' || text, '{INJECTION_SQL}') THEN 'PROMPT_INJECTION' END AS code, "
    f"NOT regexp_matches(role || ': ' || text, '{INJECTION_SQL}') AS allowed, '[REDACTED]' AS token FROM conversations",
)
def stream_screen(t):
    """Messages screened as a stream, then both sinks read back together."""
    out, checkpoint = _places(t, "screen")
    stream = read_table_stream(t.spark, t.folder, "conversations")
    messages = stream.select(
        "conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"), F.col("text").alias("token")
    )
    ST.stream_screen(messages, out, checkpoint, "line").awaitTermination()
    schema = "conv_id BIGINT, turn BIGINT, line STRING, token STRING, code STRING, allowed BOOLEAN"
    read = t.spark.read.schema(schema)
    both = read.parquet(f"{out}/accepted").unionByName(read.parquet(f"{out}/rejected"))
    return both.select("conv_id", "turn", "code", "allowed", "token")
