"""Governance over results and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.payload import json_safe, redact_payload
from tallyhouse.functions.text import extract_terms, parse_groups
from tallyhouse.operators import aggregates as A
from tallyhouse.operators import governance as G
from tallyhouse.operators import limits as L
from tallyhouse.plans.registry import query
from tallyhouse.plans.retail import REV_SQL, orders_with_totals

POLICY = G.Policy(
    blocked_tables=("labels",),
    blocked_schemas=("staging",),
    pii_columns=("customer.c_acctbal", "Supplier.s_acctbal"),
    sensitive_columns=("lineitem.l_tax",),
    masking_rules=(
        G.MaskingRule("Customer.c_name", "hash", ("analyst",)),
        G.MaskingRule("customer.contact", "partial", ("analyst",)),
        G.MaskingRule("c_mktsegment", "redact", ("analyst",)),
    ),
    row_filters=(
        G.RowFilter("orders", "o_orderdate >= timestamp_ntz'1996-01-01'", ("finance",)),
        G.RowFilter("lineitem", "l_quantity > 5", ("finance",)),
    ),
    access_groups=(
        G.AccessGroup(
            "analyst", ("customer", "orders", "lineitem", "part"), ("customer.c_mktsegment",)
        ),
        G.AccessGroup("finance", ("customer", "orders", "lineitem"), ()),
    ),
    min_group_size=3,
    max_rows=10_000,
)
GROUPS = ("analyst", "finance")


def _hash_sql(c: str) -> str:
    return f"'[HASH:' || substr(sha256({c}), 1, 12) || ']'"


def top_customers(t) -> DataFrame:
    """Best customers by revenue, with the number of orders behind each figure."""
    metrics = {"total_revenue": F.sum("subtotal"), "n": F.count("o_orderkey")}
    per_key = A.metrics_by(orders_with_totals(t), ["o_custkey"], metrics)
    named = per_key.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = named.select("c_name", "c_mktsegment", F.col("total_revenue").cast("double").alias("total_revenue"), "n")
    return L.top_n(rows, "total_revenue", 10, ["c_name"])


@query(
    "governed_top_customers",
    f"SELECT {_hash_sql('c_name')} AS c_name, '[REDACTED]' AS c_mktsegment, total_revenue, n FROM ("
    f"SELECT c_name, c_mktsegment, CAST(SUM({REV_SQL}) AS DOUBLE) AS total_revenue, COUNT(DISTINCT o_orderkey) AS n "
    "FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey "
    "WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND l_quantity > 5 GROUP BY c_custkey, c_name, c_mktsegment "
    "ORDER BY total_revenue DESC, c_name LIMIT 10) x WHERE n >= 3",
)
def governed_top_customers(t):
    return G.governed_result(t, POLICY, GROUPS, top_customers).rows


@query(
    "governed_status",
    "SELECT LEAST(COUNT(*), 10000) AS row_count, COUNT(*) >= 10000 AS truncated FROM lineitem JOIN orders "
    "ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND l_quantity > 5",
)
def governed_status(t):
    def lines(seen):
        return seen["lineitem"].join(seen["orders"], F.col("l_orderkey") == F.col("o_orderkey"))

    return G.governed_result(t, POLICY, GROUPS, lines).status()


@query("mask_redact", "SELECT c_custkey, CASE WHEN c_mktsegment IS NOT NULL THEN '[REDACTED]' END AS c_mktsegment FROM customer")
def mask_redact(t):
    return t["customer"].select("c_custkey", G.mask_redact(F.col("c_mktsegment")).alias("c_mktsegment"))


@query(
    "mask_partial",
    r"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '\S+@\S+') AND strpos(text, '@') > 1 "
    "THEN substr(text, 1, 1) || '***@' || substr(text, strpos(text, '@') + 1) ELSE '***' END AS text FROM documents",
)
def mask_partial(t):
    return t.spread("documents").select("doc_id", G.mask_partial(F.col("text")).alias("text"))


@query("mask_hash", f"SELECT doc_id, {_hash_sql('text')} AS text FROM documents")
def mask_hash(t):
    return t.spread("documents").select("doc_id", G.mask_hash(F.col("text")).alias("text"))


@query(
    "apply_masking_rules",
    f"SELECT c_custkey, {_hash_sql('c_name')} AS c_name, 'C***@' || substr(c_name, 10) || '.example' AS contact, "
    "'[REDACTED]' AS c_mktsegment FROM customer",
)
def apply_masking_rules(t):
    contact = F.concat("c_name", F.lit("@"), F.substring("c_name", 10, 20), F.lit(".example"))
    rows = t["customer"].select("c_custkey", "c_name", contact.alias("contact"), "c_mktsegment")
    return G.apply_masking_rules(rows, POLICY.masking_rules, GROUPS)


@query(
    "min_group_size",
    "SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING COUNT(*) >= 12",
)
def min_group_size(t):
    counts = t["events"].groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return G.min_group_size(counts, 12, GROUPS)


@query(
    "row_filter",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'",
)
def row_filter(t):
    rows = G.row_filter(t["orders"], "orders", POLICY.row_filters, GROUPS)
    return rows.select("o_orderkey", "o_custkey")


@query(
    "column_tiers",
    "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
)
def column_tiers(t):
    return G.restrict_columns(t["supplier"], "supplier", POLICY, GROUPS)


@query(
    "column_tiers_reader",
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
)
def column_tiers_reader(t):
    return G.restrict_columns(t["supplier"], "supplier", POLICY, ("pii_reader",))


_WORDS_SQL = (
    r"SELECT DISTINCT lower(w) AS column_name FROM (SELECT unnest(regexp_extract_all(text, "
    r"'[\p{L}\p{N}_\x{0600}-\x{06FF}]+')) AS w FROM documents) x WHERE length(w) >= 2"
)


@query(
    "classify_columns",
    f"SELECT column_name, CASE WHEN regexp_matches(p, '{'|'.join(G.SECRET_NAME_PARTS)}') THEN 'secret' "
    f"WHEN regexp_matches(p, '{'|'.join(G.PII_NAME_PARTS)}') THEN 'pii' ELSE 'none' END AS category FROM "
    f"(SELECT column_name, replace(column_name, '_', '') AS p FROM ({_WORDS_SQL}) w) x",
)
def classify_columns(t):
    names = t.spread("documents").select(F.explode(extract_terms(F.col("text"))).alias("column_name"))
    return G.classify_columns(names.distinct())


@query(
    "govern_catalog",
    "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey "
    "WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND l_quantity > 5",
)
def govern_catalog(t):
    opened = {"main.orders": t["orders"], "main.lineitem": t["lineitem"], "staging.part": t["part"], "labels": t["labels"]}
    views = G.govern_catalog(t.spark, opened, POLICY, GROUPS)
    if list(views) != ["main.orders", "main.lineitem"]:
        raise G.AccessDenied(str(views))
    return t.spark.sql(
        f"SELECT o_orderkey, l_linenumber, l_quantity FROM {views['main.orders']} JOIN {views['main.lineitem']} ON o_orderkey = l_orderkey"
    )


@query("group_scope", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def group_scope(t):
    return G.scope(t, POLICY, ("analyst",))["customer"]


@query(
    "key_audit",
    "SELECT CAST(SUM(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS nulls, COUNT(*) FILTER (WHERE n > 1) AS duplicates FROM "
    "(SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) x",
)
def key_audit(t):
    return G.key_audit(t["lineitem"], ["l_orderkey", "l_linenumber"])


_CATALOG_SQL = "SELECT DISTINCT user_id, event_type FROM events WHERE value > 30"


@query(
    "catalog_lint",
    f"WITH cat AS ({_CATALOG_SQL}) SELECT event_id AS ref_id, CAST(user_id AS VARCHAR) AS table_name, event_type AS column_name, "
    "CASE WHEN user_id NOT IN (SELECT user_id FROM cat) THEN 'REL001' ELSE 'REL002' END AS code, 'error' AS severity "
    "FROM events e WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.user_id = e.user_id AND c.event_type = e.event_type)",
)
def catalog_lint(t):
    user = F.col("user_id").cast("string").alias("table_name")
    name = F.col("event_type").alias("column_name")
    refs = t["events"].select(
        F.col("event_id").alias("ref_id"), user, name, F.lit("REL001").alias("table_code"),
        F.lit("REL002").alias("column_code"), F.lit("error").alias("severity"),
    )
    return G.catalog_lint(refs, t["events"].filter(F.col("value") > 30).select(user, name))


@query(
    "duplicate_ids",
    "SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS ref_id, COUNT(*) AS occurrences, "
    "'EX001' AS code, 'error' AS severity FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1",
)
def duplicate_ids(t):
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return G.duplicate_ids(t["lineitem"].select(key.alias("id")), "id", "EX001")


@query(
    "json_safe",
    "SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, "
    "CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) AS amount, base64(CAST(event_type AS BLOB)) AS raw, "
    "strftime(ts, '%Y-%m-%d') AS day FROM events",
)
def json_safe_q(t):
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return json_safe(t["events"].select(
        "event_id", "ts", value.alias("value"), F.col("value").cast("decimal(10,2)").alias("amount"),
        F.col("event_type").cast("binary").alias("raw"), F.to_date("ts").alias("day"),
    ))


@query(
    "redact_payload",
    "SELECT event_id, '[REDACTED]' AS token, sha256('SELECT value FROM events WHERE event_id = ' || event_id) AS sql_hash, "
    "'[REDACTED_SQL]' AS args_sql, event_type AS args_x, '[REDACTED]' AS item_password, user_id AS item_y, "
    "sha256(event_type) AS extra_hash, '[REDACTED_SQL]' AS extra_sql, props AS extra_note FROM events",
)
def redact_payload_q(t):
    sql = F.concat(F.lit("SELECT value FROM events WHERE event_id = "), F.col("event_id").cast("string"))
    nested = t.spread("events").select(
        "event_id", F.col("props").alias("token"),
        F.struct(sql.alias("sql"), F.col("event_type").alias("x")).alias("args"),
        F.array(F.struct(F.col("props").alias("password"), F.col("user_id").alias("y"))).alias("items"),
        F.create_map(F.lit("SQL"), "event_type", F.lit("note"), "props").alias("extra"),
    )
    clean = redact_payload(nested)
    return clean.select(
        "event_id", "token", "args.sql_hash", F.col("args.sql").alias("args_sql"),
        F.col("args.x").alias("args_x"), F.col("items")[0]["password"].alias("item_password"),
        F.col("items")[0]["y"].alias("item_y"), F.col("extra")["sql_hash"].alias("extra_hash"),
        F.col("extra")["SQL"].alias("extra_sql"), F.col("extra")["note"].alias("extra_note"),
    )


@query(
    "parse_groups",
    "SELECT doc_id, lang || '|' || source AS groups FROM documents",
)
def parse_groups_q(t):
    raw = F.concat(F.col("lang"), F.lit(" , Admin,,"), F.col("source"), F.lit(",root "))
    return t.spread("documents").select("doc_id", F.array_join(parse_groups(raw), "|").alias("groups"))
