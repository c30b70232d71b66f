"""Evaluation of a question set made from the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import extract_terms
from tallyhouse.operators import evaluation as M
from tallyhouse.plans.registry import query
from tallyhouse.plans.texts import terms_sql
from tallyhouse.sources.collections import write_report
from tallyhouse.session import work_folder

import uuid


def items(t) -> DataFrame:
    """One item per turn: the next turn is its SQL, its own terms are the tables it requires."""
    q = t.spread("conversations").select("conv_id", "turn", "role", "text")
    a = t.spread("conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sql"))
    return q.join(a, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("question_en"),
        F.when(F.col("role") != "assistant", F.col("role")).alias("question_ar"),
        "sql",
        extract_terms(F.col("text")).alias("required_tables"),
        F.coalesce(extract_terms(F.col("sql")), F.array().cast("array<string>")).alias("tables"),
        (F.col("role") == "system").alias("must_reject"),
    )


ITEMS_SQL = f"""
WITH i AS (SELECT c.conv_id || '-' || c.turn AS id, c.text AS question_en, CASE WHEN c.role <> 'assistant' THEN c.role END AS question_ar,
  p.text AS sql, {terms_sql('c.text')} AS required_tables, coalesce({terms_sql('p.text')}, []) AS tables, c.role = 'system' AS must_reject
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn + 1),
k AS (SELECT *, length(trim(coalesce(sql, ''))) = 0 AS no_sql, question_ar IS NOT NULL AS both_langs FROM i),
known AS (SELECT DISTINCT unnest({terms_sql('text')}) AS name FROM documents),
bad AS (SELECT id, list(DISTINCT name ORDER BY name) AS bad FROM (SELECT id, unnest(tables) AS name FROM k) ANTI JOIN known USING (name) GROUP BY 1),
lost AS (SELECT id, list(DISTINCT name ORDER BY name) AS lost FROM (SELECT id, unnest(required_tables) AS name FROM k) ANTI JOIN known USING (name) GROUP BY 1),
c AS (SELECT *, both_langs AS bn008, CASE WHEN no_sql AND must_reject THEN TRUE END AS bn011, bn009_ AS bn009,
  CASE WHEN NOT no_sql AND NOT must_reject THEN bad IS NULL END AS bn002,
  CASE WHEN NOT no_sql AND len(required_tables) > 0 THEN len(list_intersect(required_tables, tables)) > 0 OR len(tables) = 0 END AS bn006,
  CASE WHEN NOT no_sql AND len(required_tables) >= 2 AND NOT must_reject THEN len(tables) >= 2 AND
    (contains(lower(coalesce(sql, '')), 'join') OR len(tables) >= len(required_tables)) END AS bn007,
  bn009_ IS NULL AND lost IS NULL AND (no_sql OR must_reject OR bad IS NULL) AS ok
  FROM (SELECT *, CASE WHEN no_sql AND NOT must_reject THEN FALSE END AS bn009_ FROM k LEFT JOIN bad USING (id) LEFT JOIN lost USING (id)))
"""


def checked(t) -> DataFrame:
    """Items with the checks on their texts."""
    return M.text_presence(items(t))


def fully_checked(t) -> DataFrame:
    """Items with all their checks; the terms of the documents are the schema."""
    known = t.spread("documents").select(F.explode(extract_terms(F.col("text"))).alias("name"))
    return M.sql_checks(checked(t), known)


@query(
    "missing_references",
    f"SELECT c.conv_id, c.turn, w AS term FROM (SELECT conv_id, turn, unnest({terms_sql('text')}) AS w FROM conversations) c "
    f"WHERE w NOT IN (SELECT unnest({terms_sql('text')}) FROM documents)",
)
def missing_references(t):
    term = F.explode(extract_terms(F.col("text"))).alias("term")
    refs = t.spread("conversations").select("conv_id", "turn", term)
    return M.missing_references(refs, t.spread("documents").select(term), ["term"]).select("conv_id", "turn", "term")


@query(
    "required_overlap",
    ITEMS_SQL
    + "SELECT id, CASE WHEN len(required_tables) > 0 THEN len(list_intersect(required_tables, tables)) > 0 OR len(tables) = 0 END AS overlap_ok, "
    "CASE WHEN len(required_tables) >= 2 AND NOT must_reject THEN len(tables) >= 2 AND "
    "(contains(lower(coalesce(sql, '')), 'join') OR len(tables) >= len(required_tables)) END AS join_ok FROM c",
)
def required_overlap(t):
    rows = items(t).withColumn("sql", F.coalesce("sql", F.lit("")))
    return M.required_overlap(rows).select("id", "overlap_ok", "join_ok")


@query(
    "text_presence",
    ITEMS_SQL + "SELECT id, CASE WHEN bn008 THEN 'BN008:info:true' ELSE 'BN008:warning:false' END || CASE WHEN bn011 THEN ',BN011:info:true' "
    "WHEN bn009 IS NOT NULL THEN ',BN009:error:false' ELSE '' END AS checks FROM c",
)
def text_presence(t):
    shown = F.transform("checks", lambda c: F.concat_ws(":", c["code"], c["severity"], c["passed"].cast("string")))
    return checked(t).select("id", F.array_join(shown, ",").alias("checks"))


@query("item_passed", ITEMS_SQL + "SELECT id, ok AS passed FROM c")
def item_passed(t):
    return M.item_passed(fully_checked(t)).select("id", "passed")


SUMMARY_SQL = (
    ITEMS_SQL + "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE ok) AS passed, COUNT(*) FILTER (WHERE NOT ok) AS failed, "
    "COUNT(*) FILTER (WHERE NOT bn008) + COUNT(*) FILTER (WHERE NOT bn006) + COUNT(*) FILTER (WHERE NOT bn007) AS warnings FROM c"
)


@query("benchmark_summary", SUMMARY_SQL)
def benchmark_summary(t):
    return M.benchmark_summary(fully_checked(t))


FAILURES_SQL = (
    ITEMS_SQL + "SELECT id, 'BN009' AS code, 'error' AS severity, '' AS message FROM c WHERE bn009 IS NOT NULL UNION ALL "
    "SELECT id, 'BN008', 'warning', '' FROM c WHERE NOT ok AND NOT bn008 UNION ALL "
    "SELECT id, 'BN010', 'error', unnest(lost) FROM c WHERE lost IS NOT NULL UNION ALL "
    "SELECT id, 'BN002', 'error', array_to_string(bad, ', ') FROM c WHERE NOT bn002 UNION ALL "
    "SELECT id, 'BN006', 'warning', '' FROM c WHERE NOT ok AND NOT bn006 UNION ALL "
    "SELECT id, 'BN007', 'warning', '' FROM c WHERE NOT ok AND NOT bn007"
)


@query(
    "failures_report",
    FAILURES_SQL,
)
def failures_report(t):
    return M.failures(fully_checked(t))


@query("write_report", SUMMARY_SQL)
def report_round_trip(t):
    """The summary after the report was written and read back."""
    path = f"{work_folder(t.spark)}/report-{uuid.uuid4().hex}"
    write_report(M.benchmark_summary(fully_checked(t)), M.failures(fully_checked(t)), path)
    schema = "total BIGINT, passed BIGINT, failed BIGINT, warnings BIGINT"
    return t.spark.read.schema(schema).json(f"{path}/summary")


@query("write_report_items", FAILURES_SQL)
def report_items_round_trip(t):
    """The failed checks after the report was written and read back."""
    path = f"{work_folder(t.spark)}/report-{uuid.uuid4().hex}"
    rows = fully_checked(t)
    write_report(M.benchmark_summary(rows), M.failures(rows), path)
    schema = "id STRING, code STRING, severity STRING, message STRING"
    return t.spark.read.schema(schema).json(f"{path}/results")
