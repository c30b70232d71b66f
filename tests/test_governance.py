from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import text as X
from tallyhouse.functions.payload import json_safe, redact_payload
from tallyhouse.operators import governance as G


def one(spark, value, kind, groups=("analyst",), rule_groups=("analyst",), column="Customers.V"):
    df = spark.createDataFrame([(value,)], "v string")
    rule = G.MaskingRule(column, kind, rule_groups)
    return G.apply_masking_rules(df, [rule], groups).first()["v"]


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [
        ("Ann", "redact", "[REDACTED]"),
        (None, "redact", None), (None, "partial", None), (None, "hash", None), (None, "other", None),
        ("a@b.c", "partial", "a***@b.c"),
        ("a@b@c", "partial", "a***@b@c"),
        ("@b.c", "partial", "***"),
        ("a @ b", "partial", "***"),
        ("030-1", "partial", "***"),
        ("", "partial", "***"),
        ("abc", "hash", "[HASH:ba7816bf8f01]"),
        ("abc", "other", "[MASKED]"),
    ],
)
def test_masks(spark, value, kind, want):
    assert one(spark, value, kind) == want


def test_mask_scope(spark):
    assert one(spark, "x", "redact", groups=("admin", "analyst")) == "x"
    assert one(spark, "x", "redact", groups=("finance",)) == "x"
    assert one(spark, "x", "redact", groups=("finance",), rule_groups=()) == "[REDACTED]"
    assert one(spark, "x", "redact", column="v") == "[REDACTED]"
    assert one(spark, "x", "redact", column="db.T.V") == "[REDACTED]"
    assert one(spark, "x", "redact", column="xv") == "x"


def test_rules_run_in_order_on_masked_values(spark):
    df = spark.createDataFrame([("abc", 7)], "v string, n int")
    rules = [G.MaskingRule("v", "redact"), G.MaskingRule("v", "hash"), G.MaskingRule("n", "hash")]
    row = G.apply_masking_rules(df, rules, ["x"]).first()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12]
    assert row["v"] == f"[HASH:{digest('[REDACTED]')}]" and row["n"] == f"[HASH:{digest('7')}]"


def test_first_matching_column_only(spark):
    df = spark.createDataFrame([("a", "b")], "V string, other string")
    assert G.apply_masking_rules(df, [G.MaskingRule("t.v", "redact")], ["x"]).first()[0] == "[REDACTED]"


def kept(spark, rows, schema, k=3, groups=("analyst",), **kw):
    return G.min_group_size(spark.createDataFrame(rows, schema), k, groups, **kw).count()


def test_min_group_size(spark):
    assert kept(spark, [(2,)], "Cnt int") == 0
    assert kept(spark, [(3,)], "Cnt int") == 1
    assert kept(spark, [(None,)], "Cnt int") == 1
    assert kept(spark, [(2,)], "record_count int") == 1
    assert kept(spark, [(2,)], "record_count int", count_cols=["record_count"]) == 0
    assert kept(spark, [(2.9,)], "n double") == 0
    assert kept(spark, [(float("nan"),)], "n double") == 1
    assert kept(spark, [("2",)], "n string") == 1
    assert kept(spark, [(2,)], "n int", groups=("admin",)) == 1
    assert kept(spark, [(0,)], "n int", k=1) == 1
    assert kept(spark, [(5, 2)], "n int, COUNT bigint") == 0


POLICY = G.Policy(
    secret_columns=("Employees.Address",), pii_columns=("Customers.Phone", "city"),
    sensitive_columns=("Orders.Freight",), blocked_tables=("audit",), allowed_schemas=("dbo",),
    row_filters=(G.RowFilter("orders", "freight > 1", ("finance",)),),
    masking_rules=(G.MaskingRule("n", "redact", ("analyst",)),), min_group_size=3, max_rows=4,
    access_groups=(G.AccessGroup("analyst", ("customers",), ("customers.name",)),),
)


def test_column_tiers(spark):
    df = spark.createDataFrame([("a", "p", "c", "n")], "address string, phone string, city string, name string")
    cols = lambda groups, **kw: G.restrict_columns(df, "Customers", POLICY, groups, **kw).columns
    assert cols(()) == ["name"]
    assert cols(("pii_reader",)) == ["phone", "city", "name"]
    assert cols(("admin",)) == ["address", "phone", "city", "name"]
    # A bare name hits in any table unless strict.
    assert "address" in cols((), strict=True)
    with pytest.raises(G.AccessDenied):
        cols((), mode="raise")


def test_sensitive_needs_security_group(spark):
    df = spark.createDataFrame([(1, 2)], "order_id int, Freight int")
    assert G.restrict_columns(df, "orders", POLICY, ("analyst",)).columns == ["order_id"]
    assert G.restrict_columns(df, "orders", POLICY, ("security",)).columns == ["order_id", "Freight"]


def test_row_filter_and_governed_order(spark):
    orders = spark.createDataFrame([(i, i % 3) for i in range(10)], "order_id int, freight int")
    filtered = G.row_filter(orders, "Orders", POLICY.row_filters, ("finance",))
    assert filtered.count() == 3
    assert G.row_filter(orders, "orders", POLICY.row_filters, ("analyst",)).count() == 10

    def run(seen):
        assert "freight" not in seen["orders"].columns
        return seen["orders"].groupBy((F.col("order_id") % 2).alias("g")).agg(F.count("*").alias("n"))

    result = G.governed_result({"orders": orders}, POLICY, ("finance", "analyst"), run)
    # Two of three rows fall in one group: both groups are below three and go before masking.
    assert result.run() == [] and result.status().first()["row_count"] == 2
    result = G.governed_result({"orders": orders}, POLICY, ("analyst",), run)
    assert [r["n"] for r in result.run()] == ["[REDACTED]", "[REDACTED]"]
    result = G.governed_result({"orders": orders}, POLICY, ("analyst",), lambda s: s["orders"])
    assert result.status().first().asDict() == {"row_count": 4, "truncated": True}


def test_catalog(spark):
    df = spark.createDataFrame([("x", "y")], "name string, phone string")
    tables = {"dbo.customers": df, "sys.customers2": df, "other.t": df, "audit": df, "plain": df}
    views = G.govern_catalog(spark, tables, POLICY)
    assert list(views) == ["dbo.customers", "plain"]
    assert spark.table(views["dbo.customers"]).columns == ["name"]
    # Another caller and another schema have views of their own; what a policy closes goes.
    mine = G.govern_catalog(spark, {"dbo.t": df, "x.t": df.limit(0)}, G.Policy(), caller="me")
    yours = G.govern_catalog(spark, {"dbo.t": df.limit(0)}, G.Policy(), caller="you")
    assert [spark.table(v).count() for v in (*mine.values(), *yours.values())] == [1, 0, 0]
    assert G.govern_catalog(spark, {"dbo.t": df}, G.Policy(closed_schemas=("dbo",)), caller="me") == {}
    assert not spark.catalog.tableExists(mine["dbo.t"]) and spark.catalog.tableExists(mine["x.t"])
    with pytest.raises(ValueError):
        G.govern_catalog(spark, {"a.b": df, "a_b": df}, G.Policy())
    scoped = G.scope({"customers": df, "orders": df}, POLICY, ("analyst",))
    assert list(scoped) == ["customers"] and scoped["customers"].columns == []
    assert list(G.scope({"customers": df}, POLICY, ("other",))["customers"].columns) == ["name"]


def test_classify(spark):
    names = ["password", "Phone_No", "city", "API-Key", "first name", "SSN_hash", "emailToken"]
    df = spark.createDataFrame([(n,) for n in names], "column_name string")
    got = {r["column_name"]: r["category"] for r in G.classify_columns(df).collect()}
    assert got == {
        "password": "secret", "Phone_No": "pii", "city": "none", "API-Key": "secret",
        "first name": "pii", "SSN_hash": "secret", "emailToken": "secret",
    }


def test_key_audit_and_lint(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "k int, v string")
    assert G.key_audit(df, ["k"]).first().asDict() == {"rows": 4, "nulls": 1, "duplicates": 1}
    assert G.key_audit(df.limit(0), ["k"]).first().asDict() == {"rows": 0, "nulls": 0, "duplicates": 0}
    cols = spark.createDataFrame([("orders", "id")], "table_name string, column_name string")
    refs = spark.createDataFrame(
        [("r1", "orders", "id"), ("r2", "orders", "x"), ("r3", "nope", "id"), ("r4", "nope", None), ("r5", "orders", None)],
        "ref_id string, table_name string, column_name string",
    ).selectExpr("*", "'REL001' table_code", "'REL002' column_code", "'error' severity")
    issues = {r["ref_id"]: r["code"] for r in G.catalog_lint(refs, cols).collect()}
    assert issues == {"r2": "REL002", "r3": "REL001", "r4": "REL001"}
    dup = G.duplicate_ids(df, "v", "EX001").first()
    assert (dup["ref_id"], dup["occurrences"]) == ("a", 2)


def test_json_safe(spark):
    row = json_safe(spark.sql(
        "select double('NaN') a, double('Infinity') b, 3.5BD c, timestamp_ntz'2026-05-16 10:00:00' d, "
        "timestamp_ntz'2026-05-16 10:00:00.25' d2, date'2026-03-01' e, cast('hello' as binary) f, 42 g, cast(null as double) h"
    )).first()
    assert tuple(row) == (
        None, float("inf"), 3.5, "2026-05-16T10:00:00", "2026-05-16T10:00:00.250000", "2026-03-01", "aGVsbG8=", 42, None,
    )


def test_redact(spark):
    df = spark.sql(
        "select 'SELECT 1' sql, 'secret' token, named_struct('SQL', 'SELECT 2', 'x', 1) args, "
        "array(named_struct('password', 'p', 'y', 2)) items, map('sql', 'SELECT 3', 'api_key', 'k', 'z', 'v') m, "
        "map('z', 'v') plain, 7 n"
    )
    row = redact_payload(df).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert row["sql"] == "[REDACTED_SQL]" and row["sql_hash"] == sha("SELECT 1") and row["token"] == "[REDACTED]"
    assert row["args"]["SQL"] == "[REDACTED_SQL]" and row["args"]["sql_hash"] == sha("SELECT 2") and row["args"]["x"] == 1
    assert row["items"][0].asDict() == {"password": "[REDACTED]", "y": 2}
    assert row["m"] == {"sql": "[REDACTED_SQL]", "api_key": "[REDACTED]", "z": "v", "sql_hash": sha("SELECT 3")}
    assert row["plain"] == {"z": "v"} and row["n"] == 7
    assert "SELECT" not in str(row)
    null = redact_payload(spark.sql("select cast(null as string) sql")).first()
    assert null["sql"] == "[REDACTED]" and null["sql_hash"] is None


def test_groups(spark):
    df = spark.createDataFrame([(" a, ,Admin,b ,ROOT",), ("",), (None,)], "g string")
    assert [r[0] for r in df.select(X.parse_groups(F.col("g"))).collect()] == [["a", "b"], [], []]
