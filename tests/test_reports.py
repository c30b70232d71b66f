from __future__ import annotations

from pyspark.sql import functions as F

from retail_fixture import retail
from tallyhouse.operators import evaluation as M
from tallyhouse.operators import templates as P
from tallyhouse.operators.relational import Relationship

CHECKS = "id string, checks array<struct<code: string, passed: boolean, severity: string, message: string>>"


def checks(spark):
    ok, bad = True, False
    return spark.createDataFrame(
        [("none", []), ("warned", [("BN006", bad, "warning", "w"), ("BN004", ok, "error", "")]),
         ("failed", [("BN001", bad, "error", "e"), ("BN006", bad, "warning", "w"), ("BN008", ok, "info", "")]),
         ("fine", [("BN001", ok, "error", "")])],
        CHECKS,
    )


def test_table_checks_reach_the_roll_up(spark):
    rows = [
        ("fine", "select a join b", ["a", "b"], ["a", "b"], False),
        ("unknown", "select zz", ["zz"], ["a"], False),
        ("rejected", "select zz", ["zz"], [], True),
        ("lost", "select a", ["a"], ["a", "gone"], False),
        ("nosql", None, [], ["a"], True),
    ]
    df = spark.createDataFrame(rows, "id string, sql string, tables array<string>, required_tables array<string>, must_reject boolean")
    df = df.selectExpr("*", "'q' AS question_en", "'q' AS question_ar")
    known = spark.createDataFrame([("a",), ("b",)], "name string")
    got = M.sql_checks(M.text_presence(df), known)
    bad = {r["id"]: sorted(c["code"] for c in r["checks"] if not c["passed"]) for r in got.collect()}
    assert bad == {"fine": [], "unknown": ["BN002", "BN006"], "rejected": [], "lost": ["BN007", "BN010"], "nosql": []}
    assert M.benchmark_summary(got).first().asDict() == {"total": 5, "passed": 3, "failed": 2, "warnings": 2}


def test_all_lists_are_looked_up_in_one_pass(spark, capsys):
    rows = [("a", ["x", "y", None], ["y", "z", "z"]), ("b", None, ["q"]), ("c", ["y"], []), ("d", ["p", "p", "o"], None)]
    df = spark.createDataFrame(rows, "id string, tables array<string>, required_tables array<string>")
    known = spark.createDataFrame([("y",), ("y",), (None,)], "name string")
    got = M._unknown(df, {"_bad": "tables", "_lost": "required_tables"}, known)
    got.explain()
    assert capsys.readouterr().out.count("LeftAnti") == 1
    assert {r["id"]: (r["_bad"], r["_lost"]) for r in got.collect()} == {
        "a": (["x"], ["z"]), "b": (None, ["q"]), "d": (["o", "p"], None),
    }


def test_summary_and_failures(spark):
    df = checks(spark)
    assert {r["id"]: r["passed"] for r in M.item_passed(df).collect()} == {
        "none": True, "warned": True, "failed": False, "fine": True,
    }
    assert M.benchmark_summary(df).first().asDict() == {"total": 4, "passed": 3, "failed": 1, "warnings": 2}
    assert M.benchmark_summary(df.limit(0)).first().asDict() == {"total": 0, "passed": 0, "failed": 0, "warnings": 0}
    got = sorted((r["id"], r["code"]) for r in M.failures(df).collect())
    assert got == [("failed", "BN001"), ("failed", "BN006")]


def test_required_overlap(spark):
    df = spark.createDataFrame(
        [("a", "SELECT", ["A", "B"], ["A"], False), ("b", "x JOIN y", ["A", "B", "C"], ["A", "B"], False),
         ("c", "x, y", ["A", "B"], ["A", "B"], False), ("d", "", ["A"], ["Z"], False), ("e", "", ["A"], [], False),
         ("f", "x", [], ["A"], False), ("g", "x", ["A", "B"], ["A"], True)],
        "id string, sql string, required_tables array<string>, tables array<string>, must_reject boolean",
    )
    got = {r["id"]: (r["overlap_ok"], r["join_ok"]) for r in M.required_overlap(df).collect()}
    assert got == {"a": (True, False), "b": (True, True), "c": (True, True), "d": (False, None), "e": (True, None),
                   "f": (None, None), "g": (True, None)}


def test_text_presence(spark):
    df = spark.createDataFrame(
        [("a", "q", "س", "SELECT 1", False), ("b", "q", None, " ", False), ("c", "q", "س", None, True)],
        "id string, question_en string, question_ar string, sql string, must_reject boolean",
    )
    got = {r["id"]: [(c["code"], c["passed"], c["severity"]) for c in r["checks"]] for r in M.text_presence(df).collect()}
    assert got == {
        "a": [("BN008", True, "info")],
        "b": [("BN008", False, "warning"), ("BN009", False, "error")],
        "c": [("BN008", True, "info"), ("BN011", True, "info")],
    }


def test_missing_references(spark):
    refs = spark.createDataFrame([("q1", "T", "a"), ("q1", "T", "b"), ("q2", "U", "a")], "id string, tab string, col string")
    cols = spark.createDataFrame([("T", "a")], "tab string, col string")
    got = sorted((r["id"], r["tab"], r["col"]) for r in M.missing_references(refs, cols, ["tab", "col"]).collect())
    assert got == [("q1", "T", "b"), ("q2", "U", "a")]


def test_describe_and_autoprofile(spark):
    t = retail(spark)
    spec = P.describe_table(t["orders"], ["order_id"])
    assert (spec.label, spec.date, spec.group) == ("customer_id", "order_date", None)
    spec = P.describe_table(t["customers"], ["customer_id"])
    assert (spec.label, spec.date, spec.group) == ("company_name", None, "city")
    rel = Relationship("r", "orders", ("customer_id",), "customers", ("customer_id",))
    made = P.autoprofile(t, {"customers": ["customer_id"], "orders": ["order_id"]}, [rel])
    assert set(made) == {
        "customers_count", "customers_lookup_top5", "customers_lookup_top10", "customers_lookup_top20",
        "customers_group_by_city", "customers_filter_city", "orders_count", "orders_lookup_top5",
        "orders_lookup_top10", "orders_lookup_top20", "orders_latest_by_order_date", "orders_monthly_trend",
        "orders_join_customers", "orders_rank_customers",
    }
    assert made["orders_count"].first()["record_count"] == 4
    assert [tuple(r) for r in made["orders_monthly_trend"].collect()] == [(1997, 1, 1), (1997, 12, 2), (1998, 3, 1)]
    assert [tuple(r) for r in made["orders_rank_customers"].collect()] == [("Bon app", 2), ("Alfreds", 1)]
    assert [r["order_id"] for r in made["orders_latest_by_order_date"].collect()] == [4, 3, 2, 1]
    assert made["customers_lookup_top5"].columns == ["customer_id", "company_name"]


def test_not_null_lookup(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", "x"), (3, "a", "y")], "k int, l string, c string")
    assert [r["k"] for r in P.not_null_lookup(df, "k", "l", "c").collect()] == [2, 3]
    assert [tuple(r) for r in P.group_count(df.withColumn("g", F.lit(1)), "l", "k").collect()] == [("a", 2), ("b", 1)]
