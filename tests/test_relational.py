from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from retail_fixture import retail
from tallyhouse.functions.money import full_name, line_money, line_revenue
from tallyhouse.operators import aggregates as A
from tallyhouse.operators import limits as L
from tallyhouse.operators import relational as R
from tallyhouse.plans.retail import active_customers


@pytest.fixture(scope="module")
def t(spark):
    return retail(spark)


def rev():
    return line_revenue(F.col("unit_price"), F.col("quantity"), F.col("discount"))


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_line_revenue_and_money(t):
    rows = t["order_details"].select("order_id", "product_id", rev().alias("r"), line_money(rev()).alias("m"))
    got = {(r["order_id"], r["product_id"]): (r["r"], float(r["m"])) for r in rows.collect()}
    assert got[(1, 2)][0] == pytest.approx(16.15, abs=1e-5)
    assert got[(1, 2)][1] == 16.15
    assert got[(2, 3)][1] == 52.31  # 52.3125 to cents


def test_full_name_is_null_if_a_part_is(t):
    rows = t["employees"].select("employee_id", full_name(F.col("first_name"), F.col("last_name")).alias("n"))
    assert {r["employee_id"]: r["n"] for r in rows.collect()} == {
        1: "Nancy Davolio", 2: "Andrew Fuller", 3: None,
    }


def test_projection_refuses_star(t):
    assert R.project(t["orders"], ["order_id"]).columns == ["order_id"]
    for bad in (["*"], ["orders.*"], []):
        with pytest.raises(ValueError):
            R.project(t["orders"], bad)


def test_safe_alias(spark):
    for name in ("RowCount", "rowcount", "ROWCOUNT"):
        df = spark.range(3).agg(F.count("*").alias(name))
        assert R.safe_alias(df).columns == ["record_count"]


def test_decode(t):
    out = R.decode(t["orders"], "ship_via", {"1": "Speedy Express"}, "shipper")
    assert values(out.filter("shipper is not null"), "order_id") == [(1,), (4,)]


def test_filters(t):
    p = t["products"]
    reorder = p.filter((F.col("units_in_stock") <= F.col("reorder_level")) & ~F.col("discontinued"))
    assert values(reorder, "product_id") == [(1,), (2,)]
    inner = R.above_average(p, "unit_price", F.col("unit_price") > 0).filter(~F.col("discontinued"))
    assert values(inner, "product_id") == []  # average without the free one is 24
    assert values(R.above_average(p, "unit_price"), "product_id") == [(4,)]
    late = R.late(t["orders"], "shipped_date", F.col("required_date"))
    assert values(late, "order_id") == [(3,)]


def test_between_drops_times_on_the_last_day(t):
    lo, hi = datetime(1997, 1, 1), datetime(1997, 12, 31)
    assert values(R.date_between(t["orders"], "order_date", lo, hi), "order_id") == [(1,), (2,)]
    assert values(R.year_filter(t["orders"], "order_date", 1997), "order_id") == [(1,), (2,), (3,)]


def test_anti_and_right_join(t):
    none = R.without_match(t["customers"], t["orders"], "customer_id", "customer_id")
    assert values(none, "customer_id") == [("CACTU",)]
    cust = t["customers"].select("customer_id", "company_name")
    got = active_customers(
        cust, "customer_id", t["orders"], "customer_id", "order_date", datetime(1997, 1, 1), datetime(1998, 12, 31)
    ).collect()
    assert sorted(map(tuple, got), key=str) == [("ALFKI", "Alfreds"), ("BONAP", "Bon app"), (None, None)]


def test_self_bridge_and_path(t):
    boss = R.self_join(t["employees"], "reports_to", "employee_id", "manager", "last_name")
    assert {r["last_name"]: r["manager"] for r in boss.collect()} == {
        "Davolio": "Fuller", "Fuller": None, "King": "Fuller",
    }
    links = R.bridge_join(
        t["employees"], "employee_id", t["employee_territories"], "employee_id", "territory_id",
        t["territories"], "territory_id",
    )
    assert links.count() == 3  # the repeated link counts once
    rels = [
        R.Relationship("a", "products", ("category_id",), "categories", ("category_id",)),
    ]
    with pytest.raises(ValueError):
        R.join_path(t, [rels[0], rels[0]])
    chain = [
        R.Relationship("1", "orders", ("customer_id",), "customers", ("customer_id",)),
        R.Relationship("2", "order_details", ("order_id",), "orders", ("order_id",)),
        R.Relationship("3", "order_details", ("product_id",), "products", ("product_id",)),
        R.Relationship("4", "products", ("category_id",), "categories", ("category_id",)),
    ]
    joined = R.join_path(t, chain)
    assert joined.columns.count("order_id") == 1 and joined.columns.count("category_id") == 1
    by = joined.groupBy("country", "category_name").agg(F.sum("quantity").alias("q"))
    assert values(by, "country", "category_name", "q") == [
        ("France", "Produce", 5), ("Germany", "Beverages", 11),
    ]


def test_outer_join_by_relationship(t):
    rel = R.Relationship("r", "customers", ("customer_id",), "orders", ("customer_id",), "left")
    assert R.join_by_relationship(t, rel).count() == 4
    assert R.join_by_relationship(t, rel, "full").count() == 5
    assert R.join_by_relationship(t, rel, "inner").count() == 3


def test_orphans(t):
    rel = R.Relationship("line_product", "order_details", ("product_id",), "products", ("product_id",))
    assert values(R.orphan_rows(t, rel), "rel_id", "key", "n") == [("line_product", "99", 1)]


def test_union(t):
    a = t["customers"].select("city", "company_name", "contact_name")
    b = t["suppliers"].select("city", "company_name", "contact_name")
    assert R.union_distinct(a, b).count() == 4  # one row is both
    assert R.union_distinct(R.tag(a, "rel", "C"), R.tag(b, "rel", "S")).count() == 5
    ids = R.union_aligned(t["customers"].select(F.col("customer_id").alias("id")),
                          t["suppliers"].select(F.col("supplier_id").alias("id")))
    assert ids.schema["id"].dataType.simpleString() == "string" and ids.count() == 5


def test_aggregates(t):
    freight = A.total(t["orders"], F.col("freight"), "f").first()["f"]
    assert float(freight) == 13.5
    per = A.count_by_parent(t["orders"], "customer_id", "order_id", t["customers"], "customer_id", ["company_name"], "n")
    assert values(per, "company_name", "n") == [("Alfreds", 1), ("Bon app", 2)]
    sums = A.sum_by_parent(t["order_details"], "product_id", rev(), t["products"], "product_id", ["category_id"], "v")
    got = {r["category_id"]: r["v"] for r in sums.collect()}
    assert got[1] == pytest.approx(196.15, abs=1e-4) and got[2] == pytest.approx(132.3125, abs=1e-4)
    avg = A.avg_of_sums(t["order_details"], ["order_id"], F.col("quantity"), "a").first()["a"]
    assert avg == pytest.approx(17 / 3)
    active = A.count_where(t["products"], {"n": ~F.col("discontinued")})
    assert active.first()["n"] == 4
    assert A.count_where(t["products"].limit(0), {"n": ~F.col("discontinued")}).first()["n"] is None
    avg_f = A.avg_by(t["orders"], ["ship_via"], F.col("freight"), "a", F.col("freight").isNotNull())
    assert values(avg_f, "ship_via", "a") == [(1, 6.25), (2, 1.0)]


def test_limits(spark, t):
    p = t["products"]
    assert [r["product_id"] for r in L.top_n(p, "unit_price", 3, ["product_id"]).collect()] == [4, 2, 3]
    assert [r["product_id"] for r in L.bottom_n(p, "unit_price", 1, ["product_id"]).collect()] == [5]
    ranked = L.first_n_by(p, [F.col("product_name")], 2).collect()
    assert [(r["rn"], r["product_name"]) for r in ranked] == [(1, "Chai"), (2, "Chang")]
    best = L.top_k(p, ["category_id"], [F.col("unit_price").desc(), F.col("product_id")], 1)
    assert values(best, "category_id", "product_id") == [(1, 2), (2, 4)]
    for n, truncated in ((4, True), (5, True), (6, False)):
        capped = L.cap_rows(p, n)
        assert len(capped.run()) == min(n, 5)
        assert capped.status().first().asDict() == {"row_count": min(n, 5), "truncated": truncated}
    assert L.with_default_limit(p, 2, False).count() == 2
    assert L.with_default_limit(p, 2, True).count() == 5
    assert L.distinct_capped(p, ["category_id"], 1).count() == 1
    head = L.preview(p, [F.col("product_id")], 2)
    status = head.status().first()
    assert [r["product_id"] for r in head.rows.collect()] == [1, 2] and status["row_count"] == 5
    assert status["columns"].startswith("product_id,")
    for nothing in (p.limit(0), p.filter(F.lit(False)), p.filter("unit_price < 0")):
        empty = L.cap_rows(nothing, 3).status().first()
        assert empty["row_count"] == 0 and not empty["truncated"]


def test_a_capped_result_is_read_once(spark, t, work):
    p = spark.range(1000).repartition(7)
    jobs = spark.sparkContext._jsc.sc().statusTracker()
    spark.sparkContext.setJobGroup("capped", "one run")
    capped = L.cap_rows(p, 40).shaped(lambda rows: rows.filter("id % 2 = 0").withColumn("x", F.col("id") + 1))
    capped.run(lambda rows: rows.write.parquet(f"{work}/capped"))
    ran = len(jobs.getJobIdsForGroup("capped"))
    assert capped.counts() == {"row_count": 40, "truncated": True}
    # The status takes no job of its own, and is that of the rows that were written.
    assert len(jobs.getJobIdsForGroup("capped")) == ran
    spark.sparkContext.setJobGroup("other", "")
    with pytest.raises(Exception, match="DIVIDE|broken"):
        L.cap_rows(p.select(F.raise_error(F.lit("broken")).alias("x")), 5).run()
    written = spark.read.parquet(f"{work}/capped")
    assert written.columns == ["id", "x"] and written.filter("id % 2 = 1").count() == 0


def test_range_filter_reaches_the_scan(spark, work):
    df = spark.sql("select timestamp_ntz'1997-01-01' as d, 1 as a, 2 as b")
    df.write.parquet(f"{work}/p")
    rows = R.year_filter(spark.read.parquet(f"{work}/p"), "d", 1997).select("a")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d" in plan and "b#" not in plan
