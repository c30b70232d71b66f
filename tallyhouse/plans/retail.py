"""The sales corpus over customers, orders, lines, parts and suppliers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.dates import year_name, year_text
from tallyhouse.functions.money import extended_revenue, full_name, line_money
from tallyhouse.operators import aggregates as A
from tallyhouse.operators import limits as L
from tallyhouse.operators import relational as R
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import Tables

REV_SQL = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
MONEY_SQL = f"ROUND({REV_SQL}, 2)"
Y1997 = (datetime(1997, 1, 1), datetime(1997, 12, 31))

RELATIONSHIPS = {
    "order_customer": R.Relationship(
        "order_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)
    ),
    "line_order": R.Relationship(
        "line_order", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)
    ),
    "line_part": R.Relationship("line_part", "lineitem", ("l_partkey",), "part", ("p_partkey",)),
    "line_supplier": R.Relationship(
        "line_supplier", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)
    ),
    "customer_nation": R.Relationship(
        "customer_nation", "customer", ("c_nationkey",), "nation", ("n_nationkey",)
    ),
    "nation_region": R.Relationship(
        "nation_region", "nation", ("n_regionkey",), "region", ("r_regionkey",)
    ),
    "event_supplier": R.Relationship(
        "event_supplier", "events", ("user_id",), "supplier", ("s_suppkey",)
    ),
    "label_document": R.Relationship(
        "label_document", "labels", ("doc_id",), "documents", ("doc_id",), "right"
    ),
}


def rev() -> Column:
    return extended_revenue(F.col("l_extendedprice"), F.col("l_discount"))


def dbl(df: DataFrame, *cols: str) -> DataFrame:
    """Exact decimal results leave as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def order_totals(t: Tables, value: Column | None = None, out: str = "subtotal") -> DataFrame:
    """Lines folded to one row per order."""
    return A.sum_by(t["lineitem"], ["l_orderkey"], rev() if value is None else value, out)


def orders_with_totals(t: Tables, value: Column | None = None) -> DataFrame:
    """Orders with their subtotal; both sides meet on the key the totals are grouped by."""
    sub = order_totals(t, value)
    return t["orders"].join(sub, F.col("o_orderkey") == F.col("l_orderkey"))


# ------------------------------------------------------- projections and filters


@query("explicit_projection", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def explicit_projection(t):
    return R.project(t["orders"], ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "line_revenue",
    f"SELECT l_orderkey, l_partkey, l_linenumber, CAST({REV_SQL} AS DOUBLE) AS line_total FROM lineitem",
)
def line_revenue(t):
    cols = ["l_orderkey", "l_partkey", "l_linenumber"]
    return dbl(t["lineitem"].select(*cols, rev().alias("line_total")), "line_total")


@query(
    "line_money_cents",
    f"SELECT l_orderkey, l_partkey, l_linenumber, CAST({MONEY_SQL} AS DOUBLE) AS line_total FROM lineitem",
)
def line_money_cents(t):
    cols = ["l_orderkey", "l_partkey", "l_linenumber"]
    return dbl(t["lineitem"].select(*cols, line_money(rev()).alias("line_total")), "line_total")


@query("full_name", "SELECT p_partkey, p_brand || ' ' || p_name AS full_name FROM part")
def full_name_q(t):
    return t["part"].select("p_partkey", full_name(F.col("p_brand"), F.col("p_name")).alias("full_name"))


@query("literal_tag", "SELECT s_suppkey, s_name, 'Suppliers' AS relationship FROM supplier")
def literal_tag(t):
    return R.tag(t["supplier"].select("s_suppkey", "s_name"), "relationship", "Suppliers")


@query("safe_alias", "SELECT o_orderpriority, COUNT(*) AS record_count FROM orders GROUP BY 1")
def safe_alias(t):
    counts = t["orders"].groupBy("o_orderpriority").agg(F.count("*").alias("RowCount"))
    return R.safe_alias(counts)


@query(
    "decode_codes",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Open' END "
    "AS status_label FROM orders",
)
def decode_codes(t):
    labels = {"F": "Fulfilled", "O": "Open"}
    return R.decode(t["orders"], "o_orderstatus", labels, "status_label").select(
        "o_orderkey", "status_label"
    )


@query("filter_equals", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_equals(t):
    return t["customer"].filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query(
    "filter_compare",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem "
    "WHERE l_discount > 0 AND l_quantity <= 10 AND l_returnflag <> 'N'",
)
def filter_compare(t):
    keep = (F.col("l_discount") > 0) & (F.col("l_quantity") <= 10) & (F.col("l_returnflag") != "N")
    return t["lineitem"].filter(keep).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "filter_column_compare",
    "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem "
    "WHERE l_discount <= l_tax AND NOT (l_linestatus = 'F')",
)
def filter_column_compare(t):
    keep = (F.col("l_discount") <= F.col("l_tax")) & ~(F.col("l_linestatus") == "F")
    return t["lineitem"].filter(keep).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


def _with_shipped(t: Tables) -> DataFrame:
    """Orders with a shipped date that is null until the order is fulfilled."""
    shipped = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return t["orders"].withColumn("shipped_date", shipped)


def shipped_between(t: Tables, lo: datetime, hi: datetime) -> DataFrame:
    """Orders whose shipped date lies in a range. Status and date are named as they are stored, so
    both conditions reach the scan."""
    return R.date_between(t["orders"].filter(F.col("o_orderstatus") == "F"), "o_orderdate", lo, hi)


def totals_of(t: Tables, orders: DataFrame, money: Column) -> DataFrame:
    """Orders with the sum over their own lines: lines are cut down to them before the fold."""
    lines = t["lineitem"].join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    sums = lines.groupBy("l_orderkey").agg(F.sum(money).alias("subtotal"))
    return orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"))


SHIPPED_SQL = (
    "(SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS shipped_date FROM orders) o"
)


@query(
    "filter_is_null",
    f"SELECT COUNT(o_orderkey) AS unshipped_count FROM {SHIPPED_SQL} WHERE shipped_date IS NULL",
)
def filter_is_null(t):
    rows = _with_shipped(t).filter(F.col("shipped_date").isNull())
    return rows.agg(F.count("o_orderkey").alias("unshipped_count"))


@query(
    "filter_is_not_null",
    f"SELECT o_orderkey, o_custkey FROM {SHIPPED_SQL} WHERE shipped_date IS NOT NULL",
)
def filter_is_not_null(t):
    rows = _with_shipped(t).filter(F.col("shipped_date").isNotNull())
    return rows.select("o_orderkey", "o_custkey")


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%'")
def filter_like(t):
    return t["part"].filter(F.col("p_name").like("%widget%")).select("p_partkey", "p_name")


@query(
    "filter_date_range",
    "SELECT o_orderkey, o_custkey FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'",
)
def filter_date_range(t):
    rows = R.date_range(t["orders"], "o_orderdate", datetime(1997, 7, 1), datetime(1997, 10, 1))
    return rows.select("o_orderkey", "o_custkey")


@query("filter_year", "SELECT o_orderkey, o_custkey FROM orders WHERE YEAR(o_orderdate) = 1998")
def filter_year(t):
    return R.year_filter(t["orders"], "o_orderdate", 1998).select("o_orderkey", "o_custkey")


@query(
    "filter_between",
    "SELECT l_orderkey, l_linenumber FROM lineitem "
    "WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'",
)
def filter_between(t):
    return R.date_between(t["lineitem"], "l_shipdate", *Y1997).select("l_orderkey", "l_linenumber")


@query(
    "filter_late",
    "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY",
)
def filter_late(t):
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    joined = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    required = F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")
    return R.late(joined, "l_shipdate", required).select("l_orderkey", "l_linenumber", "o_custkey")


@query(
    "filter_above_average",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size < 40 AND p_retailprice > "
    "(SELECT AVG(p_retailprice) FROM part WHERE p_retailprice > 0)",
)
def filter_above_average(t):
    rows = R.above_average(t["part"], "p_retailprice", F.col("p_retailprice") > 0)
    return rows.filter(F.col("p_size") < 40).select("p_partkey", "p_name", "p_retailprice")


@query(
    "above_average_all",
    "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)",
)
def above_average_all(t):
    return R.above_average(t["part"], "p_retailprice").select("p_partkey", "p_retailprice")


@query(
    "filter_having_style",
    f"SELECT CAST(s.subtotal AS DOUBLE) AS sale_amount, o_orderkey, c_name FROM (SELECT l_orderkey, "
    f"SUM({MONEY_SQL}) AS subtotal FROM lineitem GROUP BY 1) s JOIN orders ON s.l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey WHERE s.subtotal > 2500 AND o_orderstatus = 'F' AND "
    "o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'",
)
def large_sales(t):
    joined = totals_of(t, shipped_between(t, *Y1997), line_money(rev())).filter(F.col("subtotal") > 2500)
    joined = joined.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("subtotal").cast("double").alias("sale_amount"), "o_orderkey", "c_name")


# ------------------------------------------------------------------------- joins


@query(
    "inner_join",
    "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def inner_join(t):
    joined = R.join_by_relationship(t, RELATIONSHIPS["customer_nation"])
    return joined.select("c_custkey", "c_name", "n_name")


TOP_CUSTOMERS_SQL = (
    f"SELECT c_name, CAST(SUM({REV_SQL}) AS DOUBLE) AS total_revenue FROM customer "
    "JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_name"
)


def revenue_per_customer(t: Tables) -> DataFrame:
    """Lines fold per order, orders per customer; the names come last."""
    per_key = A.sum_by(orders_with_totals(t), ["o_custkey"], F.col("subtotal"), "total_revenue")
    named = per_key.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return dbl(A.sum_by(named, ["c_name"], F.col("total_revenue"), "total_revenue"), "total_revenue")


@query("inner_join_3way", TOP_CUSTOMERS_SQL)
def inner_join_3way(t):
    return revenue_per_customer(t)


@query(
    "inner_join_5way",
    f"SELECT o_orderkey, c_name, n_name, p_name, l_quantity, l_linenumber, CAST({REV_SQL} AS DOUBLE) "
    "AS line_total FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON o_orderkey = l_orderkey "
    "JOIN part ON l_partkey = p_partkey ORDER BY line_total DESC, o_orderkey, l_linenumber, p_name LIMIT 100",
)
def order_detail(t, n=100):
    # Each map task keeps its best n rows; nothing is sorted as a whole.
    rels = [RELATIONSHIPS[k] for k in ("line_order", "order_customer", "customer_nation", "line_part")]
    joined = R.join_path(t, rels).withColumn("line_total", rev().cast("double"))
    cols = ["o_orderkey", "c_name", "n_name", "p_name", "l_quantity", "l_linenumber", "line_total"]
    return L.top_n(joined.select(*cols), "line_total", n, ["o_orderkey", "l_linenumber", "p_name"])


@query(
    "invoices",
    f"SELECT o_orderkey, c_name, cn.n_name AS customer_nation, s_name AS shipper_name, p_name, l_quantity, "
    f"l_discount, CAST({MONEY_SQL} AS DOUBLE) AS extended_price, l_tax FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN part ON l_partkey = p_partkey "
    "JOIN supplier ON l_suppkey = s_suppkey",
)
def invoices(t):
    keys = ("line_order", "order_customer", "customer_nation", "line_part", "line_supplier")
    joined = R.join_path(t, [RELATIONSHIPS[k] for k in keys])
    return joined.select(
        "o_orderkey", "c_name", F.col("n_name").alias("customer_nation"),
        F.col("s_name").alias("shipper_name"), "p_name", "l_quantity", "l_discount",
        line_money(rev()).cast("double").alias("extended_price"), "l_tax",
    )


@query(
    "left_anti",
    "SELECT o_orderkey, o_custkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey "
    "WHERE l_orderkey IS NULL",
)
def left_anti(t):
    rows = R.without_match(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey")
    return rows.select("o_orderkey", "o_custkey")


@query(
    "right_join_distinct",
    "SELECT DISTINCT c_custkey, c_name, c_mktsegment FROM customer RIGHT JOIN orders "
    "ON c_custkey = o_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'",
)
def right_join_distinct(t):
    return active_customers(
        t["customer"].select("c_custkey", "c_name", "c_mktsegment"), "c_custkey",
        t["orders"], "o_custkey", "o_orderdate", *Y1997,
    )


def active_customers(cust, pk, orders, fk, date, lo, hi) -> DataFrame:
    """Customers RIGHT JOIN orders in a range, DISTINCT: unmatched orders give one all-null row.

    Orders are reduced to their distinct customer keys before the join.
    """
    keys = R.date_between(orders, date, lo, hi).select(F.col(fk).alias("_fk")).distinct()
    return cust.join(keys, cust[pk] == keys["_fk"], "right").drop("_fk").distinct()


@query(
    "outer_join",
    "SELECT d.doc_id, l.quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id",
)
def outer_join(t):
    docs = {"labels": t["labels"], "documents": t["documents"].select("doc_id")}
    joined = R.join_by_relationship(docs, RELATIONSHIPS["label_document"])
    return joined.select(docs["documents"]["doc_id"], "quality")


@query(
    "self_join",
    "SELECT c.conv_id, c.turn, p.role AS previous_role FROM conversations c LEFT JOIN conversations p "
    "ON p.conv_id = c.conv_id AND p.turn = c.turn - 1",
)
def self_join(t):
    turns = t["conversations"].select(
        "conv_id", "turn", "role",
        F.struct("conv_id", "turn").alias("key"),
        F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("parent"),
    )
    joined = R.self_join(turns, "parent", "key", "previous_role", "role")
    return joined.select("conv_id", "turn", "previous_role")


@query(
    "bridge_join",
    "SELECT p_type, s_nationkey, COUNT(*) AS links FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b "
    "JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
)
def bridge_join(t):
    joined = R.bridge_join(
        t["part"], "p_partkey", t["lineitem"], "l_partkey", "l_suppkey", t["supplier"], "s_suppkey"
    )
    return joined.groupBy("p_type", "s_nationkey").agg(F.count("*").alias("links"))


@query(
    "orphan_rows",
    "SELECT 'event_supplier' AS rel_id, CAST(user_id AS VARCHAR) AS key, COUNT(*) AS n FROM events "
    "WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 2 "
    "UNION ALL SELECT 'line_order', CAST(l_orderkey AS VARCHAR), COUNT(*) FROM lineitem "
    "WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2",
)
def orphan_rows(t):
    events = R.orphan_rows(t, RELATIONSHIPS["event_supplier"])
    return events.unionByName(R.orphan_rows(t, RELATIONSHIPS["line_order"]))


@query(
    "implicit_join",
    "SELECT n_name, r_name, COUNT(*) AS suppliers FROM nation, region, supplier "
    "WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey GROUP BY n_name, r_name",
)
def implicit_join(t):
    return t.spark.sql(
        "SELECT n_name, r_name, COUNT(*) AS suppliers FROM {nation}, {region}, {supplier} "
        "WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey GROUP BY n_name, r_name",
        nation=t["nation"], region=t["region"], supplier=t["supplier"],
    )


@query(
    "multi_hop_path",
    "SELECT r_name, p_type, SUM(l_quantity) AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
)
def multi_hop_path(t):
    keys = ("line_order", "order_customer", "customer_nation", "nation_region", "line_part")
    joined = R.join_path(t, [RELATIONSHIPS[k] for k in keys])
    return A.sum_by(joined, ["r_name", "p_type"], F.col("l_quantity"), "units")


# ------------------------------------------------------------------ aggregations


@query("total_revenue", f"SELECT CAST(SUM({REV_SQL}) AS DOUBLE) AS total_revenue FROM lineitem")
def total_revenue(t):
    return dbl(A.total(t["lineitem"], rev(), "total_revenue"), "total_revenue")


@query("revenue_by_customer", TOP_CUSTOMERS_SQL)
def revenue_by_customer(t):
    return revenue_per_customer(t)


@query(
    "revenue_by_product",
    f"SELECT p_partkey, p_name, CAST(SUM({REV_SQL}) AS DOUBLE) AS revenue FROM lineitem "
    "JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
)
def revenue_by_product(t):
    sums = A.sum_by(t["lineitem"], ["l_partkey"], rev(), "revenue")
    named = sums.join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return dbl(named.select("p_partkey", "p_name", "revenue"), "revenue")


@query(
    "revenue_by_category",
    f"SELECT p_type, CAST(SUM({REV_SQL}) AS DOUBLE) AS revenue FROM lineitem "
    "JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def revenue_by_category(t):
    out = A.sum_by_parent(t["lineitem"], "l_partkey", rev(), t["part"], "p_partkey", ["p_type"], "revenue")
    return dbl(out, "revenue")


@query(
    "revenue_by_supplier",
    f"SELECT s_name, CAST(SUM({REV_SQL}) AS DOUBLE) AS revenue FROM lineitem "
    "JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
)
def revenue_by_supplier(t):
    out = A.sum_by_parent(
        t["lineitem"], "l_suppkey", rev(), t["supplier"], "s_suppkey", ["s_name"], "revenue"
    )
    return dbl(out, "revenue")


@query(
    "revenue_by_handler",
    f"SELECT o_orderpriority, CAST(SUM({REV_SQL}) AS DOUBLE) AS revenue FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def revenue_by_handler(t):
    out = A.sum_by(orders_with_totals(t), ["o_orderpriority"], F.col("subtotal"), "revenue")
    return dbl(out, "revenue")


@query(
    "units_by_key",
    "SELECT p_partkey, p_name, SUM(l_quantity) AS total_quantity FROM lineitem "
    "JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
)
def units_by_key(t):
    sums = A.sum_by(t["lineitem"], ["l_partkey"], F.col("l_quantity"), "total_quantity")
    named = sums.join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return named.select("p_partkey", "p_name", "total_quantity")


@query(
    "count_by_key",
    "SELECT c_name, COUNT(o_orderkey) AS order_count FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
def count_by_key(t):
    return A.count_by_parent(
        t["orders"], "o_custkey", "o_orderkey", t["customer"], "c_custkey", ["c_name"], "order_count"
    )


@query(
    "count_products_per_supplier",
    "SELECT s_name, COUNT(*) AS product_count FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x "
    "JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
)
def count_products_per_supplier(t):
    pairs = t["lineitem"].select("l_suppkey", "l_partkey").distinct()
    return A.count_by_parent(
        pairs, "l_suppkey", "l_partkey", t["supplier"], "s_suppkey", ["s_name"], "product_count"
    )


@query(
    "count_customers_per_nation",
    "SELECT n_name, COUNT(c_custkey) AS customer_count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def count_customers_per_nation(t):
    return A.count_by_parent(
        t["customer"], "c_nationkey", "c_custkey", t["nation"], "n_nationkey", ["n_name"], "customer_count"
    )


@query("count_all", "SELECT COUNT(*) AS record_count FROM lineitem")
def count_all(t):
    return A.count_all(t["lineitem"])


YEARLY_SQL = (
    f"SELECT CAST(YEAR(o_orderdate) AS INTEGER) AS year, COUNT(DISTINCT o_orderkey) AS order_count, "
    f"CAST(SUM({REV_SQL}) AS DOUBLE) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey "
    "WHERE o_orderdate IS NOT NULL GROUP BY 1"
)


@query("count_distinct", YEARLY_SQL)
def count_distinct(t):
    # Totals hold one row per order, so counting them is the distinct count.
    rows = orders_with_totals(t).filter(F.col("o_orderdate").isNotNull())
    metrics = {"order_count": F.count("o_orderkey"), "revenue": F.sum("subtotal").cast("double")}
    return A.metrics_by(rows.withColumn("year", F.year("o_orderdate")), ["year"], metrics)


@query(
    "count_distinct_parts",
    "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, SUM(l_quantity) AS units FROM lineitem GROUP BY 1",
)
def count_distinct_parts(t):
    # Folding to (flag, part) first keeps the distinct set out of any single task.
    folded = A.sum_by(t["lineitem"], ["l_returnflag", "l_partkey"], F.col("l_quantity"), "q")
    metrics = {"parts": F.count("l_partkey"), "units": F.sum("q")}
    return A.metrics_by(folded, ["l_returnflag"], metrics)


@query(
    "avg_by_key",
    "SELECT o_orderpriority, SUM(CAST(o_totalprice AS DECIMAL(14,2)))::DOUBLE / COUNT(o_totalprice) AS avg_total "
    "FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1",
)
def avg_by_key(t):
    return A.avg_by(
        t["orders"], ["o_orderpriority"], F.col("o_totalprice").cast("decimal(14,2)"), "avg_total",
        F.col("o_totalprice").isNotNull(),
    )


@query(
    "avg_of_sums",
    f"SELECT SUM(s)::DOUBLE / COUNT(s) AS avg_order_value FROM (SELECT SUM({REV_SQL}) AS s FROM lineitem GROUP BY l_orderkey) x",
)
def avg_of_sums(t):
    return A.avg_of_sums(t["lineitem"], ["l_orderkey"], rev(), "avg_order_value")


@query(
    "conditional_sum",
    "SELECT CAST(SUM(CASE WHEN p_size <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS active_parts, "
    "CAST(SUM(CASE WHEN p_size > 45 AND p_type = 'PROMO' THEN 1 ELSE 0 END) AS BIGINT) AS large_promo FROM part",
)
def conditional_sum(t):
    return A.count_where(
        t["part"],
        {
            "active_parts": F.col("p_size") != 1,
            "large_promo": (F.col("p_size") > 45) & (F.col("p_type") == "PROMO"),
        },
    )


@query(
    "sum_nullable",
    "SELECT SUM(CASE WHEN l_returnflag <> 'N' THEN CAST(l_tax AS DECIMAL(4,2)) END)::DOUBLE AS total_tax FROM lineitem",
)
def sum_nullable(t):
    tax = F.when(F.col("l_returnflag") != "N", F.col("l_tax").cast("decimal(4,2)"))
    return dbl(A.total(t["lineitem"], tax, "total_tax"), "total_tax")


def _period_sql(parts: str, n: int) -> str:
    groups = ", ".join(str(i + 1) for i in range(n))
    return (
        f"SELECT {parts}, CAST(SUM({REV_SQL}) AS DOUBLE) AS revenue FROM orders "
        f"JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate IS NOT NULL GROUP BY {groups}"
    )


def _revenue_by_period(t: Tables, **parts: Column) -> DataFrame:
    out = A.by_period(
        t["lineitem"], "l_orderkey", rev(), t["orders"], "o_orderkey", "o_orderdate", parts, "revenue"
    )
    return dbl(out, "revenue")



@query("group_by_year", _period_sql("CAST(YEAR(o_orderdate) AS INTEGER) AS year", 1))
def group_by_year(t):
    return _revenue_by_period(t, year=F.year("o_orderdate"))


@query(
    "group_by_month",
    _period_sql(
        "CAST(YEAR(o_orderdate) AS INTEGER) AS year, CAST(MONTH(o_orderdate) AS INTEGER) AS month", 2
    ),
)
def group_by_month(t):
    return _revenue_by_period(t, year=F.year("o_orderdate"), month=F.month("o_orderdate"))


@query(
    "group_by_quarter",
    _period_sql(
        "CAST(YEAR(o_orderdate) AS INTEGER) AS year, CAST(QUARTER(o_orderdate) AS INTEGER) AS quarter", 2
    ),
)
def group_by_quarter(t):
    return _revenue_by_period(t, year=F.year("o_orderdate"), quarter=F.quarter("o_orderdate"))


@query(
    "group_by_two_dims",
    f"SELECT s_name, p_type, CAST(SUM({REV_SQL}) AS DOUBLE) AS revenue FROM lineitem "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
)
def group_by_two_dims(t):
    pairs = A.sum_by(t["lineitem"], ["l_suppkey", "l_partkey"], rev(), "v")
    with_type = pairs.join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    per_key = A.sum_by(with_type, ["l_suppkey", "p_type"], F.col("v"), "v")
    named = per_key.join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    return dbl(A.sum_by(named, ["s_name", "p_type"], F.col("v"), "revenue"), "revenue")


@query(
    "order_subtotals",
    f"SELECT l_orderkey, CAST(SUM({MONEY_SQL}) AS DOUBLE) AS subtotal FROM lineitem GROUP BY 1",
)
def order_subtotals(t):
    return dbl(order_totals(t, line_money(rev())), "subtotal")


PRODUCT_SALES_SQL = (
    f"SELECT p_type, p_name, SUM({MONEY_SQL}) AS product_sales FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey "
    "WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' "
    "GROUP BY 1, 2"
)


def product_sales(t: Tables, lo: datetime, hi: datetime) -> DataFrame:
    """Category x product sales of orders shipped within a range."""
    orders = shipped_between(t, lo, hi).select("o_orderkey")
    lines = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return A.sum_by_parent(
        lines, "l_partkey", line_money(rev()), t["part"], "p_partkey", ["p_type", "p_name"], "product_sales"
    )


@query(
    "product_sales_in_range",
    f"SELECT p_type, p_name, CAST(product_sales AS DOUBLE) AS product_sales FROM ({PRODUCT_SALES_SQL}) x",
)
def product_sales_in_range(t):
    return dbl(product_sales(t, *Y1997), "product_sales")


@query(
    "category_sales_rollup",
    f"SELECT p_type, CAST(SUM(product_sales) AS DOUBLE) AS category_sales FROM ({PRODUCT_SALES_SQL}) x GROUP BY 1",
)
def category_sales_rollup(t):
    sales = product_sales(t, *Y1997)
    return dbl(A.sum_by(sales, ["p_type"], F.col("product_sales"), "category_sales"), "category_sales")


@query(
    "sales_by_category",
    f"SELECT p_type, p_name, CAST(SUM({MONEY_SQL}) AS DOUBLE) AS product_sales FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey "
    "WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1, 2",
)
def sales_by_category(t):
    orders = R.date_between(t["orders"], "o_orderdate", *Y1997)
    lines = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    out = A.sum_by_parent(
        lines, "l_partkey", line_money(rev()), t["part"], "p_partkey", ["p_type", "p_name"], "product_sales"
    )
    return dbl(out, "product_sales")


@query(
    "min_max_by_key",
    "SELECT p_type, MIN(p_retailprice) AS min_p_retailprice, MAX(p_retailprice) AS max_p_retailprice FROM part GROUP BY 1",
)
def min_max_by_key(t):
    return A.min_max_by(t["part"], ["p_type"], "p_retailprice")


@query(
    "customer_metrics",
    f"SELECT o_custkey, CAST(SUM({REV_SQL}) AS DOUBLE) AS lifetime_value, COUNT(DISTINCT o_orderkey) AS order_count "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def customer_metrics(t):
    metrics = {
        "lifetime_value": F.sum("subtotal").cast("double"),
        "order_count": F.count("o_orderkey"),
    }
    return A.metrics_by(orders_with_totals(t), ["o_custkey"], metrics)


# -------------------------------------------------------------- sort, limit, top-k


@query(
    "row_number_cut",
    "SELECT c_custkey, c_name, rn FROM (SELECT c_custkey, c_name, ROW_NUMBER() OVER (ORDER BY c_custkey) AS rn "
    "FROM customer) x WHERE rn <= 10",
)
def row_number_cut(t):
    rows = L.first_n_by(t["customer"].select("c_custkey", "c_name"), [F.col("c_custkey").asc()], 10)
    return rows.withColumn("rn", F.col("rn").cast("long"))


@query(
    "top_k_per_group",
    "SELECT p_type, p_partkey, p_retailprice, rank FROM (SELECT p_type, p_partkey, p_retailprice, "
    "ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) x WHERE rank <= 5",
)
def top_k_per_group(t):
    rows = t["part"].select("p_type", "p_partkey", "p_retailprice")
    order = [F.col("p_retailprice").desc(), F.col("p_partkey").asc()]
    return L.top_k(rows, ["p_type"], order, 5).withColumn("rank", F.col("rank").cast("long"))


@query("top_n", f"{TOP_CUSTOMERS_SQL} ORDER BY total_revenue DESC, c_name LIMIT 10")
def top_n(t):
    return L.top_n(revenue_per_customer(t), "total_revenue", 10, ["c_name"])


@query("bottom_n", f"{TOP_CUSTOMERS_SQL} ORDER BY total_revenue ASC, c_name LIMIT 10")
def bottom_n(t):
    return L.bottom_n(revenue_per_customer(t), "total_revenue", 10, ["c_name"])


@query(
    "top_products_by_quantity",
    "SELECT p_name, SUM(l_quantity) AS total_quantity FROM lineitem JOIN part ON l_partkey = p_partkey "
    "GROUP BY 1 ORDER BY total_quantity DESC, p_name LIMIT 10",
)
def top_products_by_quantity(t):
    sums = A.sum_by_parent(
        t["lineitem"], "l_partkey", F.col("l_quantity"), t["part"], "p_partkey", ["p_name"], "total_quantity"
    )
    return L.top_n(sums, "total_quantity", 10, ["p_name"])


@query(
    "most_expensive",
    "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
)
def most_expensive(t):
    return L.top_n(t["part"].select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", 10, ["p_partkey"])


@query(
    "multi_key_sort",
    f"SELECT s_name, p_type, CAST(SUM({REV_SQL}) AS DOUBLE) AS revenue FROM lineitem "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 "
    "ORDER BY s_name ASC, revenue DESC",
)
def multi_key_sort(t):
    return group_by_two_dims(t).orderBy(F.col("s_name").asc(), F.col("revenue").desc())


@query(
    "cap_rows",
    "SELECT LEAST(COUNT(*), 10000) AS row_count, COUNT(*) >= 10000 AS truncated FROM lineitem",
)
def cap_rows(t):
    return L.cap_rows(t["lineitem"], 10_000).status()


@query(
    "default_limit",
    "SELECT LEAST(COUNT(*), 100) AS rows_kept FROM (SELECT c_custkey FROM customer UNION ALL "
    "SELECT s_suppkey FROM supplier) x",
)
def default_limit(t):
    both = t["customer"].select("c_custkey").union(t["supplier"].select("s_suppkey"))
    return L.with_default_limit(both, 100, False).agg(F.count("*").alias("rows_kept"))


@query(
    "distinct_capped",
    "SELECT LEAST(COUNT(*), 100) AS rows_kept, LEAST(COUNT(*), 100) AS distinct_rows FROM "
    "(SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) x",
)
def distinct_capped(t):
    rows = L.distinct_capped(t["customer"], ["c_nationkey", "c_mktsegment"], 100)
    kept = F.count("*").alias("rows_kept")
    return rows.agg(kept, F.countDistinct("c_nationkey", "c_mktsegment").alias("distinct_rows"))


@query(
    "preview",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 10",
)
def preview(t):
    rows = t["orders"].filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_totalprice")
    return L.preview(rows, [F.col("o_orderkey").asc()]).rows


@query(
    "preview_status",
    "SELECT LEAST(COUNT(*), 10000) AS row_count, COUNT(*) >= 10000 AS truncated, "
    "'o_orderkey,o_totalprice' AS columns FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def preview_status(t):
    rows = t["orders"].filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_totalprice")
    return L.preview(rows, [F.col("o_orderkey")]).status()


# ------------------------------------------------------------------ set operations


@query(
    "union_distinct",
    "SELECT c_nationkey AS nation, c_name AS name, 'Customers' AS relationship FROM customer "
    "UNION SELECT s_nationkey, s_name, 'Suppliers' FROM supplier",
)
def union_distinct(t):
    cust = t["customer"].select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    supp = t["supplier"].select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return R.union_distinct(
        R.tag(cust, "relationship", "Customers"), R.tag(supp, "relationship", "Suppliers")
    )


@query(
    "union_all",
    "SELECT c_name AS id FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier",
)
def union_all(t):
    return R.union_aligned(
        t["customer"].select(F.col("c_name").alias("id")),
        t["supplier"].select(F.col("s_suppkey").alias("id")),
    )


@query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return t["orders"].select("o_orderstatus", "o_orderpriority").distinct()


# --------------------------------------------------------------- scalar date/number


@query(
    "date_parts",
    "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(MONTH(o_orderdate) AS INTEGER) AS m, "
    "CAST(QUARTER(o_orderdate) AS INTEGER) AS q, strftime(o_orderdate, '%Y') AS year_name, "
    "substring(strftime(o_orderdate, '%Y/%m/%d'), 1, 4) AS year_text FROM orders",
)
def date_parts(t):
    c = F.col("o_orderdate")
    return t["orders"].select(
        "o_orderkey", F.year(c).alias("y"), F.month(c).alias("m"), F.quarter(c).alias("q"),
        year_name(c).alias("year_name"), year_text(c).alias("year_text"),
    )


@query(
    "round_and_cast",
    "SELECT l_orderkey, l_linenumber, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)), 0) AS DOUBLE) AS price, "
    "CAST(TRUNC(CAST(l_discount AS DECIMAL(4,2)) * 100) AS INTEGER) AS discount_pct FROM lineitem",
)
def round_and_cast(t):
    price = F.round(F.col("l_extendedprice").cast("decimal(12,2)"), 0).cast("double")
    pct = (F.col("l_discount").cast("decimal(4,2)") * 100).cast("int")
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", price.alias("price"), pct.alias("discount_pct")
    )
