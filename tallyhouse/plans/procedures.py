"""Views that can be registered by name, and parameterised queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.dates import year_name, year_text
from tallyhouse.functions.money import line_money
from tallyhouse.operators import aggregates as A
from tallyhouse.operators import relational as R
from tallyhouse.plans import retail
from tallyhouse.plans.registry import query
from tallyhouse.plans.retail import MONEY_SQL, REV_SQL, rev
from tallyhouse.sources.tables import Tables

# Years that have sales; any other value falls back to the last of them.
KNOWN_YEARS = ("1996", "1997", "1998")


def current_products(t: Tables) -> DataFrame:
    """Products still on sale (size 1 stands for discontinued)."""
    return t["part"].filter(F.col("p_size") != 1).select("p_partkey", "p_name")


def alphabetical_products(t: Tables) -> DataFrame:
    """Every column of the products on sale, with the category."""
    return t["part"].filter(F.col("p_size") != 1)


def orders_with_customer(t: Tables) -> DataFrame:
    """Orders beside the customer they belong to."""
    joined = R.join_by_relationship(t, retail.RELATIONSHIPS["order_customer"])
    return joined.select("o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_nationkey", "c_mktsegment")


def products_by_category(t: Tables) -> DataFrame:
    """Products on sale by category."""
    return t["part"].filter(F.col("p_size") != 1).select("p_type", "p_name", "p_size")


def order_details_extended(t: Tables) -> DataFrame:
    """Lines with the product name and the price rounded to cents."""
    joined = R.join_by_relationship(t, retail.RELATIONSHIPS["line_part"])
    return joined.select(
        "l_orderkey", "l_partkey", "p_name", "l_quantity", "l_discount",
        line_money(rev()).cast("double").alias("extended_price"),
    )


def summary_of_sales(t: Tables) -> DataFrame:
    """Subtotals of the orders that have shipped."""
    rows = retail.orders_with_totals(t, line_money(rev())).filter(F.col("o_orderstatus") == "F")
    return retail.dbl(rows.select("o_orderkey", "subtotal"), "subtotal")


VIEWS = {
    "customer_and_suppliers_by_city": retail.union_distinct,
    "alphabetical_list_of_products": alphabetical_products,
    "current_product_list": current_products,
    "orders_qry": orders_with_customer,
    "products_above_average_price": retail.above_average_all,
    "products_by_category": products_by_category,
    "quarterly_orders": retail.right_join_distinct,
    "invoices": retail.invoices,
    "order_details_extended": order_details_extended,
    "order_subtotals": retail.order_subtotals,
    "product_sales_for_1997": retail.product_sales_in_range,
    "category_sales_for_1997": retail.category_sales_rollup,
    "sales_by_category": retail.sales_by_category,
    "sales_totals_by_amount": retail.large_sales,
    "summary_of_sales_by_quarter": summary_of_sales,
    "summary_of_sales_by_year": summary_of_sales,
}


def register_views(spark: SparkSession, t: Tables) -> list[str]:
    """Register the named views; Catalyst inlines them wherever they are used."""
    for name, build in VIEWS.items():
        build(t).createOrReplaceTempView(name)
    return list(VIEWS)


@query(
    "view_current_products",
    "SELECT p_partkey, p_name FROM part WHERE p_size <> 1",
)
def view_current_products(t):
    return current_products(t)


@query(
    "view_orders_with_customer",
    "SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_nationkey, c_mktsegment "
    "FROM customer JOIN orders ON c_custkey = o_custkey",
)
def view_orders_with_customer(t):
    return orders_with_customer(t)


@query(
    "view_products_by_category", "SELECT p_type, p_name, p_size FROM part WHERE p_size <> 1"
)
def view_products_by_category(t):
    return products_by_category(t)


@query(
    "view_order_details_extended",
    f"SELECT l_orderkey, l_partkey, p_name, l_quantity, l_discount, CAST({MONEY_SQL} AS DOUBLE) AS extended_price "
    "FROM part JOIN lineitem ON p_partkey = l_partkey",
)
def view_order_details_extended(t):
    return order_details_extended(t)


@query(
    "view_summary_of_sales",
    f"SELECT o_orderkey, CAST(SUM({MONEY_SQL}) AS DOUBLE) AS subtotal FROM orders JOIN lineitem "
    "ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1",
)
def view_summary_of_sales(t):
    return summary_of_sales(t)


@query(
    "view_on_view",
    f"SELECT p_type, CAST(SUM(product_sales) AS DOUBLE) AS category_sales FROM ({retail.PRODUCT_SALES_SQL}) x "
    "GROUP BY 1",
)
def view_on_view(t):
    register_views(t.spark, t)
    return t.spark.sql(
        "SELECT p_type, CAST(SUM(CAST(product_sales AS DECIMAL(28,4))) AS DOUBLE) AS category_sales "
        "FROM product_sales_for_1997 GROUP BY p_type"
    )


# ---------------------------------------------------------- parameterised queries


def customer_history(t: Tables, customer_id: int) -> DataFrame:
    """Units per product for one customer."""
    orders = t["orders"].filter(F.col("o_custkey") == customer_id).select("o_orderkey")
    lines = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return A.sum_by_parent(
        lines, "l_partkey", F.col("l_quantity"), t["part"], "p_partkey", ["p_name"], "total"
    )


def order_lines(t: Tables, order_id: int) -> DataFrame:
    """Rounded price, discount as a whole percent and rounded extended price of one order."""
    lines = t["lineitem"].filter(F.col("l_orderkey") == order_id)
    joined = lines.join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        "p_name",
        F.round(F.col("p_retailprice").cast("decimal(12,2)"), 2).cast("double").alias("unit_price"),
        "l_quantity",
        (F.col("l_discount").cast("decimal(4,2)") * 100).cast("int").alias("discount"),
        F.round(rev(), 2).cast("double").alias("extended_price"),
    )


def customer_orders(t: Tables, customer_id: int) -> DataFrame:
    """One customer's orders by id."""
    rows = t["orders"].filter(F.col("o_custkey") == customer_id)
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderkey")


def employee_sales(t: Tables, lo: datetime, hi: datetime) -> DataFrame:
    """Order subtotals per handler for orders shipped within a range."""
    rows = retail.totals_of(t, retail.shipped_between(t, lo, hi), line_money(rev()))
    return retail.dbl(
        rows.select("o_orderpriority", "o_orderkey", F.col("subtotal").alias("sale_amount")), "sale_amount"
    )


def sales_by_year(t: Tables, lo: datetime, hi: datetime) -> DataFrame:
    """Subtotals with the year as text for orders shipped within a range."""
    rows = retail.totals_of(t, retail.shipped_between(t, lo, hi), line_money(rev()))
    return retail.dbl(
        rows.select("o_orderkey", "subtotal", year_name(F.col("o_orderdate")).alias("year")), "subtotal"
    )


def category_year(t: Tables, category: str, year: str = "1998") -> DataFrame:
    """Rounded purchases per product of one category in one year."""
    chosen = year if year in KNOWN_YEARS else KNOWN_YEARS[-1]
    # The range prunes at the scan; the text comparison is what the query asks for.
    orders = R.year_filter(t["orders"], "o_orderdate", int(chosen))
    orders = orders.filter(year_text(F.col("o_orderdate")) == chosen).select("o_orderkey")
    parts = t["part"].filter(F.col("p_type") == category)
    lines = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    sums = A.sum_by_parent(
        lines, "l_partkey", rev().cast("decimal(14,2)"), parts, "p_partkey", ["p_name"], "total_purchase"
    )
    rounded = F.round("total_purchase", 0).cast("double").alias("total_purchase")
    return sums.select("p_name", rounded).orderBy("p_name")


@query(
    "customer_history",
    "SELECT p_name, SUM(l_quantity) AS total FROM part, lineitem, orders, customer WHERE c_custkey = 42 AND "
    "c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey GROUP BY 1",
)
def customer_history_q(t):
    return customer_history(t, 42)


@query(
    "order_lines",
    f"SELECT p_name, ROUND(CAST(p_retailprice AS DECIMAL(12,2)), 2)::DOUBLE AS unit_price, l_quantity, "
    "CAST(TRUNC(CAST(l_discount AS DECIMAL(4,2)) * 100) AS INTEGER) AS discount, "
    f"ROUND({REV_SQL}, 2)::DOUBLE AS extended_price FROM part, lineitem WHERE l_partkey = p_partkey AND l_orderkey = 7",
)
def order_lines_q(t):
    return order_lines(t, 7)


@query(
    "customer_orders",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 42 ORDER BY o_orderkey",
)
def customer_orders_q(t):
    return customer_orders(t, 42)


_SHIPPED_RANGE = (
    "o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-07-01' AND TIMESTAMP '1998-03-31'"
)
_RANGE = (datetime(1996, 7, 1), datetime(1998, 3, 31))


@query(
    "employee_sales_between",
    f"SELECT o_orderpriority, o_orderkey, CAST(SUM({MONEY_SQL}) AS DOUBLE) AS sale_amount FROM orders "
    f"JOIN lineitem ON o_orderkey = l_orderkey WHERE {_SHIPPED_RANGE} GROUP BY 1, 2",
)
def employee_sales_between(t):
    return employee_sales(t, *_RANGE)


@query(
    "sales_by_year_between",
    f"SELECT o_orderkey, CAST(SUM({MONEY_SQL}) AS DOUBLE) AS subtotal, strftime(ANY_VALUE(o_orderdate), '%Y') AS year "
    f"FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {_SHIPPED_RANGE} GROUP BY 1",
)
def sales_by_year_between(t):
    return sales_by_year(t, *_RANGE)


@query(
    "sales_by_category_year",
    f"SELECT p_name, ROUND(SUM(CAST({REV_SQL} AS DECIMAL(14,2))), 0)::DOUBLE AS total_purchase FROM lineitem, orders, part "
    "WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND p_type = 'PROMO' AND YEAR(o_orderdate) = 1998 "
    "GROUP BY 1 ORDER BY 1",
)
def sales_by_category_year(t):
    return category_year(t, "PROMO", "2031")
