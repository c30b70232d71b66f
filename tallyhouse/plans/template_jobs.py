"""Generic per-table analytics over the source tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyhouse.operators import templates as P
from tallyhouse.plans.registry import query
from tallyhouse.plans.retail import RELATIONSHIPS


@query("lookup_top_n", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 20")
def lookup_top_n(t):
    return P.lookup_top_n(t["supplier"], ["s_suppkey"], "s_name", 20)


@query("table_count", "SELECT COUNT(o_orderkey) AS record_count FROM orders")
def table_count(t):
    return P.table_count(t["orders"], "o_orderkey")


@query("group_count", "SELECT lang, COUNT(doc_id) AS cnt FROM documents GROUP BY 1 ORDER BY cnt DESC, lang")
def group_count(t):
    return P.group_count(t["documents"], "lang", "doc_id")


@query(
    "latest_records",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders ORDER BY orders.o_orderdate DESC, o_orderkey LIMIT 10",
)
def latest_records(t):
    rows = P.latest(t["orders"], "o_orderkey", "o_orderdate")
    return rows.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "monthly_trend",
    "SELECT CAST(YEAR(l_shipdate) AS INTEGER) AS y, CAST(MONTH(l_shipdate) AS INTEGER) AS m, COUNT(l_orderkey) AS cnt "
    "FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2",
)
def monthly_trend(t):
    return P.monthly_trend(t["lineitem"], "l_shipdate", "l_orderkey")


@query(
    "not_null_lookup",
    "SELECT d.doc_id, source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL "
    "ORDER BY source, d.doc_id LIMIT 100",
)
def not_null_lookup(t):
    rows = t["documents"].select("doc_id", "source").join(t["labels"], "doc_id", "left")
    return P.not_null_lookup(rows, "doc_id", "source", "quality")


@query(
    "children_per_parent",
    "SELECT s_name, COUNT(*) AS cnt FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
)
def children_per_parent(t):
    return P.children_per_parent(t["lineitem"], t["supplier"], RELATIONSHIPS["line_supplier"], "s_name")


@query(
    "rank_parents",
    "SELECT c_name, COUNT(*) AS cnt FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY cnt DESC, c_name LIMIT 10",
)
def rank_parents(t):
    return P.rank_parents(t["orders"], t["customer"], RELATIONSHIPS["order_customer"], "c_name")


KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"],
    "pages": ["page_id"], "conversations": ["conv_id", "turn"],
}


def _autoprofile_sql() -> str:
    counts = [f"SELECT '{n}_count' AS template, COUNT({k[0]}) AS total FROM {n}" for n, k in KEYS.items()]
    links = [
        "SELECT 'orders_join_customer', COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey",
        "SELECT 'lineitem_join_supplier', COUNT(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    ]
    return " UNION ALL ".join(counts + links)


@query("autoprofile", _autoprofile_sql())
def autoprofile(t):
    """The counting templates of every table and two links, one row each."""
    rels = [RELATIONSHIPS["order_customer"], RELATIONSHIPS["line_supplier"]]
    made = P.autoprofile(t, KEYS, rels)
    rows = [
        df.agg(F.sum(df.columns[-1]).alias("total")).select(F.lit(name).alias("template"), "total")
        for name, df in made.items()
        if name.endswith("_count") or "_join_" in name
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)
