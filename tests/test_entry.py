from __future__ import annotations

import ast
import os

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and entry.FLAGSHIP in sql
    assert entry.entry(spark).columns == ["c_name", "c_mktsegment", "total_revenue", "n"]


def test_no_local_checkpoint_and_no_cross_join():
    for folder, _, files in os.walk(os.path.join(ROOT, "tallyhouse")):
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    tree = ast.parse(f.read())
                calls = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
                assert not calls & {"localCheckpoint", "crossJoin", "toPandas"}, name
