"""The pipeline on a small folder, and its stages on odd rows."""

from __future__ import annotations

import os

import corpus_pipeline as P
from tallyhouse.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 20_000, "en", "a", 100_000), (3, "a b c d e f", "en", "b", 11)]


def test_stages_keep_the_columns_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    for rows in (ODD, []):
        for name, stage in P.STAGES[:-1]:
            docs = spark.createDataFrame(rows, DOCS)
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            if name != "mixing":
                ids = {r.doc_id for r in out.collect()}
                assert ids <= {r[0] for r in rows} and (not rows or {2, 3} <= ids), name
        assert P.STAGES[-1][1](spark, spark.createDataFrame(rows, DOCS), folder).count() == len(rows)


def test_every_operator_has_its_query():
    named = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert named == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
    assert P.ORACLE_SQL is None and os.path.basename(P.__file__) == "corpus_pipeline.py"


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(i, f"some text of row {i}", "en", "a", 9) for i in range(5)], DOCS)
    extra = docs.selectExpr("*", "1 AS ids", "2 AS template", "3 AS root", "4 AS size", "5 AS pattern")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, extra, "/root/testdata/sf0.001").columns == extra.columns, name
