from __future__ import annotations

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import vectors as V
from tallyhouse.sources.audit_log import read_audit, write_audit
from tallyhouse.sources.collections import (
    create_collection, export_csv, read_collection, upsert_collection, upsert_documents, write_collection, write_report, written_count,
)


def make(n, dims, seed, repeat=0):
    """Vectors of which ``repeat`` are one and the same."""
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, dims)).round(3)
    m[:repeat] = m[0]
    return m


def brute(q, c, n):
    out = {}
    for i, a in enumerate(q):
        d = []
        for j, b in enumerate(c):
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            d.append((round(1 - float(a @ b) / norm, 9) if norm else 1.0, j))
        out[i] = [j for _, j in sorted(d)[:n]]
    return out


def frames(spark, q, c):
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    cs = spark.createDataFrame(
        [(j, v.tolist(), "a" if j % 2 else "b") for j, v in enumerate(c)], "id int, embedding array<double>, kind string"
    )
    return qs, cs.repartition(4)


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("block", [4_096, 5])
def test_search_is_exact_with_ties_and_zero_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    q, c = make(12, 5, 1), make(100, 5, 2, repeat=40)
    c[50] = 0
    qs, cs = frames(spark, q, c)
    assert ranked(V.vector_search(qs, cs, 7)) == brute(q, c, 7)
    assert len(ranked(V.vector_search(qs, cs, 500))[0]) == 100  # no more than there are


def test_vectors_that_take_no_part(spark):
    qs = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query_id int, embedding array<float>")
    cs = spark.createDataFrame(
        [(0, [1.0, 0.0], "a"), (1, None, "a"), (2, [1.0], "a"), (3, [None, 1.0], "a")], "id int, embedding array<float>, kind string"
    )
    assert ranked(V.vector_search(qs, cs, 3)) == {0: [0]}


@pytest.mark.parametrize("block", [4_096, 2])
def test_queries_of_any_length_in_any_order(spark, monkeypatch, block):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    rows = [(0, []), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0])]
    cs = spark.createDataFrame([(9, []), (5, [1.0, 0.1]), (6, [0.1, 1.0]), (7, [0.5, 0.0, 0.0])], "id int, embedding array<double>")
    for order in (rows, rows[::-1]):
        qs = spark.createDataFrame(order, "query_id int, embedding array<double>").coalesce(1)
        assert ranked(V.vector_search(qs, cs, 3)) == {1: [7], 2: [5, 6], 3: [6, 5]}


def test_queries_beyond_a_block_stay_in_spark(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_, **__):
        raise AssertionError("queries came to the driver")

    def few(self, collect=DataFrame.collect):
        rows = collect(self)
        return rows if len(rows) <= V.QUERY_BLOCK else refused()

    q, c = make(60, 5, 1), make(100, 5, 2, repeat=40)
    qs, cs = frames(spark, q, c)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "QUERY_STEP", 3)
    monkeypatch.setattr(V, "CORPUS_BYTES", 400)
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", refused)
        m.setattr(DataFrame, "collect", few)
        hits = V.vector_search(qs, cs, 7)
    assert ranked(hits) == brute(q, c, 7)


def test_search_empty_and_kind(spark):
    q, c = make(3, 4, 1), make(20, 4, 2)
    qs, cs = frames(spark, q, c)
    assert V.vector_search(qs, cs.limit(0), 3).count() == 0
    assert V.vector_search(qs.limit(0), cs, 3).count() == 0
    got = ranked(V.vector_search(qs, cs, 3, kind="a"))
    odd = brute(q, c[1::2], 3)
    assert got == {k: [1 + 2 * j for j in v] for k, v in odd.items()}


def test_merge_case(spark):
    hits = spark.createDataFrame(
        [(1, "a", 0.5, None), (1, "b", 0.1, None), (1, "c", 0.2, "agent"), (1, "d", None, "agent")],
        "query_id int, id string, distance double, source string",
    )
    got = [(r["id"], r["source"]) for r in V.merge_hits(hits, 2).orderBy("rank").collect()]
    assert got == [("b", None), ("c", "agent")]
    assert V.merge_hits(hits, 4).orderBy("rank").collect()[3]["id"] == "d"


def test_semantic_score(spark):
    df = spark.createDataFrame([(1, "e", 0.3), (1, "e", 0.6), (1, "f", 1.5)], "question_id int, example_id string, distance double")
    got = {r["example_id"]: r["semantic_score"] for r in V.semantic_score(df).collect()}
    assert got == {"e": pytest.approx(0.7), "f": 0.0}


def test_embed_once_sees_each_text_once(spark, work):
    def embed(texts):
        with open(f"{work}/seen", "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "b", "aa", None, "aa"])], "i int, t string")
    rows = V.embed_once(df, "t", embed).collect()
    assert {r["i"]: r["embedding"] for r in rows} == {0: [2.0], 1: [1.0], 2: [2.0], 3: None, 4: [2.0]}
    with open(f"{work}/seen") as f:
        assert sorted(f.read().split()) == ["aa", "b"]


def test_span_mean_pool(spark):
    tokens = [("d", i * 10, i * 10 + 10, [float(i), 1.0]) for i in range(300)]
    spans = [("d", 0, 0, 30), ("d", 1, 5, 14), ("d", 2, 1_000, 2_100), ("d", 3, 995, 1_005)]
    got = {
        r["span_id"]: r["embedding"]
        for r in V.span_mean_pool(
            spark.createDataFrame(tokens, "doc_id string, start int, end int, embedding array<double>"),
            spark.createDataFrame(spans, "doc_id string, span_id int, start int, end int"),
            spark.createDataFrame([("d", [9.0, 9.0])], "doc_id string, embedding array<double>"), 2, bucket_chars=64,
        ).collect()
    }
    assert got == {0: [1.0, 1.0], 1: [9.0, 9.0], 2: [pytest.approx(154.5), 1.0], 3: [9.0, 9.0]}


@pytest.mark.parametrize(("dims", "slices"), [(384, 1_024), (3, 2), (16, 1_024)])
def test_span_mean_pool_against_all_pairs(spark, monkeypatch, dims, slices):
    """Overlapping and long tokens, spans over many buckets, texts without any token inside."""
    monkeypatch.setattr(V, "SLICE_BUCKETS", slices)
    rng = np.random.default_rng(dims)
    starts = rng.integers(0, 3_000, 250)
    ends = starts + np.where(rng.random(250) < 0.1, rng.integers(0, 900, 250), rng.integers(0, 12, 250))
    vectors = rng.standard_normal((250, dims)).round(3)
    docs = ["d", "e"]
    tokens = [(docs[i % 2], int(starts[i]), int(ends[i]), vectors[i].tolist()) for i in range(250)]
    odd = [("d", 5, 1, vectors[0].tolist()), ("d", 5, 9, None), ("d", 5, 9, [None] * dims), ("d", 5, 9, [1.0] * (dims + 1)), (None, 5, 9, vectors[0].tolist())]
    edges = rng.integers(0, 3_500, (40, 2))
    spans = [(docs[i % 2], i, int(min(e)), int(max(e))) for i, e in enumerate(edges)] + [("d", 98, 64, 128), ("f", 99, 0, 9), ("d", 100, None, 9)]
    got = {
        r["span_id"]: r["embedding"]
        for r in V.span_mean_pool(
            spark.createDataFrame(tokens + odd, "doc_id string, start int, end int, embedding array<double>").repartition(3),
            spark.createDataFrame(spans, "doc_id string, span_id int, start int, end int"),
            spark.createDataFrame([("d", [9.0] * dims), ("e", [8.0] * dims)], "doc_id string, embedding array<double>"), dims, bucket_chars=64,
        ).collect()
    }
    assert len(got) == len(spans)
    for doc, span, a, b in spans:
        v = [x for d, s, e, x in tokens if a is not None and d == doc and s >= a and e <= b]
        want = np.mean(v, axis=0).tolist() if v else {"d": [9.0] * dims, "e": [8.0] * dims}.get(doc)
        assert got[span] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_collection_stats_keeps_a_null_collection(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "collection string, id int")
    assert {r["collection"]: r["documents"] for r in V.collection_stats(df).collect()} == {None: 2, "a": 1}


def test_collection_stats(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "collection string, id int")
    got = {r["collection"]: (r["documents"], r["sample_ids"]) for r in V.collection_stats(df).collect()}
    assert got == {"a": (3, [1, 2]), "b": (1, [9])}


def test_upsert_is_idempotent_and_last_write_wins(spark):
    old = spark.createDataFrame([("x", "old"), ("y", "keep")], "id string, document string")
    batch = spark.createDataFrame([("x", "first", 1), ("x", "last", 2), ("z", "new", 1)], "id string, document string, seq int")
    once = upsert_documents(old, batch, "seq")
    want = [("x", "last"), ("y", "keep"), ("z", "new")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, upsert_documents(once, batch, "seq").collect())) == want


def test_upsert_with_null_order(spark):
    old = spark.createDataFrame([("x", "old")], "id string, document string")
    batch = spark.createDataFrame([("x", "undated", None), ("x", "dated", 1), ("y", "only", None)], "id string, document string, seq int")
    assert sorted(map(tuple, upsert_documents(old, batch, "seq").collect())) == [("x", "dated"), ("y", "only")]
    assert written_count(batch).first()["written"] == 2


def test_upsert_touches_only_its_buckets(spark, work):
    path = f"{work}/bucketed"
    names = lambda: {str(f.relative_to(path)) for f in pathlib.Path(path).rglob("*.parquet")}
    rows = lambda: sorted(map(tuple, read_collection(spark, path).collect()), key=str)
    old = spark.createDataFrame([(f"d{i}", f"text {i}", i) for i in range(300)] + [(None, "no id", -1)], "id string, document string, size int")
    create_collection(old, path, 16)
    before, files = rows(), names()
    assert before == sorted(map(tuple, old.collect()), key=str) and len(files) == 16
    batch = spark.createDataFrame(
        [("d7", "first", 1, 1, "x"), ("d7", "last", 2, 2, "x"), ("new", "n", 3, 1, "x")], "id string, document string, size int, seq int, more string"
    )
    upsert_collection(batch, path, "seq")
    want = sorted([r for r in before if r[0] != "d7"] + [("d7", "last", 2), ("new", "n", 3)], key=str)
    assert rows() == want and 14 <= len(files & names()) <= 15
    upsert_collection(batch, path, "seq")
    assert rows() == want and 14 <= len(files & names()) <= 15
    kept = names()
    upsert_collection(batch.limit(0), path, "seq")
    assert names() == kept
    write_collection(old, f"{work}/plain")
    with pytest.raises(ValueError, match="create_collection"):
        upsert_collection(batch, f"{work}/plain", "seq")


def test_sinks(spark, work):
    df = spark.createDataFrame([(1, 'say "hi", ok', None), (2, "عميل", 2.5)], "id int, t string, v double")
    export_csv(df.coalesce(1), f"{work}/csv")
    text = "\n".join(r[0] for r in spark.read.text(f"{work}/csv").collect())
    assert text == '"id","t","v"\n"1","say ""hi"", ok",""\n"2","عميل","2.5"'
    write_collection(df, f"{work}/c")
    with pytest.raises(Exception, match="already exists"):
        write_collection(df, f"{work}/c")
    write_collection(df.limit(0), f"{work}/c", force=True)
    assert spark.read.parquet(f"{work}/c").count() == 0
    write_report(df.select("id"), df.select("t"), f"{work}/r")
    assert spark.read.json(f"{work}/r/results").count() == 2


def test_audit_log(spark, work):
    rows = spark.createDataFrame([("tool", "r1", None), ("tool", "r2", "given")], "kind string, request_id string, audit_id string")
    write_audit(rows, f"{work}/a")
    write_audit(rows.drop("audit_id"), f"{work}/a")
    back = read_audit(spark, f"{work}/a").collect()
    assert len(back) == 4 and len({r["audit_id"] for r in back}) == 4
    assert sum(r["audit_id"] == "given" for r in back) == 1 and all(r["ts_ms"] > 1_600_000_000_000 for r in back)
