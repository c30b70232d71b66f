"""The substring join against a plain test of every pair, and its index."""

from __future__ import annotations

import random
import re

from tallyhouse.operators import matching as M

WORDS = ["la", "casa", "de", "x", "total", "revenue", "by", "e", "año", "42"]
SEPS = [" ", " ", "-", ", ", ".", "  ", "\n"]


def made(r, n):
    return "".join(r.choice(WORDS) + r.choice(SEPS) for _ in range(n))


def pairs(spark, texts, needles, index=None):
    t = spark.createDataFrame(texts, "id long, body string")
    n = spark.createDataFrame([(i, x) for i, x in enumerate(needles)], "no long, needle string")
    got = M.contains_join(t, "id", "body", n, "needle", index).select("id", "no").collect()
    want = [(i, k) for i, b in texts for k, x in enumerate(needles) if b is not None and x and x in b]
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, want))


def test_substrings_of_every_kind(spark):
    r = random.Random(4)
    texts = [(i, made(r, r.randrange(0, 30))) for i in range(120)]
    texts += [(3, texts[5][1]), (None, texts[6][1]), (None, None), (7, None), (8, ""), (9, "la " * 5_000), (9, "la " * 5_000)]
    needles = ["", None, "la", "a", "la casa", "a casa d", "casa", "casa de x", "sa de to", "l revenue b", "año", "ñ", "-", ", ", " \n", "42 42", "zzz", "la zzz de x", "la la la", "revenue"]
    needles += [b[k : k + r.randrange(1, 25)] for _, b in texts[:100] if b for k in [r.randrange(len(b))]]
    got, want = pairs(spark, texts, needles)
    assert got == want and len(want) > 1_000


def test_only_some_kinds_of_needles(spark):
    texts = [(1, "one two three four five"), (2, "one two"), (3, "xone twox")]
    for needles in ([], ["missing"], ["one"], ["e two t"], ["ne two three f"], ["o", "ne two three f"], ["two three four six"]):
        got, want = pairs(spark, texts, needles)
        assert got == want, needles
    assert pairs(spark, [], ["one"])[0] == []


def test_texts_are_cut_once_and_shared(spark):
    texts = [(i, f"row {i % 7} of many") for i in range(50)]
    index = M.index_texts(spark.createDataFrame(texts, "id long, body string"), "id", "body")
    needles = spark.createDataFrame([("6 of",), ("row",), ("row 3 of many",)], "needle string")
    joined = M.contains_join(None, "id", "body", needles, "needle", index)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and joined.count() == 50 + 7 + 7
    assert pairs(spark, texts, ["6 of", "row"], index)[0] == pairs(spark, texts, ["6 of", "row"])[1]


def test_a_word_of_every_text_is_dealt_by_salt(spark):
    texts = [(i, f"common word{i}") for i in range(400)]
    index = M.index_texts(spark.createDataFrame(texts, "id long, body string"), "id", "body")
    anchors = spark.createDataFrame([("common",)], "w string").selectExpr("xxhash64(w) AS _gram")
    dealt = M._dealt(index.selectExpr("_key", "explode(_grams) AS _gram"), anchors)
    assert dealt.count() == 400
    salts = index.selectExpr(f"pmod(xxhash64(_key), {M.SALTS}) AS s").groupBy("s").count().collect()
    assert len(salts) == M.SALTS and max(r["count"] for r in salts) < 60


def test_needles_visit_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 3)
    texts = [(1, "another the, other"), (2, "the"), (2, "the"), (None, "a b-c"), (4, ""), (5, "x" * 50)]
    needles = [(1, "the"), (2, "the"), (3, "other"), (4, "r t"), (5, ", "), (6, "b-c"), (7, "x" * 20), (None, "e"), (9, "the, ot"), (10, "")]
    t = spark.createDataFrame(texts, "id long, body string")
    n = spark.createDataFrame(needles, "no long, needle string")
    want = sorted(((i, k) for i, x in texts for k, w in needles if w and w in x), key=str)
    for tasks in (None, 4):
        got = M.contains_join(t, "id", "body", n, "needle", tasks=tasks)
        assert sorted(((r.id, r.no) for r in got.select("id", "no").collect()), key=str) == want


def test_long_needles_are_not_repeated_for_their_words(spark, monkeypatch):
    texts = [(1, "zero one two three four five six"), (2, "one two"), (3, "o")]
    needles = ["o one two three four f", "x one two three four nine", "ne tw", "o one x", "o two t", "one"]
    wrote, write = {}, M.materialize

    def spy(df, label):
        wrote[label] = (df._jdf.queryExecution().executedPlan().toString(), write(df, label))
        return wrote[label][1]

    monkeypatch.setattr(M, "materialize", spy)
    got, want = pairs(spark, texts, needles)
    assert got == want and len(want) == 5
    # The rarest word is found for a key of the needle; texts are sorted by none of these steps.
    assert not [label for label, (plan, _) in wrote.items() if re.search(r"Aggregate\(keys?=\[_needle#\d+\], functions=\[\w", plan)]
    assert wrote["rarest"][1].columns == ["_of", "_gram"]
    kept = {r._needle: (len(r._pairs), len(r._words), r._runs) for r in wrote["needles"][1].collect()}
    assert kept["o one two three four f"] == (3, 0, None) and kept["o two t"] == (0, 1, None) and kept["one"] == (0, 0, ["one"])


def test_few_needles_write_no_index_and_make_no_stretches(spark, monkeypatch):
    r = random.Random(5)
    texts = [(i, made(r, r.randrange(0, 20)) + f"item-{i}" * (i % 3)) for i in range(60)] + [(1, "item-1"), (None, ""), (2, None)]
    needles = [f"item-{i}" for i in range(0, 70, 7)] + ["la casa", "a casa d", "sa de to", "o", ", ", "zzz zzz", "", None]
    needles += [b[k : k + r.randrange(8, 25)] for _, b in texts[:40] if b for k in [r.randrange(len(b))]]
    wrote, write = {}, M.materialize

    def spy(df, label):
        wrote[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(M, "materialize", spy)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got, want = pairs(spark, texts, needles)
        assert got == want and len(want) > 100
        # The postings stay where the texts lie, and only those that are asked for are written.
        assert "text-index" not in wrote and "SortMergeJoin" not in wrote["postings"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    t = spark.createDataFrame(texts, "id long, body string")
    n = spark.createDataFrame([(i, x) for i, x in enumerate(needles)], "no long, needle string")
    plan = M.contains_join(t, "id", "body", n, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan
    # The same rows where needles are many, or start in many ways.
    for grams, starts in ((0, 64), (0, 0), (10**6, 0)):
        monkeypatch.setattr(M, "FEW_GRAMS", grams)
        monkeypatch.setattr(M, "FEW_STARTS", starts)
        assert pairs(spark, texts, needles)[0] == want
