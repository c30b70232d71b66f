"""Repeated ids in the index search, and token counts of tables whose rows move."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, imi, tokenfiles


def test_repeated_ids_against_all(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((600, 8)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    # The same row three times, one id with other vectors, copies of a vector under other ids.
    rows += [rows[50]] * 2 + [(100, base[7].tolist()), (100, base[100].tolist()), (100, (-base[100]).tolist())]
    rows += [(700 + i, base[50].tolist()) for i in range(3)] + [(900, base[9].tolist())] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = imi.search(df, df.filter("vec_id % 50 = 0"), visit=1.0, centroids=4).collect()
    want = collections.Counter()
    all_v = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    norm = np.linalg.norm(all_v, axis=1)
    for at, (i, _) in enumerate(rows):
        if i % 50 == 0:
            score = (all_v @ all_v[at]) / (norm * norm[at])
            order = [j for j in np.lexsort((ids, -score.round(12))) if j != at][:5]
            want.update((i, rank, int(ids[j]), round(float(score[j]), 9)) for rank, j in enumerate(order, 1))
    assert collections.Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == want


def test_blocks_stream_in_batches(spark, monkeypatch):
    """Many small blocks and batches give what one block gives."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((500, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 5 = 0")
    found = lambda: sorted(map(tuple, imi.search(df, asked, visit=1.0, centroids=3).collect()))
    once = found()
    monkeypatch.setattr(imi, "BLOCK", 16)
    monkeypatch.setattr(imi, "BATCH", 3)
    assert [r[:3] for r in found()] == [r[:3] for r in once] and len(once) == 500


def test_counts_of_moving_rows(spark):
    path = bpe.public_path("byte_bpe_50k.tiktoken")
    rows = [(i, "word " * (i % 37)) for i in range(200)] + [(7, "twice"), (7, "twice"), (None, "no id"), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    enc = tokenfiles.encoding(path)
    want = collections.Counter((i, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    for moved in (docs.repartition(6), docs.repartition(3, F.rand()), docs.orderBy(F.rand()), docs.coalesce(1)):
        got = tokenfiles.counted(moved, path).collect()
        assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == want
        assert len({(r.part, r.position) for r in got}) == len(rows)
    assert tokenfiles.counted(docs.limit(0), path).count() == 0


def test_ids_of_other_kinds(spark):
    path = bpe.public_path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([("a P\u00c4 1", "one two"), ("", ""), (None, "x")], "doc_id string, text string")
    got = {r.doc_id: r.n_tokens for r in tokenfiles.counted(docs, path).collect()}
    assert got == {"a P\u00c4 1": 2, "": 0, None: 1}


def test_a_lost_count_is_an_error(spark, tmp_path):
    path = bpe.public_path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string").coalesce(1)
    folder = str(tmp_path / "flat")
    tokenfiles.write_flat(docs, path, folder, id_col="doc_id")
    placed = tokenfiles.written_ids(spark, folder, "long")
    with pytest.raises(Exception, match="no count"):
        tokenfiles.matched(placed, tokenfiles.counts(spark, folder).limit(1)).collect()


def test_a_long_part_is_several_files(spark, tmp_path, monkeypatch):
    path = bpe.public_path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 64, raising=False)
    rows = [(i if i % 5 else None, "word " * (i % 7) if i % 3 else None) for i in range(90)] + [(95, "word " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = tmp_path / "flat"
    tokenfiles.write_flat(docs, path, str(folder), id_col="doc_id")
    sizes = sorted(f.stat().st_size for f in folder.glob("ids=0/*.txt"))
    assert len(sizes) > 5 and sizes[-2] < 64 + 2 * 8
    got = tokenfiles.matched(tokenfiles.written_ids(spark, str(folder), "long"), tokenfiles.counts(spark, str(folder))).collect()
    enc = tokenfiles.encoding(path)
    assert [(r.doc_id, r.n_tokens) for r in sorted(got, key=lambda r: r.position)] == [(i, len(enc.encode_ordinary(t or ""))) for i, t in rows]
    assert sorted((r.part, r.position) for r in got) == [(0, i) for i in range(len(rows))]
    flat = tmp_path / "no ids"
    tokenfiles.write_flat(docs, path, str(flat))
    assert sorted(r.n_tokens for r in tokenfiles.counts(spark, str(flat)).collect()) == sorted(r.n_tokens for r in got)
