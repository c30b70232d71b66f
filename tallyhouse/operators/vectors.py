"""Exact vector search, embedding of distinct texts and span pooling."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.limits import top_k

# Query vectors that meet the corpus together; no more than that ever reach the driver.
QUERY_BLOCK = 4_096
# Bytes of the corpus vectors that meet such a block at a time.
CORPUS_BYTES = 16 << 20
# Queries compared at a time within a task.
QUERY_STEP = 256
# Corpus rows compared at a time within a task.
STEP = 1_024
# More than the rounding of a matrix product can amount to.
MARGIN = 1e-9
MISSING_DISTANCE = 999.0
# Numbers of a vector that are summed in one row, and buckets of a slice of prefix sums.
PIECE, SLICE_BUCKETS = 16, 1_024


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in rows])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


class _Best:
    """The ``n`` least (distance, id) pairs of every query so far."""

    def __init__(self, queries: int, n: int) -> None:
        self.n, self.edge = n, np.full(queries, np.inf)
        self.q, self.ids, self.d = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, ids: np.ndarray, asked: np.ndarray, unit: np.ndarray) -> None:
        """Take in rows. A matrix product finds who may be near; their distances are summed pair by
        pair in one order, so that equal vectors tie."""
        rough, edge = 1.0 - asked @ unit.T, self.edge
        if len(ids) > self.n:
            edge = np.minimum(edge, np.partition(rough, self.n - 1, axis=1)[:, self.n - 1])
        q, at = np.nonzero(rough <= edge[:, None] + MARGIN)
        if not len(q):
            return
        d = 1.0 - np.einsum("ij,ij->i", asked[q], unit[at])
        q, d = np.concatenate([self.q, q]), np.concatenate([self.d, d])
        ids = ids[at] if self.ids is None else np.concatenate([self.ids, ids[at]])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], d, q))
        q, d, ids = q[order], d[order], ids[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < self.n
        self.q, self.d, self.ids = q[keep], d[keep], ids[keep]
        count = np.bincount(self.q, minlength=len(self.edge))
        full = count >= self.n
        self.edge[full] = self.d[np.cumsum(count)[full] - 1]


def _usable(rows: DataFrame) -> DataFrame:
    whole = F.forall("embedding", lambda x: x.isNotNull())
    return rows.filter((F.size("embedding") > 0) & F.coalesce(whole, F.lit(False)))


def _by_blocks(asked: DataFrame, count: int, rows: DataFrame, n: int, schema: T.StructType) -> DataFrame:
    """Best ``n`` of every query in every block of the corpus."""
    size = rows.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0
    q_blocks = -(-count // QUERY_BLOCK)
    c_blocks = max(-(-size // CORPUS_BYTES), rows.sparkSession.sparkContext.defaultParallelism)

    def dealt(side: DataFrame, id_col: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64(id_col, "embedding"), F.lit(blocks))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return side.select(id_col, "embedding", F.size("embedding").alias("length"), block.cast("long").alias(own), every.alias(other))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, unit, queries = right["id"].to_numpy(), _unit(right["embedding"]), left["query_id"].to_numpy()
            for q in range(0, len(left), QUERY_STEP):
                asking = _unit(left["embedding"][q : q + QUERY_STEP])
                best = _Best(len(asking), n)
                for a in range(0, len(ids), STEP):
                    best.add(ids[a : a + STEP], asking, unit[a : a + STEP])
                if best.ids is not None:
                    out.append(pd.DataFrame({"query_id": queries[q + best.q], "id": best.ids, "distance": best.d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "distance": []})

    keys = ["length", "q_block", "c_block"]
    left = dealt(asked, "query_id", "q_block", q_blocks, "c_block", c_blocks).groupBy(*keys)
    right = dealt(rows, "id", "c_block", c_blocks, "q_block", q_blocks).groupBy(*keys)
    return left.cogroup(right).applyInPandas(meet, schema)


def vector_search(
    queries: DataFrame, corpus: DataFrame, n: int = 5, kind: str | None = None
) -> DataFrame:
    """Nearest ``n`` corpus rows per query by cosine distance, ties by id; exact.

    ``queries``: query_id, embedding. ``corpus``: id, embedding and, for ``kind``, kind.
    Vectors that are null, empty or hold a null take no part; each query is compared with all
    vectors of its own length. Up to ``QUERY_BLOCK`` queries, counted first, are broadcast and
    visit the corpus where it lies. More stay in Spark: hashed blocks of queries meet hashed
    blocks of the corpus, so the work is that of all pairs, and what is shuffled is each side
    once per block of the other. Only the best ``n`` per query leave a task or a block.
    """
    if kind is not None:
        corpus = corpus.filter(F.col("kind") == kind)
    rows = corpus.select("id", "embedding")
    types = {f.name: f.dataType for f in (*queries.schema.fields, *rows.schema.fields)}
    schema = T.StructType([
        T.StructField("query_id", types["query_id"]),
        T.StructField("id", types["id"]),
        T.StructField("distance", T.DoubleType()),
    ])
    asked = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())

    def visit(block: list) -> DataFrame:
        by_length: dict[int, list] = {}
        for r in block:
            by_length.setdefault(len(r["embedding"]), []).append(r)
        shared = rows.sparkSession.sparkContext.broadcast({
            k: (np.array([r["query_id"] for r in of]), _unit([r["embedding"] for r in of])) for k, of in by_length.items()
        })

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = {k: _Best(len(ids_of), n) for k, (ids_of, _) in shared.value.items()}
            for b in batches:
                lengths = b["embedding"].map(len)
                for k, (_, unit) in shared.value.items():
                    of = b[lengths == k]
                    ids = of["id"].to_numpy()
                    for a in range(0, len(of), STEP):
                        best[k].add(ids[a : a + STEP], unit, _unit(of["embedding"][a : a + STEP]))
            for k, (ids_of, _) in shared.value.items():
                if best[k].ids is not None:
                    yield pd.DataFrame({"query_id": ids_of[best[k].q], "id": best[k].ids, "distance": best[k].d})

        return _usable(rows).mapInPandas(scan, schema)

    asked = _usable(asked)
    count = asked.count()
    found = visit(asked.collect()) if count <= QUERY_BLOCK else _by_blocks(asked, count, _usable(rows), n, schema)
    return top_k(found, ["query_id"], [F.col("distance").asc(), F.col("id").asc()], n)


def multi_search(
    queries: DataFrame, a: DataFrame, b: DataFrame | None, n: int = 5,
    kind: str | None = None, b_source: str = "agent",
) -> DataFrame:
    """Hits of two collections merged by distance: twice ``n`` from the first, ``n`` from
    the second, tagged with its name; the best ``n`` stay."""
    hits = vector_search(queries, a, 2 * n, kind).withColumn("source", F.lit(None).cast("string"))
    if b is not None:
        hits = hits.unionByName(vector_search(queries, b, n).withColumn("source", F.lit(b_source)))
    return merge_hits(hits.drop("rank"), n)


def merge_hits(hits: DataFrame, n: int) -> DataFrame:
    """Best ``n`` hits per query over all lists; a missing distance counts as far away."""
    by = F.coalesce("distance", F.lit(MISSING_DISTANCE))
    order = [by.asc(), F.col("source").asc_nulls_first(), F.col("id").asc()]
    return top_k(hits, ["query_id"], order, n)


def semantic_score(hits: DataFrame) -> DataFrame:
    """Best closeness per question and example: max(0, 1 - distance)."""
    close = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance"))
    return hits.groupBy("question_id", "example_id").agg(F.max(close).alias("semantic_score"))


def embed_once(
    df: DataFrame, col: str, embed_fn: Callable[[list[str]], list[list[float]]], out: str = "embedding"
) -> DataFrame:
    """Attach the vector of each text; the model sees every distinct text once.

    Texts fold to one row per SHA-256 before the model call, with map-side combine. Null
    texts have no vector and pass by the join, so they do not meet in one task.
    """
    keyed = df.filter(F.col(col).isNotNull()).withColumn("_sha", F.sha2(F.col(col), 256))
    nothing = df.filter(F.col(col).isNull()).withColumn(out, F.lit(None).cast("array<float>"))
    texts = keyed.groupBy("_sha").agg(F.first(col).alias("_text"))

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_sha": b["_sha"], out: list(embed_fn(list(b["_text"])))})

    vectors = texts.mapInPandas(embed, f"_sha string, `{out}` array<float>")
    return keyed.join(vectors, "_sha").drop("_sha").unionByName(nothing)


def span_mean_pool(
    tokens: DataFrame, spans: DataFrame, full: DataFrame, dims: int, bucket_chars: int = 1_024
) -> DataFrame:
    """Vector of each span: the mean of the tokens fully inside it, else the whole text's.

    ``tokens``: doc_id, start, end, embedding. ``spans``: doc_id, span_id, start, end.
    ``full``: doc_id, embedding. Tokens may overlap; one that ends before it starts, or whose
    vector is not one of ``dims`` finite numbers, takes no part.

    Offsets fall into buckets. Only the tokens of a span's first and last bucket are compared
    with it; what lies between is the difference of two prefix sums over buckets. Vectors go
    in pieces of ``PIECE`` numbers, so an aggregate is as wide at any ``dims``, and prefix sums
    run in slices of buckets, so a long document is spread over many tasks.
    """
    width, pieces = F.lit(bucket_chars), -(-dims // PIECE)
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.size("embedding") == dims)
    t = tokens.filter((F.col("end") >= F.col("start")) & whole).select(
        "doc_id", F.col("start").alias("_ts"), F.col("end").alias("_te"), bucket("start").alias("_tx"), bucket("end").alias("_ty"),
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.slice("embedding", i * PIECE + 1, F.lit(PIECE))
        )).alias("_p", "_v"),
    )
    names = [f"_{i}" for i in range(min(PIECE, dims))]
    # The last piece may be shorter; what it lacks is cut off in the end.
    t = t.select(*t.columns[:-1], F.lit(1).cast("long").alias("_n"), *[F.get("_v", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    sums = ["_n", *names]
    s = spans.select("doc_id", "span_id", "start", "end", bucket("start").alias("_x"), bucket("end").alias("_y"))
    fields = ["doc_id", "span_id", "_p", *sums]

    inside = (F.col("_ts") >= F.col("start")) & (F.col("_te") <= F.col("end"))
    first = t.join(s.withColumnRenamed("_x", "_tx"), ["doc_id", "_tx"]).filter(inside)
    last = t.join(s.withColumnRenamed("_y", "_ty"), ["doc_id", "_ty"]).filter(inside & (F.col("_tx") > F.col("_x")))
    # Between: what ends before the last bucket, less what starts up to the first one; tokens
    # that start up to the first and end from the last one on have been taken off too much.
    wide = s.filter(F.col("_y") > F.col("_x") + 1)
    lasting = t.filter(F.col("_ty") > F.col("_tx")).withColumn("_x", F.explode(F.sequence("_tx", "_ty")))
    over = lasting.join(wide, ["doc_id", "_x"]).filter(F.col("_ty") >= F.col("_y"))
    ended = _before(t, "_ty", wide, F.col("_y"), pieces, sums)
    begun = _before(t, "_tx", wide, F.col("_x") + 1, pieces, sums)
    less = begun.select("doc_id", "span_id", "_p", *[(-F.col(c)).alias(c) for c in sums])

    parts = [df.select(*fields) for df in (first, last, over, ended, less)]
    totals = _added(parts, ["doc_id", "span_id", "_p"], sums).filter(F.col("_n") > 0)
    mean = F.array(*[F.col(c) / F.col("_n") for c in names])
    rows = totals.groupBy("doc_id", "span_id").agg(F.sort_array(F.collect_list(F.struct("_p", mean.alias("m")))).alias("_l"))
    pooled = rows.select("doc_id", "span_id", F.slice(F.flatten(F.col("_l.m")), 1, dims).alias("_mean"))
    whole_texts = full.select("doc_id", F.col("embedding").cast("array<double>").alias("_full"))
    joined = spans.join(pooled, ["doc_id", "span_id"], "left").join(whole_texts, "doc_id", "left")
    return joined.select("doc_id", "span_id", F.coalesce("_mean", "_full").alias("embedding"))


def _added(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Rows of several frames, summed by key."""
    return functools.reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def _before(tokens: DataFrame, at: str, spans: DataFrame, edge: Column, pieces: int, sums: list[str]) -> DataFrame:
    """(doc_id, span_id, _p, sums): for each span the sums of tokens whose bucket ``at`` is below ``edge``.

    Bucket sums and edges stand in one order, so an edge reads off the running sum where it stands.
    """
    totals = tokens.groupBy("doc_id", "_p", F.col(at).alias("_b")).agg(*[F.sum(c).alias(c) for c in sums])
    span_type = spans.schema["span_id"].dataType
    edges = spans.select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("_p"), edge.alias("_b"), "span_id", F.lit(True).alias("_edge"),
        *[F.lit(0).cast(t).alias(c) for c, t in tokens.select(*sums).dtypes],
    )
    rows = totals.withColumns({"span_id": F.lit(None).cast(span_type), "_edge": F.lit(False)}).unionByName(edges)
    rows = rows.withColumn("_slice", F.floor(F.col("_b") / SLICE_BUCKETS))
    # Edges come before the sum of the bucket they stand at.
    within = Window.partitionBy("doc_id", "_p", "_slice").orderBy("_b", F.desc("_edge")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("doc_id", "_p").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("doc_id", "_p", "_slice").agg(*[F.sum(c).alias(c) for c in sums])
    carried = slices.select("doc_id", "_p", "_slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_c{c}") for c in sums])
    run = rows.withColumns({c: F.sum(c).over(within) for c in sums}).filter("_edge").join(carried, ["doc_id", "_p", "_slice"])
    return run.select("doc_id", "span_id", "_p", *[(F.col(c) + F.col(f"_c{c}")).alias(c) for c in sums])


def collection_stats(docs: DataFrame, samples: int = 2) -> DataFrame:
    """Documents per collection and the first few ids of each.

    ``docs``: collection, id. Only ``samples`` rows per collection are ever gathered. A
    null collection is a collection too.
    """
    counts = docs.groupBy("collection").agg(F.count("*").alias("documents"))
    first = top_k(docs.select("collection", "id"), ["collection"], [F.col("id").asc()], samples)
    lists = first.groupBy("collection").agg(F.sort_array(F.collect_list("id")).alias("sample_ids"))
    lists = lists.withColumnRenamed("collection", "_c")
    return counts.join(lists, F.col("collection").eqNullSafe(F.col("_c"))).drop("_c")
