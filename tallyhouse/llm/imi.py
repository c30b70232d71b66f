"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves; each half has a codebook of its own,
trained on a bounded sample, and a row of the index belongs to the cell of its two nearest
centroids. A query visits cells by rising sum of its two distances, taken from a heap that
grows from the nearest pair, until the visited cells hold enough entries; those are reranked
by the exact cosine of the original vectors.

Cells with many entries are split into blocks of bounded size. The index is shuffled once, by
cell and block; queries go to the blocks they visit and stream through them in batches, so a
task holds one block and one batch at a time. Each block gives back the best few per query.
Equal vectors are folded first: of each only the smallest ids can be among the results.

Null and zero vectors, and such with null, infinite or undefined components or a length other
than most vectors have, take no part. Repeated ids are rows of their own: each row asked has its
own list, in which only that row itself is missing, and rows alike count as often as they occur.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of the training sample, centroids per half, and the share of all entries a query visits.
SAMPLE_ROWS, CENTROIDS, VISIT = 20_000, 32, 0.5
ROUNDS = 12
# Entries of a block, and queries that are compared with it at once.
BLOCK, BATCH = 4096, 256


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (sizes.n if sizes else 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow on the way."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in column])


def _measured(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their lengths. Where a length overflows or vanishes, the vector is scaled first."""
    m = m.copy()
    with np.errstate(over="ignore", under="ignore"):
        norm = np.sqrt((m * m).sum(axis=1))
    odd = ~np.isfinite(norm) | (norm < 1e-150)
    if odd.any():
        m[odd] /= np.abs(m[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.linalg.norm(m[odd], axis=1)
    return m, norm


def train(sample: np.ndarray, centroids: int = CENTROIDS, seed: int = 5) -> list[np.ndarray]:
    """Two codebooks by k-means on the halves of unit vectors."""
    rng, books = np.random.default_rng(seed), []
    half = sample.shape[1] // 2
    for part in (sample[:, :half], sample[:, half:]):
        part = part if part.shape[1] else np.zeros((len(sample), 1))
        book = part[rng.choice(len(part), min(centroids, len(part)), replace=False)].copy()
        for _ in range(ROUNDS):
            near = _nearest(part, book)[:, 0]
            for k in range(len(book)):
                if (near == k).any():
                    book[k] = part[near == k].mean(axis=0)
        books.append(book)
    return books


def _distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)


def _nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argsort(_distances(part, book), axis=1, kind="stable")


def _halves(m: np.ndarray) -> list[np.ndarray]:
    half = m.shape[1] // 2
    return [m[:, :half] if half else np.zeros((len(m), 1)), m[:, half:]]


def cells(m: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Cell number of each unit vector."""
    a, b = [_nearest(p, book)[:, 0] for p, book in zip(_halves(m), books, strict=True)]
    return a * len(books[1]) + b


def visited(query: np.ndarray, books: list[np.ndarray], counts: np.ndarray, enough: int) -> list[int]:
    """Cells of one unit vector by rising sum of distances, until they hold ``enough`` entries."""
    da, db = [_distances(p, book)[0] for p, book in zip(_halves(query[None, :]), books, strict=True)]
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    heap, seen, out, held = [(da[oa[0]] + db[ob[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(oa[i] * len(db) + ob[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(oa) and y < len(ob) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (da[oa[x]] + db[ob[y]], x, y))
    return out


def search(
    rows: DataFrame, queries: DataFrame, n: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    centroids: int = CENTROIDS, visit: float = VISIT, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): the ``n`` nearest rows found for each query, itself left out."""
    spark = rows.sparkSession
    entries, asked = usable(rows, id_col, vec_col), usable(queries, id_col, vec_col)
    # Of equal vectors the n + 1 smallest ids suffice, one of which may be the query's own.
    same = Window.partitionBy("v").orderBy("id")
    entries = entries.groupBy("id", "v").agg(F.count("*").alias("copies"))
    entries = entries.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= n + 1).drop("r")
    entries = entries.select("id", "v", F.least("copies", F.lit(n + 1)).cast("int").alias("copies"))
    drawn = entries.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample_rows).select("v").collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not drawn:
        return spark.createDataFrame([], empty)
    books = train(unit(_matrix(r.v for r in drawn)), centroids)
    shared = spark.sparkContext.broadcast(books)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                found = cells(unit(_matrix(batch.column(1).to_pylist())), shared.value).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["id", "v", "copies", "cell"])

    index = entries.mapInArrow(assign, "id long, v array<double>, copies int, cell int")
    counts = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    rows_of = np.zeros_like(counts)
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).collect():  # at most centroids ** 2
        counts[r.cell], rows_of[r.cell] = r.n, r.rows
    split = -(-counts // BLOCK)
    # At least so many that n are left without the query itself.
    enough = max(int(np.ceil(visit * rows_of.sum())), n + 1)
    plan = spark.sparkContext.broadcast((rows_of, split))

    def route(batches):
        for batch in batches:
            ids, vectors, keys = (batch.column(i).to_pylist() for i in range(3))
            if not ids:
                continue
            sizes, parts = plan.value
            out = []
            for i, v, k, u in zip(ids, vectors, keys, unit(_matrix(vectors)), strict=True):
                out += [(i, v, k, c, s) for c in visited(u, shared.value, sizes, enough) for s in range(parts[c])]
                if len(out) > 20_000:
                    yield _routed(out)
                    out = []
            if out:
                yield _routed(out)

    # Rows asked that are alike share one search; the number tells different vectors of one id apart.
    number = F.unhex(F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256))
    asked = asked.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("key", number)
    routed = asked.select("id", "v", "key").mapInArrow(route, "id long, v array<double>, key binary, cell int, block int")
    blocks = F.element_at(F.lit([int(x) for x in np.maximum(split, 1)]), F.col("cell") + 1)
    index = index.withColumn("block", F.pmod(F.xxhash64("id", "v"), blocks).cast("int"))
    # In a block the entries come first, marked by their copies.
    both = index.withColumn("key", F.lit(None).cast("binary")).unionByName(routed.withColumn("copies", F.lit(0)))
    both = both.repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("copies"))
    fields = ["cell", "block", "copies", "id", "v", "key"]
    near = both.select(*fields).mapInArrow(lambda batches: _reranked(batches, n), "id long, key binary, vec_id long, score double, c int")
    near = near.select("id", "key", "vec_id", "score", F.explode(F.sequence(F.lit(1), "c")).alias("c"))
    best = Window.partitionBy("id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    ranked = ranked.join(asked.select("id", "key", "times"), ["id", "key"])
    ranked = ranked.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def _reranked(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The best ``n`` entries of each block for the queries that follow its entries.

    Rows are sorted by cell and block, entries before queries.
    """
    at, entries, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part, copies = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        asks = copies == 0
        new = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
        for a, b in itertools.pairwise([0, *new, len(cell)]):
            if (cell[a], part[a]) != at:
                at, entries, block = (cell[a], part[a]), [], None
            rows = batch.slice(a, b - a)
            if not asks[a]:
                entries.append(rows)
                continue
            if block is None:
                if not entries:
                    continue
                held = pa.Table.from_batches(entries)
                block = (held.column(3).to_numpy(), held.column(2).to_numpy(), *_measured(_vectors(held.column(4))))
                entries = []
            for c in range(0, b - a, BATCH):
                yield _best(block, rows.slice(c, BATCH), n)


def _best(block: tuple, asked: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """(id, key, vec_id, score, c) of the entries nearest to each query, ``c`` times each."""
    ids, copies, m, norm = block
    own = asked.column(3).to_numpy()
    q, q_norm = _measured(_vectors(asked.column(4)))
    at, found, scores, times = [], [], [], []
    for i in range(len(own)):
        score = (m @ q[i]) / (norm * q_norm[i])
        # The row itself does not count, others of its id do.
        left = copies
        if (same := np.flatnonzero(ids == own[i])).size:
            left = copies.copy()
            left[same[(m[same] == q[i]).all(axis=1)]] -= 1
            score[left == 0] = -np.inf
        # All that tie with the n-th score stay in the running.
        edge = np.partition(score, -min(n, len(score)))[-min(n, len(score))]
        near = np.flatnonzero((score >= edge) & (score > -np.inf))
        near = near[np.lexsort((ids[near], -score[near]))][:n]
        at.append(np.full(len(near), i))
        found.append(ids[near])
        scores.append(score[near])
        times.append(left[near].astype(np.int32))
    at = pa.array(np.concatenate(at))
    rest = [pa.array(np.concatenate(x)) for x in (found, scores, times)]
    return pa.RecordBatch.from_arrays([asked.column(3).take(at), asked.column(5).take(at), *rest], names=["id", "key", "vec_id", "score", "c"])


def _vectors(column) -> np.ndarray:
    """Vectors of one length as a matrix, without a Python object per row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _routed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"id": pa.int64(), "v": pa.list_(pa.float64()), "key": pa.binary(), "cell": pa.int32(), "block": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
