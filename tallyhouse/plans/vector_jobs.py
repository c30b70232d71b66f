"""Vector search over the embeddings, embedding of texts, span pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators import vectors as V
from tallyhouse.operators.windows import running_sum
from tallyhouse.plans.registry import query

DIMS = 64


def corpus(t) -> DataFrame:
    kind = F.when(F.col("label") < 5, "knowledge").otherwise("agent")
    return t["embeddings"].select(F.col("vec_id").alias("id"), "embedding", kind.alias("kind"), "label")


def centroids(t) -> DataFrame:
    """One query per label: the mean of its vectors, rounded so that it has one value."""
    means = [F.round(F.avg(F.element_at("embedding", i + 1).cast("double")), 9) for i in range(DIMS)]
    return t["embeddings"].groupBy(F.col("label").alias("query_id")).agg(F.array(*means).alias("embedding"))


def shown(hits: DataFrame) -> DataFrame:
    """Distances as they are compared with other engines; ranks are by the exact ones."""
    return hits.withColumn("distance", F.round("distance", 9))


_DOT = "list_inner_product(q.v, c.v)"
_NORMS = "sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))"
BASE_SQL = f"""
WITH c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label,
  CASE WHEN label < 5 THEN 'knowledge' ELSE 'agent' END AS kind FROM embeddings),
m AS (SELECT label, i, round(AVG(CAST(x AS DOUBLE)), 9) AS a FROM
  (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) u GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(a ORDER BY i) AS v FROM m GROUP BY 1),
d AS (SELECT q.query_id, c.id, c.kind, c.label, 1 - {_DOT} / ({_NORMS}) AS distance FROM q CROSS JOIN c)
"""


def _top(where: str, n: int, extra: str = "") -> str:
    return (
        f"SELECT query_id, id, round(distance, 9) AS distance, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d.distance, id) AS INTEGER) "
        f"AS rank{extra} FROM d {where} QUALIFY rank <= {n}"
    )


@query("vector_search", BASE_SQL + _top("", 5))
def vector_search(t):
    return shown(V.vector_search(centroids(t), corpus(t), 5))


@query("vector_search_filtered", BASE_SQL + _top("WHERE kind = 'agent'", 5))
def vector_search_filtered(t):
    return shown(V.vector_search(centroids(t), corpus(t), 5, kind="agent"))


@query(
    "nearest_vectors",
    """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id AS query_id, b.id, 1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS d
FROM v a JOIN v b ON a.id <> b.id)
SELECT query_id, id, round(d, 9) AS distance FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d, id) <= 5
""",
)
def nearest_vectors(t):
    """Every vector as a query against all others."""
    rows = t["embeddings"].select(F.col("vec_id").alias("id"), "embedding")
    hits = V.vector_search(rows.withColumnRenamed("id", "query_id"), rows, 6).filter(F.col("id") != F.col("query_id"))
    best = Window.partitionBy("query_id").orderBy("rank")
    return shown(hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= 5)).select("query_id", "id", "distance")


_MULTI_SQL = (
    BASE_SQL
    + ", h AS (SELECT * FROM ("
    + _top("WHERE kind = 'knowledge'", 10, ", CAST(NULL AS VARCHAR) AS source")
    + ") a UNION ALL SELECT * FROM ("
    + _top("WHERE kind = 'agent'", 5, ", 'agent' AS source")
    + ") b) SELECT query_id, id, distance, source, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY "
    "distance, source NULLS FIRST, id) AS INTEGER) AS rank FROM h QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id "
    "ORDER BY distance, source NULLS FIRST, id) <= 5"
)


def multi_hits(t) -> DataFrame:
    rows = corpus(t)
    a, b = rows.filter(F.col("kind") == "knowledge"), rows.filter(F.col("kind") == "agent")
    return shown(V.multi_search(centroids(t), a, b, 5))


@query("multi_collection_search", _MULTI_SQL)
def multi_collection_search(t):
    return multi_hits(t)


@query(
    "semantic_score",
    f"SELECT query_id AS question_id, label AS example_id, MAX(GREATEST(0.0, 1 - distance)) AS semantic_score FROM ("
    f"{_MULTI_SQL}) h JOIN embeddings ON vec_id = id GROUP BY 1, 2",
)
def semantic_score(t):
    labels = t["embeddings"].select(F.col("vec_id").alias("id"), F.col("label").alias("example_id"))
    hits = multi_hits(t).join(labels, "id").withColumnRenamed("query_id", "question_id")
    return V.semantic_score(hits)


def letter_shares(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for a model: counts of a text's characters by kind."""
    return [[float(len(s)), float(s.count(" ")), float(s.count("e"))] for s in texts]


@query(
    "embed_once",
    "SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces, "
    "CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es FROM documents",
)
def embed_once(t):
    rows = V.embed_once(t.spread("documents").select("doc_id", "text"), "text", letter_shares)
    item = lambda i: F.element_at("embedding", i).cast("double")
    return rows.select("doc_id", item(1).alias("chars"), item(2).alias("spaces"), item(3).alias("es"))


SPAN = 1_500


def turn_tokens(t) -> DataFrame:
    """Turns of a conversation as the tokens of one long text, with character offsets."""
    size = F.length("text").cast("long")
    ends = running_sum(
        t["conversations"].select("conv_id", "turn", size.alias("size")), ["conv_id"],
        F.floor(F.col("turn") / 1_000), [F.col("turn")], F.col("size"), "end",
    )
    vector = F.array(F.col("size").cast("double"), F.col("turn").cast("double"))
    return ends.select(
        F.col("conv_id").alias("doc_id"), (F.col("end") - F.col("size")).alias("start"), "end",
        vector.alias("embedding"),
    )


@query(
    "span_mean_pool",
    f"""
WITH tok AS (SELECT conv_id AS doc_id, SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e, length(text) AS n, turn FROM conversations),
tk AS (SELECT doc_id, e - n AS s, e, n, turn FROM tok),
doc AS (SELECT doc_id, MAX(e) AS total, AVG(n) AS fn, AVG(turn) AS ft FROM tk GROUP BY 1),
sp AS (SELECT doc_id, unnest(range(0, CAST(total AS BIGINT), {SPAN})) AS a, fn, ft FROM doc)
SELECT sp.doc_id, CAST(sp.a AS BIGINT) AS span_id, ROUND(COALESCE(AVG(n), ANY_VALUE(fn)), 6) AS mean_chars,
  ROUND(COALESCE(AVG(turn), ANY_VALUE(ft)), 6) AS mean_turn
FROM sp LEFT JOIN tk ON tk.doc_id = sp.doc_id AND tk.s >= sp.a AND tk.e <= sp.a + {SPAN} GROUP BY 1, 2
""",
)
def span_mean_pool(t):
    tokens = turn_tokens(t)
    docs = tokens.groupBy("doc_id").agg(
        F.max("end").alias("total"),
        F.array(F.avg(F.col("embedding")[0]), F.avg(F.col("embedding")[1])).alias("embedding"),
    )
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(SPAN).cast("long")))
    spans = docs.select("doc_id", starts.alias("start")).select(
        "doc_id", F.col("start").alias("span_id"), "start", (F.col("start") + SPAN).alias("end")
    )
    pooled = V.span_mean_pool(tokens, spans, docs.select("doc_id", "embedding"), dims=2)
    return pooled.select(
        "doc_id", "span_id", F.round(F.col("embedding")[0], 6).alias("mean_chars"),
        F.round(F.col("embedding")[1], 6).alias("mean_turn"),
    )


@query(
    "collection_stats",
    "SELECT source AS collection, COUNT(*) AS documents, array_to_string(list(doc_id ORDER BY doc_id)[1:2], ',') AS sample_ids "
    "FROM documents GROUP BY 1",
)
def collection_stats(t):
    docs = t["documents"].select(F.col("source").alias("collection"), F.col("doc_id").alias("id"))
    return V.collection_stats(docs).withColumn("sample_ids", F.array_join("sample_ids", ","))
