"""The corpus pipeline: five stages over the documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, minhash, mixing, queries, templates, toxicity
from tallyhouse.session import work_folder
from tallyhouse.sources.tables import read_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest window is not judged toxic; the network learns from the labels."""
    labels = read_tables(spark, sf_dir)["labels"]
    model = toxicity.fit(toxicity.sample(docs, labels))
    return toxicity.score(docs, model, out_col="_toxicity").filter(F.col("_toxicity") < 0.5).drop("_toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs; sizes follow the text."""
    kept = templates.drop_recurring_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, of every document."""
    return bpe.digests(docs, bpe.public_path(queries.WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]
# The stages are no SQL: a trained network, consistent samples and hashes decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_tables(spark, sf_dir)["documents"]
    folder = f"{work_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
