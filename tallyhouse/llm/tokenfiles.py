"""Token counts of flat token files by a separator scan.

A flat token file is a run of 16-bit little-endian ids without an index; every document ends
with the end-of-document id. Spark reads files whole, so the writer begins a new one after
``FILE_BYTES``, however long its partition is. They are scanned in blocks: each block is searched for the separator at once, and gives the tokens before its first separator, the lengths
between separators, and the tokens after the last one. A prefix scan over the blocks,
in order of file and offset, then joins what runs across their borders, so a document may
span any number of blocks or files.

Documents are found again by the ids that the writing task puts beside its token file; repeated
rows and null ids keep a count each, and a document without a count is an error.

An empty document is a separator alone. Tokens after the last separator of all form one more
document, marked as open. No files give no rows. The writer turns null texts into empty
documents; ids of 65,535 and more do not fit and are refused.
"""

from __future__ import annotations

import base64
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import text_slices
from tallyhouse.session import materialize, work_folder

# The end-of-text id that is free in the public byte vocabulary.
SEPARATOR = 50_256
# Tokens of a block.
BLOCK = 1 << 20
# Bytes of a written file, but for its last document; a reading task holds files whole.
FILE_BYTES = 1 << 22
BATCH_BYTES = 2_000_000


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """Byte-level tokenizer of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="ascii") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(
    docs: DataFrame, vocabulary: str, path: str, text_col: str = "text", separator: int = SEPARATOR, id_col: str | None = None
) -> None:
    """Write the ids of ``text_col`` as flat token files, one or several per partition, in the order of rows.

    The text writer puts out each row's bytes as they are, and the separator id as line end; a
    row is a file, and holds documents until they reach ``FILE_BYTES``.
    With ``id_col`` the same tasks write, beside each token file (in ``ids=0``), a file of the
    same part and number with how many documents of the part stand before it, and the documents'
    ids in the same order (in ``ids=1``); see ``written_ids``.
    """
    if not 0 <= separator < 1 << 16:
        raise ValueError("the separator must fit into 16 bits")
    null, digits = _letters(separator)

    between, limit = int(separator).to_bytes(2, "little"), FILE_BYTES

    def told(value: str | None) -> bytes:
        return null if value is None else value.encode().hex().encode().translate(digits)

    def file(no: int, first: int, rows: list[bytes], names: list) -> pa.RecordBatch:
        values = [between.join(rows)]
        if id_col is not None:
            values.append(between.join(map(told, [str(first), *names])))
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(values)), pa.int32()), pa.array([no] * len(values), pa.int64()), pa.array(values, pa.binary())],
            names=["ids", "place", "value"],
        )

    def run(batches):
        enc, rows, names, size, no, first = encoding(vocabulary), [], [], 0, 0, 0
        for batch in batches:
            for a, b, texts in text_slices(batch.column(0), BATCH_BYTES):
                for text, name in zip(texts, batch.column(1)[a:b].to_pylist(), strict=True):
                    ids = np.array(enc.encode_ordinary(text), dtype=np.int64)
                    if (ids >= (1 << 16) - 1).any() or (ids == separator).any():
                        raise ValueError("an id does not fit into a flat file, or is the separator")
                    rows.append(ids.astype("<u2").tobytes())
                    names.append(name)
                    size += len(rows[-1]) + len(between)
                    if size >= limit:
                        yield file(no, first, rows, names)
                        rows, names, size, no, first = [], [], 0, no + 1, first + len(rows)
        if rows:
            yield file(no, first, rows, names)

    # Bytes of the separator, as the characters that Latin-1 gives them.
    end = between.decode("latin-1")
    named = (F.lit(None) if id_col is None else F.col(id_col)).cast("string").alias("_name")
    rows = docs.select(text_col, named).mapInArrow(run, "ids int, place long, value binary")
    value = F.col("value").cast("string").alias("value")
    if id_col is None:
        writer = rows.select(value).write
    else:
        writer = rows.sortWithinPartitions("ids", "place").select("ids", value).write.partitionBy("ids")
    writer = writer.option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none")
    writer.option("maxRecordsPerFile", 1).text(path)


def _letters(separator: int) -> tuple[bytes, bytes]:
    """A sign for null, and a table from hexadecimal digits to letters, none of them a byte of the separator."""
    free = [c for c in range(ord("a"), ord("z") + 1) if c not in int(separator).to_bytes(2, "little")]
    return bytes(free[16:17]), bytes.maketrans(b"0123456789abcdef", bytes(free[:16]))


def _files(spark: SparkSession, path: str, ids: int) -> DataFrame:
    """(path, content) of the token files (0) or of the id files (1) under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    if "ids" in files.columns:
        files = files.filter(F.col("ids") == ids)
    elif ids:
        files = files.limit(0)
    return files.select("path", "content")


def written_ids(spark: SparkSession, path: str, kind: str, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, part, position, no, at) of the documents in flat files written with an id column of type ``kind``.

    ``position`` is a document's place in its part, ``at`` that in the part's file ``no``.
    """
    null, digits = _letters(separator)
    back = bytes.maketrans(digits[ord("0") : ord("9") + 1] + digits[ord("a") : ord("f") + 1], b"0123456789abcdef")
    end = int(separator).to_bytes(2, "little")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = content.as_py().split(end)[:-1]
                first, *ids = [None if x == null else bytes.fromhex(x.translate(back).decode()).decode() for x in lines]
                places = range(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array([name] * len(ids), pa.string()),
                     pa.array([int(first) + i for i in places], pa.int64()), pa.array(places, pa.int64())],
                    names=["doc_id", "file", "position", "at"],
                )

    rows = _files(spark, path, 1).mapInArrow(run, "doc_id string, file string, position long, at long")
    return rows.select(F.col("doc_id").cast(kind).alias("doc_id"), *_place("file"), "position", "at")


def _place(file: str) -> tuple[Column, Column]:
    """Number of the part that wrote a file, and of the file in it."""
    number = lambda pattern, name: F.regexp_extract(file, pattern, 1).cast("int").alias(name)
    return number(r"part-(\d+)", "part"), number(r"part-[^/]*[.-]c(\d+)", "no")


def scan_block(ids: np.ndarray, separator: int = SEPARATOR) -> tuple[int, np.ndarray, int]:
    """(tokens before the first separator, lengths between separators, tokens after the last one)
    of a block; without a separator all its tokens are in the first number, and the last is -1."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return len(ids), np.zeros(0, np.int64), -1
    return int(at[0]), np.diff(at) - 1, len(ids) - int(at[-1]) - 1


def scan(files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(file, no, head, inner, tail, tokens): the scan of every block of binary files."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_buffer()
                if len(content) % 2:
                    raise ValueError(f"{path} is no flat file of 16-bit ids")
                ids = np.frombuffer(content, dtype="<u2")
                for no, a in enumerate(range(0, len(ids), block)):
                    part = ids[a : a + block]
                    head, inner, tail = scan_block(part, separator)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([no], pa.int32()), pa.array([head], pa.int64()),
                         pa.array([inner.tolist()], pa.list_(pa.int64())), pa.array([tail], pa.int64())],
                        names=["file", "no", "head", "inner", "tail"],
                    )

    return files.select("path", "content").mapInArrow(run, "file string, no int, head long, inner array<long>, tail long")


def carried(rows: DataFrame, within: list[str], order: str, has: Column, left: Column) -> DataFrame:
    """``rows`` with ``run_in``: tokens open at the end of the rows before, by running sums.

    A row with a separator leaves its own ``left`` open, another one adds its ``left`` to what was
    open before. ``seen`` numbers the stretches between separators.
    """
    along = Window.partitionBy(*within).orderBy(order)
    rows = rows.withColumn("seen", F.sum(F.when(has, 1).otherwise(0)).over(along))
    since = Window.partitionBy(*within, "seen").orderBy(order)
    rows = rows.withColumn("_open", F.sum(left).over(since.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("run_in", F.coalesce(F.lag("_open").over(along), F.lit(0))).drop("_open")


def counts(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(file, position, n_tokens, open) of every document in the flat files under ``path``.

    ``position`` numbers the documents that end in a file; files follow each other by name.
    """
    # Written, as they are used twice and the files shall be read once.
    blocks = materialize(scan(_files(spark, path, 0), separator, block), "blocks")
    has = F.col("tail") >= 0
    left = F.when(has, F.col("tail")).otherwise(F.col("head"))
    rows = carried(blocks, ["file"], "no", has, left)
    along = Window.partitionBy("file").orderBy("no")
    before = F.sum(F.when(has, F.size("inner") + 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0)))
    # One row per file: what it leaves open.
    still = F.when(has, F.col("tail")).otherwise(F.col("run_in") + F.col("head"))
    ends = rows.groupBy("file").agg(F.max(F.struct("no", still.alias("left")))["left"].alias("left"), F.max(has).alias("has"))
    files = carried(ends.withColumn("all", F.lit(0)), ["all"], "file", F.col("has"), F.col("left"))
    files = files.select("file", F.col("run_in").alias("carry"), "left", "has")
    first = F.col("run_in") + F.col("head") + F.when(F.col("seen") == 1, F.col("carry")).otherwise(0)
    closed = rows.filter(has).join(files.select("file", "carry"), "file").select(
        "file", "before", F.posexplode(F.concat(F.array(first), "inner")).alias("at", "n_tokens")
    )
    closed = closed.select("file", (F.col("before") + F.col("at")).alias("position"), "n_tokens", F.lit(False).alias("open"))
    final = files.orderBy(F.desc("file")).limit(1)
    open_ = final.select(
        "file", F.lit(None).cast("long").alias("position"),
        (F.col("left") + F.when(F.col("has"), 0).otherwise(F.col("carry"))).alias("n_tokens"), F.lit(True).alias("open"),
    )
    return closed.unionByName(open_.filter(F.col("n_tokens") > 0))


def matched(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, part, position): documents with the counts of their places; one without is an error."""
    found = found.filter(~F.col("open")).select(*_place("file"), F.col("position").alias("at"), "n_tokens")
    lost = F.raise_error(F.concat(F.lit("no count for document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    tokens = F.coalesce("n_tokens", lost.cast("long")).alias("n_tokens")
    return placed.join(found, ["part", "no", "at"], "left").select("doc_id", tokens, "part", "position")


def counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, part, position): documents written as flat token files, then counted.

    The token files have no ids. The task that writes one also writes the ids of its documents,
    in the same order, so rows that move when the table is read again cannot change places.
    """
    spark = docs.sparkSession
    path = f"{work_folder(spark)}/flat-{uuid.uuid4().hex}"
    write_flat(docs, vocabulary, path, id_col="doc_id")
    return matched(written_ids(spark, path, docs.schema["doc_id"].dataType.simpleString()), counts(spark, path))
