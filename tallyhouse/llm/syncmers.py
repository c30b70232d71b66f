"""Document fingerprints from closed syncmers.

A run of ``K`` code points is chosen when the least hash among its inner runs of ``S`` code
points lies at either edge. The choice depends on the run alone, so an edit changes only the
anchors that overlap it. A fingerprint keeps the anchors whose hash lies in the least ``SHARE``
of all hashes, so that it grows with the text and a passage keeps its anchors wherever it stands;
of a text with fewer such anchors it keeps the ``KEPT`` of least hash. A share of 1 keeps all.
Each anchor stands with the place of its first occurrence, in full. Two fingerprints are as alike
as the share of anchors, among the hashes up to which both are complete, that stand in both, and
in places which differ by the same distance as most do. It follows from the fingerprints alone.

Null counts as empty. An empty text has no anchor and an empty fingerprint, is like another
empty text (1) and unlike any other (0). A text without a chosen run, as one shorter than
``K``, has itself as its only anchor. Equal texts have equal fingerprints; repeated rows are
documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import append_array, row_slices, with_field
from tallyhouse.llm.wordhash import code_points, mixed, powers, prefix_sums

K, S, KEPT, SHARE = 12, 4, 64, 1 / 16
# Code points by which the distances of matching anchors may differ.
DRIFT = 1024
# Ranges of ids: about so many characters each, and at most so many.
RANGE_CHARS, MOST_RANGES = 8_000_000, 4096
BLOCK_CHARS = 500_000
_NO_ANCHORS = np.zeros((0, 2), dtype=np.int64)


def _limit(share: float) -> int:
    """Hashes below it belong to the share that is kept whatever the length."""
    return round(share * 2**32)


def anchors(texts: list[str], kept: int = KEPT, share: float = SHARE) -> list[np.ndarray]:
    """For each text its kept anchors, (hash, place) by rising hash."""
    codes, begin = code_points(texts)
    total, down = prefix_sums(codes), powers(len(codes) + 8)[1]
    size = np.diff(begin) - 1
    n = len(codes) - S + 1
    found_text = found_at = np.zeros(0, dtype=np.int64)
    if n > K - S:
        inner = mixed((total[S:] - total[:n]) * down[:n])
        least, width, goal = inner, 1, K - S + 1
        while width < goal:
            step = min(width, goal - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        m = len(least)
        chosen = np.flatnonzero((inner[:m] == least) | (inner[goal - 1 : goal - 1 + m] == least))
        text = np.searchsorted(begin, chosen, side="right") - 1
        inside = chosen + K <= begin[text] + size[text]
        found_at, found_text = chosen[inside], text[inside]
    hashes = mixed((total[found_at + K] - total[found_at]) * down[found_at]) >> np.uint64(32)
    key = (found_text.astype(np.uint64) << np.uint64(32)) | hashes
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, at = key[first], found_at[order[first]]
    text = (key >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    pairs = np.stack([(key & np.uint64(0xFFFFFFFF)).astype(np.int64), at - begin[text]], axis=1)
    out = []
    for i in range(len(texts)):
        own = pairs[bounds[i] : bounds[i + 1]]
        own = own[: max(kept, int(np.searchsorted(own[:, 0], _limit(share))))]
        if not len(own) and size[i]:
            a, b = begin[i : i + 1], begin[i : i + 1] + size[i : i + 1]
            whole = mixed((total[b] - total[a]) * down[a]) >> np.uint64(32)
            own = np.array([[int(whole[0]), 0]], dtype=np.int64)
        out.append(own)
    return out


def to_text(kept: np.ndarray) -> str:
    """Sixteen hex digits for each anchor: its hash and its place."""
    return kept.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    """The anchors of a fingerprint."""
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.int64).reshape(-1, 2)


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT, share: float = SHARE, drift: int = DRIFT) -> float:
    """Share of the anchors, up to the hash where either fingerprint ends, that match in hash and place."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # With fewer than the kept anchors a fingerprint holds all of its text.
    ends = [max(int(x[-1, 0]), _limit(share) - 1) for x in (a, b) if len(x) >= kept]
    union = np.union1d(a[:, 0], b[:, 0])
    both, ia, ib = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    if ends:
        union, keep = union[union <= min(ends)], both <= min(ends)
        ia, ib = ia[keep], ib[keep]
    if not len(ia):
        return 0.0
    distance = a[ia, 1] - b[ib, 1]
    usual = np.sort(distance)[len(distance) // 2]
    return float((np.abs(distance - usual) <= drift).sum() / len(union))


def fingerprints(
    docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", kept: int = KEPT, share: float = SHARE
) -> DataFrame:
    """``docs`` with the fingerprint of ``text_col``, in map tasks."""
    docs = docs.drop(out_col) if out_col in docs.columns else docs
    schema = with_field(docs, out_col, T.StringType())
    keep = schema.names[:-1]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for a, b in row_slices([len(t) for t in texts], BLOCK_CHARS):
                got = pa.array([to_text(k) for k in anchors(texts[a:b], kept, share)], pa.string())
                yield append_array(batch.slice(a, b - a), keep, out_col, got)

    return docs.mapInArrow(run, schema)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (part, guest, doc_id, text) such that each part, sorted, is a stretch of the documents by
    falling id, and ends with a guest: the first document of the next stretch, or of the first
    one after the last. Nulls come last, equal ids by a hash of their texts."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, round(chars / RANGE_CHARS)))
    cuts = rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    splits = [-float("inf"), *sorted({-c for c in cuts}), float("inf")]
    rows = rows.withColumn("_x", -F.col("doc_id").cast("double"))
    if cuts:
        rows = Bucketizer(splits=splits, inputCol="_x", outputCol="part", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("part", F.lit(0))
    rows = rows.withColumn("part", F.col("part").cast("int")).drop("_x")
    heads = rows.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("head")).orderBy("part").collect()
    if not heads:
        return rows.select("part", F.lit(False).alias("guest"), "doc_id", "text", "h")
    moves = [(heads[i - 1].part, r.head.doc_id, r.head.h) for i, r in enumerate(heads)]
    # One row per range, so at most MOST_RANGES + 1.
    moved = F.broadcast(docs.sparkSession.createDataFrame(moves, "to int, _id long, _h long"))
    guests = rows.join(moved, rows["doc_id"].eqNullSafe(moved["_id"]) & (rows["h"] == moved["_h"]))
    natives = rows.select("part", F.lit(False).alias("guest"), "doc_id", "text", "h")
    every = natives.unionByName(guests.select(F.col("to").alias("part"), F.lit(True).alias("guest"), "doc_id", "text", "h"))
    return every.repartition(len(heads), "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.desc("h"))


def _stretches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Blocks of (part, guest, id, text) rows; the last row of a block begins the next one of its part."""
    block: list[tuple] = []
    chars = 0
    for row in rows:
        if block and block[-1][0] != row[0]:
            yield block
            block, chars = [], 0
        if block and block[-1][1]:
            continue  # a guest that stands twice in the table
        block.append(row)
        chars += len(row[3])
        if chars > BLOCK_CHARS and len(block) > 1:
            yield block
            block, chars = [row], len(row[3])
    if block:
        yield block


def compared(docs: DataFrame, kept: int = KEPT, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness, also to the next one.

    The edited text is the document with its last half (rounded down) replaced by as many code
    points from the beginning of the next document by falling id.
    """

    def run(batches):
        rows = (
            (part, guest, i, text or "")
            for batch in batches
            for part, guest, i, text in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)
        )
        for block in _stretches(rows):
            texts = [r[3] for r in block]
            mine = [r for r in block[:-1] if not r[1]]
            if not mine:
                continue
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts[:-1], texts[1:], strict=True)]
            own, new = anchors(texts, kept, share), anchors(edited, kept, share)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[2] for r in mine], pa.int64()),
                    "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                    "fingerprint": [to_text(k) for k in own[:-1]],
                    "edited_fingerprint": [to_text(k) for k in new],
                    "near_edited": [likeness(a, b, kept, share, drift) for a, b in zip(own, new, strict=False)],
                    "near_next": [likeness(a, b, kept, share, drift) for a, b in zip(own[:-1], own[1:], strict=True)],
                }
            )

    return in_order(docs).select("part", "guest", "doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
