"""Importance resampling towards a target distribution, on hashed runs of words.

A bucket's gain is the log ratio of its smoothed shares in target and corpus; a document's
weight is the mean gain of its runs, read from an array by bucket. Scores add seeded Gumbel
noise, so that the highest are a draw without replacement. The cutoff is found by bracketing:
a quantile sketch proposes two scores, the rows above and between are counted exactly, the
bracket is widened until the wanted row lies in it, and only its rows are sorted.

Words are runs of digits, a to z (after lower-casing A to Z) and all that is not ASCII, and
are found in the UTF-8 bytes: every byte from 128 on belongs to a word. Null and empty texts
have no runs and weight 0. A null id reads as the empty string in the noise and comes last
among ties. Repeated rows are drawn each by itself; rows alike in score and id take
consecutive ranks in any order. Empty tables count as zero runs. Further columns pass through;
the text itself is not carried along, and is joined back by id where it is wanted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import free_name, row_slices, running
from tallyhouse.session import materialize

BUCKETS, LONGEST_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
# Bytes of text looked at in one go, and of a word up to which all words are hashed together.
BLOCK, TOGETHER = 2 << 20, 32
# Share of the rows by which the first bracket reaches to either side of the cutoff.
MARGIN = 0.002

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _crc_steps() -> np.ndarray:
    """What one byte does to a checksum, by the polynomial of CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


STEPS = _crc_steps()


def extended(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Checksum states after the bytes from ``start`` to ``end``, all rows at once; long ones by themselves."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    ahead = int(np.count_nonzero(size > TOGETHER))
    out = state[order]
    for i, row in enumerate(order[:ahead]):
        out[i] = ~np.uint32(zlib.crc32(data[start[row] : end[row]].tobytes(), int(~out[i])))
    at, left = start[order], size[order]
    # Rows stand by falling size, so those with a byte at place j are a leading run.
    have = np.searchsorted(-left, -np.arange(TOGETHER), side="left")
    for j in range(TOGETHER):
        if have[j] <= ahead:
            break
        own = slice(ahead, have[j])
        out[own] = (out[own] >> np.uint32(8)) ^ STEPS[(out[own] ^ data[at[own] + j]) & np.uint32(255)]
    back = np.empty_like(out)
    back[order] = out
    return back


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of the texts that ``bounds`` cut ``data`` into."""
    w = WORD[data]
    before, behind = np.zeros_like(w), np.zeros_like(w)
    before[1:], behind[:-1] = w[:-1], w[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before[edges], behind[edges - 1] = False, False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~behind) + 1


def _whole(data: np.ndarray, bounds: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = words(data, bounds)
    first = np.searchsorted(start, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    state, found, owner = np.full(len(start), 0xFFFFFFFF, np.uint32), [], []
    for n in range(1, longest + 1):
        # Rows whose run of n words ends within the same text.
        k = len(start) - n + 1
        if k <= 0:
            break
        state = extended(state[:k], data, start[n - 1 :], end[n - 1 :])
        inside = text[:k] == text[n - 1 :]
        found.append((~state[inside]) % np.uint32(buckets))
        owner.append(text[:k][inside])
        state = (state >> np.uint32(8)) ^ STEPS[(state ^ np.uint32(32)) & np.uint32(255)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]).astype(np.int64), np.concatenate([none, *owner]).astype(np.int64), np.diff(first)


def runs(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column: first and last row, buckets of the runs, their rows and the words by row.

    A row longer than a slice comes in several, cut where no word is; with runs of several
    words it comes in one.
    """
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for a, b in row_slices(np.diff(offsets).tolist(), BLOCK):
        data = LOWER[raw[offsets[a] : offsets[b]]]
        if b - a == 1 and longest == 1 and len(data) > 2 * BLOCK:
            at = 0
            while at < len(data):
                cut = min(at + BLOCK, len(data))
                while cut < len(data) and WORD[data[cut]]:
                    ahead = np.flatnonzero(~WORD[data[cut : cut + BLOCK]])
                    cut = cut + int(ahead[0]) if len(ahead) else min(cut + BLOCK, len(data))
                yield a, b, *_whole(data[at:cut], np.array([0, cut - at]), longest, buckets)
                at = cut
        else:
            yield a, b, *_whole(data, offsets[a : b + 1] - offsets[a], longest, buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Runs per bucket over all rows. Tasks count into arrays; at most ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found, _, _ in runs(batch.column(0), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    rows = texts.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares, floored, by bucket."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s + n)) / ((corpus + 1.0) * (t + n))
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str, names: tuple[str, str, str], longest: int = LONGEST_RUN) -> DataFrame:
    """``docs`` with the number of words and of runs, and the floored mean gain."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])
    place = docs.columns.index(text_col)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total, size = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b, found, owner, n_words in runs(batch.column(place), longest, len(gain)):
                n[a:b] += np.bincount(owner, minlength=b - a)
                np.add.at(total, owner + a, gain[found])
                size[a:b] += n_words
            mean = np.where(n > 0, total // np.maximum(n, 1), 0)
            new = [pa.array(x, pa.int64()) for x in (size, n, mean)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(weigh, schema)


def bracket(scores: DataFrame, score: str, wanted: int, rows: int, margin: float = MARGIN) -> tuple[int, int, int]:
    """Two scores between which the row ``wanted`` from above lies, and how many rows lie above them.

    The sketch only proposes; both counts are exact, and decide.
    """
    share = 1 - wanted / rows
    while True:
        sides = [F.percentile_approx(score, F.lit(min(max(x, 0.0), 1.0)), 10_000) for x in (share - margin, share + margin)]
        least, most, low, high = scores.agg(F.min(score), F.max(score), *sides).first()
        low, high = least if margin >= 1 else low, most if margin >= 1 else high
        above, upto = scores.agg(F.count_if(F.col(score) > high), F.count_if(F.col(score) >= low)).first()
        if above < wanted <= upto:
            return low, high, above
        margin = max(8 * margin, MARGIN)


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
    min_words: int = MIN_WORDS, seed: int = SEED, longest: int = LONGEST_RUN, buckets: int = BUCKETS, margin: float = MARGIN,
) -> DataFrame:
    """``docs``, but for the text, with n_features, weight, score and the rank of the rows that are drawn.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred are drawn.
    """
    new = ("n_features", "weight", "score", "rank")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    if not isinstance(docs.schema[text_col].dataType, T.StringType):
        raise TypeError(f"{text_col} holds no text")
    size = free_name(docs.columns, "n_words")
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, "text", longest, buckets))
    rows = weighed(docs, gain, text_col, (size, "n_features", "weight"), longest)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = materialize(rows.drop(text_col).withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col(size) >= min_words
    number = rows.filter(fit).count()
    wanted = percent * number // 100
    kept = [*(c for c in docs.columns if c != text_col), "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*kept, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(rows.filter(fit), "score", wanted, number, margin)
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last()]
    before = free_name(rows.columns, "before")
    place = F.col(before) + 1
    top = running(rows.filter(fit & (F.col("score") > high)), order, "drawn", before).select(*kept, place.alias("rank"))
    between = running(rows.filter(fit & F.col("score").between(low, high)), order, "bracket", before)
    place = place + above
    middle = between.select(*kept, F.when(place <= wanted, place).alias("rank"))
    rest = rows.filter(~fit | (F.col("score") < low)).select(*kept, F.lit(None).cast("long").alias("rank"))
    return top.unionByName(middle).unionByName(rest)


# The same draw in SQL, checksum included.
SQL = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS s),
tokens AS (SELECT doc_id, unnest(w) AS w FROM docs),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM tokens UNION ALL SELECT w FROM goal)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM vocabulary, steps),
corpus AS (SELECT bucket, count(*) AS s FROM tokens JOIN hashed USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t_all),
gain AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + {BUCKETS})) / ((s + 1.0::DOUBLE) * (t_all + {BUCKETS}))))::BIGINT AS g
  FROM corpus LEFT JOIN target USING (bucket), sums),
weights AS (
  SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM tokens JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {MIN_WORDS}
  QUALIFY rank <= {PERCENT} * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
