"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF word shingles.

Every text's shingles of five words are weighted by their count times a smoothed inverse
document frequency. Consistent weighted sampling draws ``BANDS * ROWS`` samples with the
property that two texts agree on one with the probability of their weighted Jaccard
similarity; texts that agree on all samples of a band become candidates, and candidates are
verified by the exact similarity of their whole texts.

Document frequency is kept per shingle bucket, in bitmaps that count different documents; a
document takes part under its smallest shingle, so near copies count about once however many
there are. The bitmaps have a fixed size and can count 10^15 documents; as frequencies are
relative to the corpus, their noise does not depend on its size.

Within a bucket all texts are first compared with the one that shares most buckets, the rest
again with the one of them that does, ``ROUNDS`` times, in each of the bands. That joins large
groups of near copies without comparing all pairs. Whatever then still lies in one bucket but
not in one class is joined exactly: texts of a similarity of 0.8 share one of their rarest
shingles, those before the last four fifths of a text's weight, so each text meets those of
other classes that share one, linked or not. Classes are the connected components of the
verified links.

Texts that are equal are one text. Null counts as empty, and all texts without a word that
are equal form a class of their own. Texts of fewer than five words are one shingle. Null ids
take part; a class is named by its smallest id that is not null, and null if it has none.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import free_name, row_slices
from tallyhouse.llm.wordhash import mixed, shingles, words
from tallyhouse.session import materialize

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, ROUNDS = 10, 4, 3
# Shingle buckets of the document frequencies; bitmaps of 64 bits in each.
BUCKETS, MAPS = 1 << 15, 16
# Share of the corpus that is added to every frequency.
SMOOTHING = 0.05
BLOCK_CHARS = 400_000
# Slots that count texts by shingle, to tell rare shingles from frequent ones.
SLOTS = 1 << 20
# More than the rounding of single-precision sums of weights can amount to.
SLACK = 1 - 1e-5
# Bits of the bitmap that tells which texts may be wanted: 2 MB, whatever the corpus.
MARK_BITS = 24


def text_key(col: str = "text") -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit("")).cast("binary")))


def _blocks(texts: list[str | None]):
    texts = [t or "" for t in texts]
    for a, b in row_slices([len(t) for t in texts], BLOCK_CHARS):
        hashes, bounds = words(texts[a:b])
        yield a, b, *shingles(hashes, bounds, WORDS)


def note(maps: np.ndarray, bucket: np.ndarray, name: np.ndarray) -> None:
    """Set the bits of hashed ``name`` in the bitmaps of its bucket; ``maps`` has ``MAPS`` words of each."""
    low = name >> np.uint64(8)
    # Of 56 zero bits the last counts as set.
    low = low | np.uint64(1 << 55)
    bit = low & (~low + np.uint64(1))
    np.bitwise_or.at(maps, bucket * MAPS + (name & np.uint64(MAPS - 1)).astype(np.int64), bit)


def counted(bits: np.ndarray) -> np.ndarray:
    """Number of different names noted in each row of ``MAPS`` words."""
    first_gap = np.zeros(bits.shape, dtype=np.int64)
    for k in range(64):
        ones = np.uint64((1 << (k + 1)) - 1)
        first_gap += ((bits & ones) == ones).astype(np.int64)
    return np.where(bits.any(axis=1), MAPS / 0.77351 * 2.0 ** first_gap.mean(axis=1), 0)


def document_frequency(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every shingle bucket."""

    def run(batches):
        maps = np.zeros((BUCKETS + 1) * MAPS, dtype=np.uint64)
        for batch in batches:
            for a, b, shingle, own in _blocks(batch.column(0).to_pylist()):
                least = np.full(b - a, np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(least, own, shingle)
                name = mixed(least + np.uint64(17))
                note(maps, (shingle & np.uint64(BUCKETS - 1)).astype(np.int64), name[own])
                seen = np.unique(own)
                note(maps, np.full(len(seen), BUCKETS), name[seen])
        packed = maps.view(np.int64).reshape(-1, MAPS)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *[pa.array(np.ascontiguousarray(packed[used, k])) for k in range(MAPS)]],
            names=["bucket", *[f"m{k}" for k in range(MAPS)]],
        )

    cols = [f"m{k}" for k in range(MAPS)]
    rows = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{c} long" for c in cols))
    merged = rows.groupBy("bucket").agg(*[F.bit_or(c).alias(c) for c in cols])
    maps = np.zeros((BUCKETS + 1, MAPS), dtype=np.int64)
    for r in merged.collect():
        maps[r.bucket] = r[1:]
    seen = counted(maps.view(np.uint64))
    share = np.minimum(seen[:-1] / max(seen[-1], 1.0), 1.0)
    return np.log1p(1 / (share + SMOOTHING)).astype(np.float32)


def weighted(shingle: np.ndarray, own: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, weight) of the distinct shingles of each text, text after text."""
    order = np.lexsort((shingle, own))
    s, o = shingle[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(s)))
    s, o = s[first], o[first]
    return s, o, count.astype(np.float32) * idf[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]


def _uniform(x: np.ndarray, shift: int) -> np.ndarray:
    """21 bits of each integer as a number within (0, 1)."""
    return (((x >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-21)


def samples(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th consistent sample of each text, as a hash of (shingle, quantised weight).

    The random numbers of a shingle depend on it and on ``k`` alone: a gamma variate r from two
    uniform numbers, another one c from two more, and a uniform shift.
    """
    a = mixed(shingle + np.uint64(0x632BE59BD9B4E019 * (2 * k + 1) % (1 << 64)))
    b = mixed(a + np.uint64(0x9E3779B97F4A7C15))
    r = -np.log(_uniform(a, 0) * _uniform(a, 21))
    log_c = np.log(-np.log(_uniform(a, 42) * _uniform(b, 0)))
    shift = _uniform(b, 21)
    t = np.floor(np.log(weight) / r + shift)
    cost = log_c - r * (t - shift) - r
    least = np.minimum.reduceat(cost, starts)
    size = np.diff(np.append(starts, len(cost)))
    at = np.flatnonzero(cost == np.repeat(least, size))
    text = np.searchsorted(starts, at, side="right") - 1
    chosen = mixed(shingle[at] ^ mixed(t[at].astype(np.int64).astype(np.uint64)))
    out = np.full(len(starts), np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(out, text, chosen)
    return out


def bands(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, bands): one row per row of ``docs`` that has a word."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, shingle, own in _blocks(batch.column(1).to_pylist()):
                s, o, w = weighted(shingle, own, shared.value)
                seen, starts = np.unique(o, return_index=True)
                if not len(seen):
                    continue
                out = np.empty((len(seen), BANDS), dtype=np.uint64)
                for band in range(BANDS):
                    total = np.zeros(len(seen), dtype=np.uint64)
                    for row in range(ROWS):
                        total = mixed(total + samples(s, w, starts, band * ROWS + row))
                    out[:, band] = total
                values = pa.array(out.view(np.int64).ravel())
                ends = pa.array(np.arange(0, len(seen) * BANDS + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(seen + a)), pa.ListArray.from_arrays(ends, values)], names=["id", "bands"]
                )

    return docs.select(text_key().alias("id"), "text").mapInArrow(run, "id binary, bands array<long>")


class Vectors:
    """Weighted shingles of texts, the last few remembered: joined rows come leader by leader."""

    def __init__(self, idf: np.ndarray) -> None:
        self.idf = idf
        self.of = functools.lru_cache(maxsize=8)(self._vector)

    def _vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        s, _, w = weighted(*shingles(*words([text]), WORDS), self.idf)
        return s, w

    def similarity(self, a: str, b: str) -> float:
        """Weighted Jaccard similarity of two texts."""
        (sa, wa), (sb, wb) = self.of(a), self._vector(b)
        at = np.minimum(np.searchsorted(sa, sb), len(sa) - 1)
        both = sa[at] == sb
        low = float(np.minimum(wa[at[both]], wb[both]).sum(dtype=np.float64))
        return low / max(float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - low, 1e-12)


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, leader, similarity) of candidate pairs whose whole texts are similar enough."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        vectors = Vectors(shared.value)
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sims = np.array([vectors.similarity(a, b) for a, b in zip(left, right, strict=True)])
            keep = pa.array(np.flatnonzero(sims >= SIMILARITY))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sims).take(keep)],
                names=["id", "leader", "similarity"],
            )

    leader = texts.select(F.col("id").alias("leader"), F.col("text").alias("leader_text"))
    both = pairs.join(texts, "id").join(leader, "leader").select("id", "leader", "leader_text", "text")
    return both.mapInArrow(run, "id binary, leader binary, similarity double")


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """Number of texts by slot of their shingles; at most ``SLOTS`` numbers reach the driver."""

    def run(batches):
        count = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, _, shingle, own in _blocks(batch.column(0).to_pylist()):
                s, _, _ = weighted(shingle, own, np.ones(BUCKETS, np.float32))
                count += np.bincount((s & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def leading(s: np.ndarray, o: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, rest, total) of each text's rarest shingles: two texts similar enough share one.

    ``rest`` is the weight from that shingle on. What two texts have in common is at most the
    rest of either at the first shingle they share, and has to be 0.8 of the weight of both.
    """
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    at = np.lexsort((s, counts[(s & np.uint64(SLOTS - 1)).astype(np.int64)], o))
    _, starts, size = np.unique(o, return_index=True, return_counts=True)
    weight = w[at].astype(np.float64)
    total = np.repeat(np.add.reduceat(weight, starts), size)
    before = np.cumsum(weight) - weight
    rest = total - (before - np.repeat(before[starts], size))
    keep = rest >= SIMILARITY * SLACK * total
    return at[keep], rest[keep], total[keep]


def prefixes(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, root, shingle, rest, total): the rarest shingles of ``texts`` (id, root, text)."""
    shared = texts.sparkSession.sparkContext.broadcast((idf, shingle_counts(texts).astype(np.int64)))

    def run(batches):
        idf, counts = shared.value
        for batch in batches:
            for a, _, shingle, own in _blocks(batch.column(2).to_pylist()):
                s, o, w = weighted(shingle, own, idf)
                at, rest, total = leading(s, o, w, counts)
                row = pa.array(o[at].astype(np.int64) + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(s[at].view(np.int64)),
                     pa.array(rest.astype(np.float32)), pa.array(total.astype(np.float32))],
                    names=["id", "root", "shingle", "rest", "total"],
                )

    return texts.select("id", "root", "text").mapInArrow(run, "id binary, root binary, shingle long, rest float, total float")


def across(rows: DataFrame) -> DataFrame:
    """(id, leader): all pairs of ``prefixes`` of different roots that may be similar enough.

    Under each shingle the root of most texts stands on one side only, so a large class meets
    the texts outside it and never itself.
    """
    roots = rows.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    several = roots.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter(F.col("roots") > 1)
    several = materialize(several.select("shingle", F.col("main.root").alias("main")), "shared-shingles")
    rows = materialize(rows.join(several, "shingle"), "shared-prefixes")
    other = rows.filter(F.col("root") != F.col("main")).drop("main")
    other = materialize(other.select("shingle", *[F.col(c).alias(f"_{c}") for c in ("id", "root", "rest", "total")]), "outside-prefixes")
    common = SIMILARITY / (1 + SIMILARITY) * SLACK * (F.col("total") + F.col("_total"))
    pairs = rows.join(other, "shingle").filter(
        (F.col("root") != F.col("_root")) & ((F.col("root") == F.col("main")) | (F.col("id") < F.col("_id")))
        & (F.least("rest", "_rest") >= common) & (F.least("total", "_total") >= SIMILARITY * SLACK * F.greatest("total", "_total"))
    )
    return pairs.select(F.greatest("id", "_id").alias("id"), F.least("id", "_id").alias("leader")).distinct()


def remaining(members: DataFrame, texts: DataFrame, idf: np.ndarray, found: DataFrame, tested: DataFrame) -> DataFrame:
    """Verified links between texts that share a bucket of ``members`` and that ``found`` leaves in different classes."""
    roots = components(found)
    rooted = materialize(members.select("id", "band", "cell").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted-members")
    # Two texts alone in a bucket have been compared.
    parted = rooted.groupBy("band", "cell").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"))
    parted = materialize(parted.filter((F.col("a") != F.col("b")) & (F.col("n") > 2)).select("band", "cell"), "parted-buckets")
    open_ids = materialize(rooted.join(parted, ["band", "cell"], "left_semi").select("id", "root").distinct(), "open-texts")
    rows = materialize(prefixes(texts.join(open_ids, "id"), idf), "prefixes")
    known = tested.select(F.greatest("id", "leader").alias("id"), F.least("id", "leader").alias("leader"))
    pairs = materialize(across(rows).join(known, ["id", "leader"], "left_anti"), "remaining-pairs")
    return materialize(verify(pairs, texts, idf), "verified-rest")


def _marks(ids: DataFrame) -> np.ndarray:
    """Bitmap of ids by the first ``MARK_BITS`` bits of their hash; at most 2^18 words reach the driver."""
    at = F.conv(F.substring(F.hex("id"), 1, MARK_BITS // 4), 16, 10).cast("long")
    bit = F.expr("shiftleft(1L, cast(at % 64 AS INT))")
    found = ids.select(at.alias("at")).select(F.floor(F.col("at") / 64).alias("word"), bit.alias("bit"))
    out = np.zeros((1 << MARK_BITS) // 64, dtype=np.int64)
    for r in found.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r.word] = r.bits
    return out


def _marked(keyed: DataFrame, marks: np.ndarray) -> DataFrame:
    """Rows (id, text) whose mark is set: all that are wanted, and few others, before any shuffle."""
    shared = keyed.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        for batch in batches:
            ids = np.frombuffer(b"".join([i[:4] for i in batch.column(0).to_pylist()]), dtype=">u4").astype(np.int64) >> (32 - MARK_BITS)
            yield batch.filter(pa.array((shared.value[ids // 64] >> (ids % 64)) & 1 == 1))

    return keyed.select("id", "text").mapInArrow(run, "id binary, text string")


def links(docs: DataFrame) -> DataFrame:
    """(id, leader, similarity): verified links between different texts of ``docs``."""
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    idf = document_frequency(docs)
    drawn = bands(docs, idf).groupBy("id").agg(F.first("bands").alias("bands"))
    cells = materialize(drawn.select("id", F.posexplode("bands").alias("band", "cell")), "bands")
    sizes = cells.groupBy("band", "cell").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    members = materialize(cells.join(materialize(sizes, "band-sizes"), ["band", "cell"]), "band-members")
    rank = materialize(members.groupBy("id").agg(F.sum("size").alias("score")), "scores")
    every = members = materialize(members.select("id", "band", "cell").join(rank, "id"), "ranked-members")
    involved = materialize(rank.select("id"), "involved")
    keyed = docs.withColumn("id", text_key())
    texts = _marked(keyed, _marks(involved)).join(involved, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    texts = materialize(texts, "candidate-texts")
    found = tested = None
    for _ in range(ROUNDS):
        heads = members.groupBy("band", "cell").agg(F.max(F.struct("score", "id")).alias("head"))
        heads = materialize(heads.select("band", "cell", F.col("head.id").alias("leader")), "heads")
        led = materialize(members.join(heads, ["band", "cell"]).filter(F.col("id") != F.col("leader")), "led")
        pairs = led.select("id", "leader").distinct()
        fresh = pairs if tested is None else pairs.join(tested, ["id", "leader"], "left_anti")
        good = materialize(verify(fresh, texts, idf), "verified")
        found = good if found is None else found.unionByName(good)
        tested = pairs if tested is None else tested.unionByName(pairs).distinct()
        rest = led.join(found.select("id", "leader"), ["id", "leader"], "left_anti")
        members = materialize(rest.select("id", "band", "cell", "score"), "unlinked")
        if members.isEmpty():
            break
    return found.unionByName(remaining(every, texts, idf, found, tested))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected component, for ids that have an edge.

    Each step takes the least root among neighbours and then that root's own root, so the
    number of steps grows with the logarithm of a chain's length. Roots only ever fall.
    """
    both = edges.select("id", "leader").unionByName(edges.select(F.col("leader").alias("id"), F.col("id").alias("leader")))
    both = materialize(both.distinct(), "edges")
    roots = materialize(both.groupBy("id").agg(F.least(F.col("id"), F.min("leader")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("id").alias("leader"), F.col("root").alias("near")), "leader").groupBy("id").agg(F.min("near").alias("near"))
        low = roots.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        stepped = low.join(above, "root", "left").select("id", "old", F.least("root", "above").alias("root"))
        stepped = materialize(stepped, "roots")
        roots = stepped.select("id", "root")
        if stepped.filter(F.col("old") != F.col("root")).isEmpty():
            return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_copies): one row per row of ``docs``.

    ``class_id`` is the smallest id of the class, ``n_links`` counts the verified links of the
    row's text to different texts that made the class, not all texts like it; ``n_copies`` the rows of the same text.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    edges = materialize(links(docs), "links")
    roots = materialize(components(edges), "components")
    ends = edges.select("id").unionByName(edges.select(F.col("leader").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("n_links"))
    linked = materialize(roots.join(degree, "id"), "linked-texts")
    rows = docs.select("doc_id", text_key().alias("id"))
    copies = materialize(rows.groupBy("id").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("least")), "copies")
    named = copies.join(linked, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "least")
    named = materialize(named, "named-texts")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("class_id")), "class-names")
    texts = materialize(named.join(least, "root").select("id", "class_id", "n_links", "n_copies"), "text-classes")
    return rows.join(texts, "id").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, then text. Of rows alike in
    both the least hash of all other columns decides; rows alike in every column count as one."""
    edges = materialize(links(docs), "links")
    roots = materialize(components(edges), "components")
    key, first, least = (free_name(docs.columns, c) for c in ("_key", "_first", "_least"))
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    tie = F.xxhash64(F.to_json(F.struct(F.col("text").isNull().alias("c"), *others)))
    rows = docs.select("doc_id", text_key().alias("id"), tie.alias("tie"))
    named = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("tie").alias("t"))
    copies = materialize(rows.groupBy("id").agg(F.min(named).alias("first")), "copies")
    rooted = materialize(copies.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    best = rooted.groupBy("root").agg(F.min(F.struct("first", "id")).alias("best"))
    best = best.select(F.col("best.id").alias(key), F.col("best.first.d").alias(first), F.col("best.first.t").alias(least))
    kept = docs.withColumn(key, text_key()).join(materialize(best, "kept-texts"), key)
    kept = kept.filter(F.col("doc_id").eqNullSafe(F.col(first)) & (tie == F.col(least)))
    # Rows alike in every column: one of them stays.
    return kept.dropDuplicates([key]).select(*docs.columns)
