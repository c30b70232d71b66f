"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Four filters look at a text alone; the fifth asks whether a smaller id has the same text.
That one is told by radix tries: map tasks insert the texts of a block into a compressed trie
whose terminals hold the least id, so of equal texts in a block one goes on; the blocks' tries
name prefixes at which texts part into even ranges, and every range has its trie, which meets
the blocks' least ids. Each row then has a mask of the filters it fails; rows are counted by
part and mask, and all orders follow from at most 32 counts a part.

Null texts are empty, and empty texts equal. A row without id never fails the fifth filter
nor makes another fail it. Repeated rows count each; rows of one id and one text do not make
each other fail. Parts are the values of ``source``, null being the empty string. A document
with several labels has a label if any of them says so. Further columns are not looked at. An
empty table has no parts and so no rows.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import row_slices, running
from tallyhouse.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
UPPER = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))
DUPLICATE = 16
# Bytes of text in a block's trie and in a range's; into how many parts a block names cuts.
BLOCK, PARTS, RANGE = 16 << 20, 16, 4 << 20
# Ranges at most, and bytes of the prefixes between them that are sent to every task.
MAX_RANGES, MAX_CUT_BYTES = 1 << 20, 64 << 20


def text_mask(text: bytes) -> int:
    """Which of the filters A to D a text fails, as bits 1, 2, 4 and 8."""
    words = text.split()
    points = len(text.translate(None, CONTINUED))
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > UPPER_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


class Node:
    """A place in a trie: the bytes that lead to it, what follows by first byte, and a terminal's
    least id with the rows that have it."""

    __slots__ = ("follow", "label", "least", "mask", "rows")

    def __init__(self, label: bytes) -> None:
        self.label, self.follow, self.least, self.mask, self.rows = label, {}, None, None, None


class Trie:
    """A compressed trie of whole texts."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, text: bytes) -> Node:
        """The terminal of ``text``."""
        node, at = self.root, 0
        while at < len(text):
            below = node.follow.get(text[at])
            if below is None:
                below = node.follow[text[at]] = Node(text[at:])
                return below
            if text.startswith(below.label, at):
                node, at = below, at + len(below.label)
                continue
            k = shared(below.label, text, at)
            fork = node.follow[text[at]] = Node(below.label[:k])
            below.label = below.label[k:]
            fork.follow[below.label[0]] = below
            node, at = fork, at + k
        return node

    def walk(self) -> Iterator[tuple[Node, list[bytes]]]:
        """Every node in the order of the texts, with the labels that lead to it."""
        path, open_ = [], [(self.root, 0)]
        while open_:
            node, depth = open_.pop()
            del path[depth:]
            path.append(node.label)
            yield node, path
            open_ += [(node.follow[b], depth + 1) for b in sorted(node.follow, reverse=True)]


def shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the longest common prefix of ``label`` and ``text[at:]``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


ROWS = pa.schema([
    ("part", pa.string()), ("doc_id", pa.int64()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary()), ("weight", pa.int64()),
])
ROWS_SQL = "part string, doc_id long, mask int, n long, text binary, weight long"
FLAGGED = pa.schema(list(ROWS)[:4])
FLAGGED_SQL = "part string, doc_id long, mask int, n long"


def _batches(rows: list[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    sizes = [32 + (len(r[4]) if len(r) > 4 and r[4] else 0) for r in rows]
    for a, b in row_slices(sizes, limit):
        columns = zip(*rows[a:b], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def cuts(trie: Trie, step: int) -> Iterator[tuple[bytes, int]]:
    """Shortest prefixes that part the trie's texts about every ``step`` bytes, and the bytes before each."""
    weight = 0
    for node, path in trie.walk():
        if weight >= step and node.label:
            yield b"".join(path[:-1]) + node.label[:1], weight
            weight = 0
        if node.rows:
            weight += sum(map(len, path)) + 64
    if weight:
        # Nothing stands behind these; they only count as bytes.
        yield b"", weight


def _block(rows: list[tuple[int | None, str, bytes]], parts: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block by what is known of them, and where the block's texts can be cut."""
    trie, at = Trie(), []
    for doc_id, _, text in rows:
        node = trie.insert(text)
        if node.mask is None:
            node.mask = text_mask(text)
        if doc_id is not None and (node.least is None or doc_id < node.least):
            node.least = doc_id
        at.append(node)
    settled: dict[tuple, int] = {}
    for node, (doc_id, part, text) in zip(at, rows, strict=True):
        if doc_id is None or doc_id > node.least:
            key = (part, doc_id, node.mask | (0 if doc_id is None else DUPLICATE))
            settled[key] = settled.get(key, 0) + 1
        else:
            node.rows = node.rows or (text, {})
            node.rows[1][part] = node.rows[1].get(part, 0) + 1
    out = [(*key, n, None, None) for key, n in settled.items()]
    seen = set()
    for node in at:
        if node.rows and id(node) not in seen:
            seen.add(id(node))
            out += [(part, node.least, node.mask, n, node.rows[0], None) for part, n in node.rows[1].items()]
    step = sum(len(text) + 64 for _, _, text in rows) // parts
    out += [(None, None, None, None, cut, weight) for cut, weight in cuts(trie, step)]
    yield from _batches(out, ROWS)


def _blocks(block: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            sizes = [64 + (n or 0) for n in pc.binary_length(texts).to_pylist()]
            for a, b in row_slices(sizes, block // 4):
                ids, sources = batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist()
                rows += [(i, s or "", t or b"") for i, s, t in zip(ids, sources, texts[a:b].to_pylist(), strict=True)]
                held += sum(sizes[a:b])
                if held >= block:
                    yield from _block(rows, parts)
                    rows, held = [], 0
        if rows:
            yield from _block(rows, parts)

    return run


def boundaries(named: DataFrame, range_bytes: int = RANGE) -> list[bytes]:
    """Prefixes between ranges of about ``range_bytes``, from the cuts of all blocks; their number and bytes are bounded."""
    placed = running(named, ["text", "weight"], "trie-cuts", "before", "weight")
    total = named.agg(F.sum("weight")).first()[0] or 0
    target = max(range_bytes, -(-total // MAX_RANGES))
    while True:
        upto = F.col("before") + F.col("weight")
        chosen = placed.filter((F.floor(upto / target) > F.floor(F.col("before") / target)) & (F.length("text") > 0)).select("text")
        if (chosen.agg(F.sum(F.length("text"))).first()[0] or 0) <= MAX_CUT_BYTES:
            return sorted({bytes(r.text) for r in chosen.distinct().collect()})
        target *= 2


def _routed(bounds: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4)
            sizes = pc.binary_length(texts).to_pylist()
            for a, b in row_slices(sizes, 4 << 20):
                where = [bisect.bisect_right(bounds, t) for t in texts[a:b].to_pylist()]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(where, pa.int32())], names=[*part.schema.names[:5], "range"])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range after another: those whose id is not their text's least fail the duplicate filter."""

    def closed(trie: Trie | None) -> list[tuple]:
        found = [node for node, _ in trie.walk() if node.rows] if trie else []
        return [(part, node.least, mask, n) for node in found for (part, mask), n in node.rows.items()]

    trie = now = None
    for batch in batches:
        out = []
        texts, where = batch.column(4), batch.column(5).to_pylist()
        narrow = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        for a, b in row_slices(pc.binary_length(texts).to_pylist(), 4 << 20):
            for (part, doc_id, mask, n), text, at in zip(narrow[a:b], texts[a:b].to_pylist(), where[a:b], strict=True):
                if at != now:
                    out += closed(trie)
                    trie, now = Trie(), at
                node = trie.insert(text)
                if node.least is not None and doc_id > node.least:
                    out.append((part, doc_id, mask | DUPLICATE, n))
                    continue
                if node.least is None or doc_id < node.least:
                    out += [(p, node.least, m | DUPLICATE, k) for (p, m), k in (node.rows or {}).items()]
                    node.least, node.rows = doc_id, {}
                node.rows[part, mask] = node.rows.get((part, mask), 0) + n
        if out:
            yield from _batches(out, FLAGGED)
    if last := closed(trie):
        yield from _batches(last, FLAGGED)


def masked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    block: int = BLOCK, parts: int = PARTS, range_bytes: int = RANGE,
) -> DataFrame:
    """(part, doc_id, mask, n): the rows of each document by the filters they fail; bits 1 to 16 are A to E."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(part_col).alias("part"), F.col(text_col).alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(block, parts), ROWS_SQL), "trie-blocks")
    bounds = boundaries(blocks.filter(F.col("weight").isNotNull()).select("text", "weight"), range_bytes)
    open_rows = blocks.filter(F.col("weight").isNull() & F.col("text").isNotNull())
    routed = open_rows.mapInArrow(_routed(bounds), "part string, doc_id long, mask int, n long, text binary, range int")
    met = routed.repartition("range").sortWithinPartitions("range").mapInArrow(_ranges, FLAGGED_SQL)
    settled = blocks.filter(F.col("weight").isNull() & F.col("text").isNull()).select(*met.columns)
    return settled.unionByName(met)


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there."""
    rows = masked(docs, **options).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    of = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    )
    counts = rows.join(of, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"),
    )
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("masks"))
    steps = (
        parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)"))
        .withColumn(
            "earlier",
            F.expr(f"aggregate(filter(sequence(1, 5), i -> i < step), 0, (m, i) -> m | shiftleft(1, instr('{FILTERS}', substr(filter_order, i, 1)) - 1))"),
        )
    )

    def total(field: str, where: str):
        return F.expr(f"aggregate(filter(masks, x -> {where}), 0L, (s, x) -> s + x.{field})")

    removed = "x.mask & earlier = 0 AND x.mask & bit <> 0"
    share = f"aggregate(filter(masks, x -> x.mask & bit <> 0), 0L, (s, x) -> s + x.n * CAST({len(ORDERS)} DIV bit_count(x.mask) AS BIGINT))"
    return steps.select(
        "part", "filter_order", "step",
        total("n", "x.mask & (earlier | bit) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "x.mask & earlier <> 0 AND x.mask & bit <> 0").alias("redundant"),
        total("n", "x.mask = bit").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("bad", removed).alias("toxic_lost"),
        F.expr(share).alias("shapley"),
    )


# The same counts in SQL, over the whole table.
SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS bad FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, doc_id,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM words),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (bad = 1) AS bad
  FROM fails LEFT JOIN lab USING (doc_id) GROUP BY part, mask),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
steps AS (
  SELECT filter_order, s::INTEGER AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INTEGER AS earlier
  FROM orders, range(1, 6) r(s)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
