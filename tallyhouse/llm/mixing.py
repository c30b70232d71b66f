"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are folded to membership patterns, the sets of sources they belong to. Patterns and
sources form a small network: a pattern supplies its size once at no cost, once more at a
cost, and a third time at a higher one, so repetition is spread as thin as it can be; a source
takes up to its target. The cheapest flow says how many words of each pattern count for each
source. Documents are then taken whole: every document of a pattern as often as its flow
covers fully, and for the rest those that come first in a seeded order, found by slices of
that order, so no source's documents meet in one task.

What reaches the driver is one row per pattern, never per document. Targets share the size of
the corpus by weight, stop at ``MOST`` times their source's size and pass the excess on by
weight. Null texts have size 0; a null source is a source of its own, last in order. Rows
that are alike in id and text are taken alike. Documents of size 0 are taken with 0 words.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import free_name
from tallyhouse.session import materialize

MOST = 3
# Slices of the seeded order on each level.
SLICES = 1024


def word_count(text: Column) -> Column:
    """Runs of anything but blanks and control white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, most: int = MOST) -> dict:
    """Share of the whole size by weight, at most ``most`` times a source's size; the excess goes
    to the others by weight until none is above."""
    out, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] > most * sizes[s] * total]
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            open_.remove(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


class Flow:
    """Cheapest flow by shortest augmenting paths with potentials."""

    def __init__(self, nodes: int) -> None:
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.cost: list[float] = []

    def add(self, a: int, b: int, room: float, cost: float) -> int:
        """An arc and its way back; the arc's number."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int, least: float = 1e-9) -> None:
        """Send as much as fits, the cheapest first."""
        n = len(self.arcs)
        height = [0.0] * n
        while True:
            far, by = [float("inf")] * n, [-1] * n
            far[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a] + 1e-12:
                    continue
                for e in self.arcs[a]:
                    b = self.to[e]
                    new = d + self.cost[e] + height[a] - height[b]
                    if self.room[e] > least and new < far[b] - 1e-12:
                        far[b], by[b] = new, e
                        heapq.heappush(heap, (new, b))
            if by[sink] < 0:
                return
            height = [h + (d if d < float("inf") else 0.0) for h, d in zip(height, far, strict=True)]
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = self.to[by[at] ^ 1]
            sent = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= sent
                self.room[e ^ 1] += sent


def route(patterns: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple[tuple, object], float]:
    """Words of each pattern that count for each of its sources, by the cheapest flow.

    A pattern's second and third use cost 1 and 3 a word.
    """
    keys, names = list(patterns), list(quotas)
    place = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    net = Flow(2 + len(keys) + len(names))
    arcs = {}
    for i, key in enumerate(keys):
        for level in range(most):
            net.add(0, 2 + i, float(patterns[key]), level * (level + 1) / 2)
        for s in key:
            arcs[key, s] = net.add(2 + i, place[s], float(most * patterns[key]), 0.0)
    for s in names:
        net.add(place[s], 1, float(quotas[s]), 0.0)
    net.run(0, 1)
    return {k: net.room[e ^ 1] for k, e in arcs.items()}


def _order(df: DataFrame, seed: int) -> DataFrame:
    """A seeded place in [0, 2^31) for each row, by id and text."""
    return df.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(1 << 31)))


def _prefix(rows: DataFrame, rest: DataFrame, slot: Column) -> DataFrame:
    """Running size before each slot of each pattern, with what the pattern still wants."""
    sizes = rows.groupBy("pattern", slot.alias("slot")).agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pattern").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(rest), "pattern")


def select(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(pattern, u, times) rules as columns on ``docs``: how often each document is taken.

    ``plan`` has for each pattern the whole rounds every document takes part in and the words
    of a further, partial round. That round goes to the documents before a cut in the seeded
    order; of the others the one document that comes closest to the words still missing, and
    of the kept ones none, is added, if that brings the sum nearer.
    """
    rows = _order(docs, seed)
    top, low = F.floor(F.col("u") / (1 << 21)), F.floor(F.col("u") / (1 << 11)) % SLICES
    want = plan.select("pattern", "rest")
    first = _prefix(rows, want, top)
    cut = first.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    cut = materialize(cut.select("pattern", F.col("slot").alias("slice"), (F.col("rest") - F.col("before")).alias("rest")), "mix-cut")
    # Cuts, edges and extras have one row per pattern at most, as the plan, which the driver holds.
    inner = rows.join(F.broadcast(cut.withColumnRenamed("slice", "s").drop("rest")), "pattern").filter(top == F.col("s"))
    second = _prefix(inner.select("pattern", "u", "size"), cut.select("pattern", "rest"), low)
    deep = second.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    deep = deep.select("pattern", F.col("slot").alias("sub"), (F.col("rest") - F.col("before")).alias("rest"))
    cuts = materialize(cut.drop("rest").join(deep, "pattern"), "mix-cuts")
    last = rows.join(F.broadcast(cuts.drop("rest")), "pattern").filter((top == F.col("slice")) & (low == F.col("sub")))
    third = _prefix(last.select("pattern", "u", "size"), cuts.select("pattern", "rest"), F.col("u"))
    # The cut itself: documents before it are in. What is still missing then is ``gap``.
    edge = third.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    edge = materialize(edge.select("pattern", F.col("slot").alias("edge"), (F.col("rest") - F.col("before")).alias("gap")), "mix-edge")
    marked = rows.join(F.broadcast(edge), "pattern", "left").join(F.broadcast(plan), "pattern", "left")
    marked = marked.withColumn("inside", F.coalesce(F.col("u") < F.col("edge"), F.lit(False)))
    alike = marked.filter(~F.col("inside") & (F.col("gap") > 0)).groupBy("pattern", "gap", "u", "doc_id", "text_hash").agg(F.sum("size").alias("size"))
    near = alike.filter(F.abs(F.col("size") - F.col("gap")) < F.col("gap")).groupBy("pattern").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("d"), "u", "doc_id", "text_hash")).alias("extra")
    )
    near = materialize(near.select("pattern", F.col("extra.u").alias("eu"), F.col("extra.doc_id").alias("eid"), F.col("extra.text_hash").alias("eh")), "mix-extra")
    out = marked.join(F.broadcast(near), "pattern", "left")
    extra = (F.col("u") == F.col("eu")) & F.col("doc_id").eqNullSafe(F.col("eid")) & (F.col("text_hash") == F.col("eh"))
    times = F.coalesce(F.col("rounds"), F.lit(0)) + F.when(F.col("inside") | F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    return out.withColumn("times", F.least(times, F.lit(MOST)).cast("int"))


def mix(
    docs: DataFrame, sources: Column, weigh: Callable[[list], dict], seed: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, dict]:
    """How often each document is taken, and the targets of the sources.

    ``sources`` gives the sources of a document as an array, ``weigh`` the weights of the sorted
    sources. The result has doc_id, text_hash, pattern (the sorted sources), size and times.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), word_count(F.col(text_col)).alias("size"),
        F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("pattern"),
    )
    rows = materialize(rows, "mix-rows")
    folded = {tuple(r.pattern): r.size for r in rows.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    names = sorted({s for p in folded for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for p, n in folded.items() if s in p) for s in names}
    whole = {s: n for s, n in targets(sizes, weigh(names)).items()}
    # Sizes of overlapping sources count a document more than once; quotas share what there is.
    scale = sum(folded.values()) / max(sum(whole.values()), 1.0)
    quotas = {s: t * min(1.0, scale) for s, t in whole.items()}
    flow = route(folded, quotas)
    spark = docs.sparkSession
    plan = []
    for p, n in folded.items():
        sent = round(sum(flow[p, s] for s in p), 6)
        rounds = min(MOST, int(sent // n)) if n else 0
        plan.append((list(p), rounds, float(sent - rounds * n) if n else 0.0))
    frame = spark.createDataFrame(plan, "pattern array<string>, rounds int, rest double")
    return select(rows, frame, seed), quotas


def by_rank(names: list) -> dict:
    """Weights 1, 2, 3 and again, in order."""
    return {s: i % 3 + 1 for i, s in enumerate(names)}


def source_mix(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it."""
    taken, quotas = mix(docs, F.array("source"), by_rank)
    goal = docs.sparkSession.createDataFrame([([s], float(t)) for s, t in quotas.items()], "pattern array<string>, target double")
    sizes = materialize(taken.select("doc_id", "pattern", "size", "times"), "mix")
    total = sizes.groupBy("pattern").agg(F.sum("size").alias("source_size")).join(goal, "pattern")
    return sizes.join(F.broadcast(total), "pattern").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def take(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: every document as many times as it is taken, by its ``source``."""
    taken, _ = mix(docs, F.array("source"), by_rank, seed)
    times = materialize(taken.select("doc_id", "text_hash", "times", F.get("pattern", F.lit(0)).alias("s")).distinct(), "mix-times")
    h, n, again = (free_name(docs.columns, c) for c in ("_h", "_times", "_n"))
    # Ids and sources may be null, so they meet null-safe.
    times = times.select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), F.col("s").alias("t_source"), F.col("times").alias(n))
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (
        keyed["doc_id"].eqNullSafe(times["t_id"]) & (keyed[h] == times["t_hash"]) & keyed["source"].eqNullSafe(times["t_source"])
    )
    out = keyed.join(times, same).select(*[keyed[c] for c in docs.columns], times[n])
    return out.filter(F.col(n) > 0).withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*docs.columns)
