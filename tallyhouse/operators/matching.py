"""Substring joins between a large text column and a list of needles, in one exact way.

Texts and needles are read as runs: maximal stretches of word characters, and of other
characters. A run that lies inside a needle, with runs on both sides, is a whole run of every
text that holds the needle; so are two neighbouring inner words with what stands between them.
A needle is looked for where its rarest pair of inner words stands, one with a single inner
word where that word stands; document frequency decides which is rarest, and a needle with a
pair or word that no text has is out at once. A needle without inner words visits the texts
where they lie, in blocks of bounded size, and is looked for where the first characters of its
longest edge run stand; most texts hold many of those, so none of these pairs is shuffled.

The texts are cut into runs once, into a written index that several joins can share
(``index_texts``). Only postings that some needle asks for leave it, dealt by anchor and salt,
so that a word of every text does not meet in one task. Few needles visit the postings where
they lie; a single join of such needles writes no index, as the postings asked for are all that
is needed of it. Candidates are verified against the text. Texts are told apart by their content, and ids may be null or repeated. No pair of text
and needle is formed unless they share an anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import WORD_CHAR, let
from tallyhouse.session import materialize

# Characters of an edge run by which it meets the texts.
ANCHOR = 8
# Starts of needles that are looked for one by one; of more, a text's stretches are made.
FEW_STARTS = 64
# Words and pairs of needles that visit the postings at once.
FEW_GRAMS = 1_000_000
# Tasks that the postings of one anchor are dealt to.
SALTS = 16
# Rows, and characters in them, of the side of a join that visits the other at once.
BLOCK_ROWS, BLOCK_CHARS = 250_000, 16_000_000
NOT_WORD = "[^" + WORD_CHAR[1:]
RUNS = f"({WORD_CHAR}+|{NOT_WORD}+)"


def runs(c: Column) -> Column:
    """A text as its runs of word characters and of others, in turn."""
    return F.regexp_extract_all(c, F.lit(RUNS), F.lit(1))


def is_word(c: Column) -> Column:
    return c.rlike(f"^{WORD_CHAR}")


def character_runs(c: Column, length: int) -> Column:
    """Every stretch of ``length`` characters in a text, overlapping, in one linear pass."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def character_slices(c: Column, length: int) -> Column:
    """The same without a pattern over the text: slower, for texts that were cut before."""
    places = lambda a: F.sequence(F.lit(1), F.greatest(F.size(a) - length + 1, F.lit(1)))
    cut = lambda a: F.transform(places(a), lambda i: F.array_join(F.slice(a, i, length), ""))
    return F.when(F.length(c) >= length, let(F.split(c, ""), cut)).otherwise(F.array().cast("array<string>"))


def _pairs(col: str) -> Column:
    """Hashes of neighbouring words in an array of runs, with what stands between them.

    A needle's edge runs must not take part; they are cut off before.
    """
    # A start beyond the array gives no rows; words stand at every other place.
    first = F.when(is_word(F.get(F.col(col), F.lit(0))), F.lit(0)).otherwise(F.lit(1))
    last = F.size(col) - 3
    places = F.when(first <= last, F.sequence(first, F.greatest(first, last), F.lit(2))).otherwise(F.array().cast("array<int>"))
    run = lambda i: F.get(F.col(col), i)
    return F.array_distinct(F.transform(places, lambda i: F.xxhash64(run(i), run(i + 1), run(i + 2))))


def _content(c: Column) -> Column:
    """A key of a text's content."""
    return F.unhex(F.md5(c.cast("binary")))


def index_texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts as a written table: _id, _text, a key of the content, its distinct runs
    with their hashes, and its pairs of words.

    Every text is cut into runs here and nowhere else. Null texts are left out.
    """
    return materialize(_cut(_keyed(texts, id_col, text_col)), "text-index")


def _keyed(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _content(F.col(text_col)).alias("_key")
    )


def _cut(keyed: DataFrame) -> DataFrame:
    cut = keyed.withColumn("_all", runs(F.col("_text")))
    cut = cut.withColumn("_pairs", _pairs("_all")).withColumn("_runs", F.array_distinct("_all")).drop("_all")
    return cut.withColumn("_grams", F.transform("_runs", lambda r: F.xxhash64(r)))


def _dealt(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Postings of the anchors' grams, each gram's over ``SALTS`` tasks."""
    salted = anchors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted, ["_gram", "_salt"]).drop("_salt")


def visited(rows: DataFrame, small: DataFrame, on: str | Column) -> DataFrame:
    """``rows`` joined with a table that visits them where they lie, block after block of bounded
    size: ``rows`` are not shuffled and stay dealt as they are."""
    small = materialize(small, "visitors")
    chars = F.sum(F.length(F.concat_ws("", *[c for c, kind in small.dtypes if kind == "string"])))
    n, size = small.agg(F.count("*"), chars).first()
    blocks = max(1, math.ceil(n / BLOCK_ROWS), math.ceil((size or 0) / BLOCK_CHARS))
    if blocks == 1:
        return rows.join(F.broadcast(small), on)
    no = F.pmod(F.xxhash64(*small.columns), F.lit(blocks))
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(small.filter(no == i)), on) for i in range(blocks)])


def _loose_hits(rows: DataFrame, body: Column, cut: Callable[[Column, int], Column], loose: DataFrame) -> DataFrame:
    """(_id, _needle) of needles without inner words. A needle has one start and a text every
    start once, so that no pair comes twice."""
    ends = F.array(F.try_element_at("_runs", F.lit(1)), F.try_element_at("_runs", F.lit(-1)))
    sized = F.transform(ends, lambda r: F.struct(is_word(r).alias("w"), F.length(r).alias("n"), r.alias("run")))
    started = loose.select("_needle", F.substring(F.array_max(sized)["run"], 1, ANCHOR).alias("_start"))
    few = [r[0] for r in started.select("_start").distinct().limit(FEW_STARTS + 1).collect()]
    if len(few) <= FEW_STARTS:
        starts = F.filter(F.array(*map(F.lit, few)), lambda s: F.contains("_text", s))
    else:
        # At most ANCHOR lengths; only stretches of a length that some needle asks for are made.
        lengths = sorted(r[0] for r in started.select(F.length("_start")).distinct().collect())
        starts = F.array_distinct(F.concat(*[cut(body, n) for n in lengths]))
    met = visited(rows.select("_id", "_text", F.explode(starts).alias("_start")), started, "_start")
    return met.filter(F.contains("_text", "_needle")).select("_id", "_needle")


def contains_join(
    texts: DataFrame | None, id_col: str, text_col: str, needles: DataFrame, needle_col: str,
    index: DataFrame | None = None, tasks: int | None = None,
) -> DataFrame:
    """Pairs of a text's id and a needle's row where the needle occurs in the text.

    One row per row of ``texts`` and row of ``needles`` that match; ids may be null or repeated.
    Null and empty needles, and null texts, match nothing. ``index`` is the written index of
    the texts, where there is one already; without it, few needles take their postings straight
    from the texts, of which only the text is written. With ``tasks`` the texts are dealt to so many
    tasks by their id, and the pairs stay there: sums over pairs of one text need no shuffle.
    """
    usable = needles.filter(F.length(needle_col) > 0)
    parts = usable.select(F.col(needle_col).alias("_needle")).distinct().withColumn("_runs", runs(F.col("_needle")))
    parts = parts.withColumn("_inside", F.expr("slice(_runs, 2, greatest(size(_runs) - 2, 0))"))
    words = F.array_distinct(F.transform(F.filter("_inside", is_word), lambda w: F.xxhash64(w)))
    by_pair, by_word = F.size("_pairs") > 0, F.size("_words") > 0
    # Written are only the words of a needle without pairs, and the runs of one without either.
    parts = parts.withColumn("_pairs", _pairs("_inside")).withColumn("_words", words).select(
        "_needle", _content(F.col("_needle")).alias("_of"), "_pairs",
        F.when(by_pair, F.array().cast("array<bigint>")).otherwise(F.col("_words")).alias("_words"),
        F.when(~by_pair & ~by_word, F.col("_runs")).alias("_runs"),
    )
    parts = materialize(parts, "needles")
    # A needle has many grams, so its key stands beside them and not its text.
    wanted = parts.filter(by_pair | by_word).select(
        "_of", by_pair.alias("_paired"), F.explode(F.when(by_pair, F.col("_pairs")).otherwise(F.col("_words"))).alias("_gram")
    )
    paired, worded, every, n_grams = parts.agg(
        F.count_if(by_pair), F.count_if(~by_pair & by_word), F.count("*"), F.sum(F.size("_pairs") + F.size("_words"))
    ).first()
    few = (n_grams or 0) <= FEW_GRAMS
    if index is None:
        # Read twice, so they are not made again.
        index = _cut(materialize(_keyed(texts, id_col, text_col), "texts")) if few else index_texts(texts, id_col, text_col)
    asked = []
    if few and paired + worded:
        # Hashes of pairs and words that happen to be the same give a candidate more.
        grams = F.concat(*[F.col(c) for c, some in (("_pairs", paired), ("_grams", worded)) if some])
        postings = index.select("_key", F.explode(grams).alias("_gram"))
        asked = [postings.join(F.broadcast(wanted.select("_gram").distinct()), "_gram", "left_semi")]
    elif paired + worded:
        pairs = index.select("_key", F.explode("_pairs").alias("_gram"))
        single = index.select("_key", F.explode("_grams").alias("_gram"))
        asked = [
            _dealt(side, wanted.filter(F.col("_paired") == flag).select("_gram").distinct())
            for side, flag, some in ((pairs, True, paired), (single, False, worded))
            if some
        ]
    bodies = index.select("_key", "_id", "_text")
    dealt = lambda rows: rows if tasks is None else rows.repartition(tasks, "_id")
    hits = []
    if asked:
        posted = materialize(reduce(DataFrame.unionByName, asked).distinct(), "postings")
        counts = posted.groupBy("_gram").agg(F.count("*").alias("_texts"))
        rarest = wanted.join(counts, "_gram", "left").groupBy("_of").agg(
            F.min_by("_gram", F.struct("_texts", "_gram")).alias("_gram"), F.min(F.coalesce("_texts", F.lit(0))).alias("_least")
        )
        # Written, so that few needles that are left meet their texts where these lie.
        rarest = materialize(rarest.filter(F.col("_least") > 0).select("_of", "_gram"), "rarest")
        anchors = rarest.join(parts.select("_of", "_needle"), "_of").select("_needle", "_gram")
        met = visited(posted, anchors, "_gram") if few else _dealt(posted, anchors)
        candidates = met.select("_key", "_needle")
        # Written, so that their size is known: few of them visit the texts where these lie.
        both = bodies.join(materialize(candidates, "candidates"), "_key")
        found = both.filter(F.contains("_text", "_needle")).select("_id", "_needle")
        hits.append(dealt(found).join(usable.withColumn("_needle", F.col(needle_col)), "_needle"))
    if every > paired + worded:
        loose = parts.filter(~by_pair & ~by_word).select("_needle", "_runs")
        # Long texts repeat their runs; dealt ones are read once more, as only the text is moved.
        lie = (
            (index, F.array_join("_runs", ""), character_slices) if tasks is None
            else (dealt(index.select("_id", "_text")), F.col("_text"), character_runs)
        )
        wide = usable.withColumn("_needle", F.col(needle_col)).join(loose.select("_needle"), "_needle")
        hits.append(visited(_loose_hits(*lie, loose), wide, "_needle"))
    if not hits:
        return bodies.limit(0).select(F.col("_id").alias(id_col)).join(usable, F.lit(False))
    return reduce(DataFrame.unionByName, hits).withColumnRenamed("_id", id_col).drop("_needle")
