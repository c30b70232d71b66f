"""Retrieval over question tables: glossary, examples, tables, context, keywords."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.text import extract_terms, normalise_text, strip, token_estimate
from tallyhouse.operators.limits import top_k
from tallyhouse.operators.matching import contains_join, index_texts, visited
from tallyhouse.session import materialize

# Priority of each kind of glossary hit; a phrase adds its length.
PHRASE_PRIORITY = 100
VARIANT_PRIORITY = {"ar": 80, "en": 70, "synonym": 60, "canonical": 50}
TABLE_LABEL_PRIORITY = 90
# Points of the example and table scores.
EXAMPLE_INSIDE, EXAMPLE_AROUND, EXAMPLE_TERM = 10.0, 5.0, 2.0
EXAMPLE_SEMANTIC, EXAMPLE_SELECTED, EXAMPLE_NAMED = 8.0, 5.0, 3.0
AROUND_MIN_CHARS = 10
TABLE_GLOSSARY, TABLE_NAME, TABLE_LABEL = 8.0, 10.0, 6.0
TABLE_EXAMPLE, TABLE_SEARCH, TABLE_NEIGHBOUR = 4.0, 3.0, 2.0
EXAMPLE_COUNTS_FROM = 4.0
# Hints of a join in a question, and sections of a context by priority.
JOIN_HINTS = ("join", "between", "across", "لكل", "بين")
SECTION_PRIORITY = {
    "security": 1,
    "schema": 2,
    "relationships": 3,
    "business_rules": 4,
    "glossary": 5,
    "examples": 6,
    "sql_style": 7,
}
MIN_CUT_TOKENS = 50
# Postings of a question's rarest words, for each example wanted, that are read to find a score to
# reach; and how far sums of the same points may differ by their order.
SEED_POSTINGS, SCORE_SLACK = 16, 1e-6
# Share of the score to reach that the words left aside may give together; below 1, so that a pair
# that shares nothing else cannot reach it.
ASIDE = 0.3
# Stands before a table name among words; no word holds it.
NAME_MARK = "\x01"
# Pairs of question and example that one task adds up.
TASK_PAIRS = 2_000_000
# Default breadth.
MAX_GLOSSARY, MAX_EXAMPLES, MAX_TABLES, MAX_TOKENS = 6, 2, 5, 2_500


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _normalised(questions: DataFrame) -> DataFrame:
    """Question texts with spaces collapsed and in lower case; no text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return questions.select("question_id", normalise_text(text).alias("_norm"))


def question_index(questions: DataFrame) -> DataFrame:
    """The questions' normal form, cut into runs once, for every signal that looks words up in it."""
    return index_texts(_normalised(questions), "question_id", "_norm")


def _indexed(questions: DataFrame, index: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The index of the questions, and their normal form as it stands there."""
    index = question_index(questions) if index is None else index
    return index, index.select(F.col("_id").alias("question_id"), F.col("_text").alias("_norm"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pair_tasks(index: DataFrame, examples: DataFrame) -> int:
    """Tasks to which questions are dealt so that each can add up all pairs of its own."""
    return max(_tasks(index), math.ceil(index.count() * examples.count() / TASK_PAIRS))


def _deal(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt by question; joins with visitors and sums by question and more stay in place."""
    return rows.repartition(tasks, "question_id")


# -------------------------------------------------------------------- glossary


def glossary_variants(terms: DataFrame) -> DataFrame:
    """One row per searchable variant of a term, with its priority and search order.

    ``terms``: canonical, phrases, ar, en, synonyms, table_labels (arrays of text).
    """

    def variants(col: Column, step: int, label: str | None, priority: int) -> Column:
        """Rows of one list. Phrases (no label) go longest first and rank by length."""
        phrase = label is None
        spaced = phrase or label == "table_profile"

        def row(v: Column, i: Column) -> Column:
            text = v if spaced else F.trim(v)
            return F.struct(
                F.lower(text).alias("needle"),
                (text if phrase else F.concat(F.lit(f"{label}:"), text)).alias("matched_on"),
                (F.lit(priority) + (F.length(v) if phrase else 0)).alias("priority"),
                F.struct(
                    F.lit(step).alias("step"),
                    (-F.length(v) if phrase else F.lit(0)).alias("neg_len"),
                    i.alias("pos"),
                ).alias("search_order"),
            )

        return F.transform(F.coalesce(col, F.array().cast("array<string>")), row)

    lists = [
        variants(F.col("phrases"), 0, None, PHRASE_PRIORITY),
        variants(F.col("ar"), 1, "ar", VARIANT_PRIORITY["ar"]),
        variants(F.col("en"), 2, "en", VARIANT_PRIORITY["en"]),
        variants(F.col("synonyms"), 3, "synonym", VARIANT_PRIORITY["synonym"]),
        variants(F.array("canonical"), 4, "canonical", VARIANT_PRIORITY["canonical"]),
        variants(F.col("table_labels"), 5, "table_profile", TABLE_LABEL_PRIORITY),
    ]
    exploded = terms.select("canonical", F.explode(F.concat(*lists)).alias("v"))
    return exploded.select("canonical", "v.*").filter(F.length("needle") > 0)


def match_glossary(
    questions: DataFrame, variants: DataFrame, cap: int = MAX_GLOSSARY, index: DataFrame | None = None
) -> DataFrame:
    """Glossary terms found in each question: the first variant in search order decides.

    ``questions``: question_id, text. Best priority first, ties by canonical name.
    Without ``index`` none is written, but for a glossary of very many words (``contains_join``).
    """
    hits = contains_join(_normalised(questions), "question_id", "_norm", variants, "needle", index)
    first = hits.groupBy("question_id", "canonical").agg(
        F.min_by(F.struct("matched_on", "priority"), "search_order").alias("hit")
    )
    rows = first.select("question_id", "canonical", "hit.matched_on", "hit.priority")
    order = [F.col("priority").desc(), F.col("canonical").asc()]
    return top_k(rows, ["question_id"], order, cap)


# -------------------------------------------------------------------- examples


def _example_fields(examples: DataFrame) -> DataFrame:
    field = lambda c: examples.select(
        "example_id", F.lit(c).alias("field"), F.col(c).alias("field_text")
    ).filter(F.length(c) > 0)
    return field("question_en").unionByName(field("question_ar"))


def _example_signals(
    examples: DataFrame, semantic: DataFrame | None, selected: DataFrame | None, index: DataFrame, norm: DataFrame
) -> DataFrame:
    """(question_id, example_id, points) of every signal but shared words and names; a pair may stand several times."""
    fields = _example_fields(examples)
    needle = fields.withColumn("_needle_text", F.lower("field_text"))

    inside = contains_join(norm, "question_id", "_norm", needle, "_needle_text", index).select(
        "question_id", "example_id", "field", F.lit(EXAMPLE_INSIDE).alias("points")
    )
    field_key = F.concat_ws("\u0001", "example_id", "field")
    field_texts = needle.select(field_key.alias("_field_id"), "_needle_text")
    long_questions = norm.filter(F.length("_norm") >= AROUND_MIN_CHARS)
    around = contains_join(field_texts, "_field_id", "_needle_text", long_questions, "_norm")
    around = around.join(needle.select(field_key.alias("_field_id"), "example_id", "field"), "_field_id")
    around = around.select(
        "question_id", "example_id", "field", F.lit(EXAMPLE_AROUND).alias("points")
    )
    # A text inside the other way round as well counts once, with the higher points.
    contained = inside.unionByName(around).groupBy("question_id", "example_id", "field").agg(
        F.max("points").alias("points")
    ).drop("field")

    parts = [contained]
    if semantic is not None:
        parts.append(semantic.select(
            "question_id", "example_id", (F.col("semantic_score") * EXAMPLE_SEMANTIC).alias("points")
        ))
    if selected is not None:
        per_table = _required(examples).distinct().join(selected.distinct(), "table_name")
        parts.append(per_table.groupBy("question_id", "example_id").agg(
            (F.count("*") * EXAMPLE_SELECTED).alias("points")
        ))
    return _union(parts)


def _required(examples: DataFrame) -> DataFrame:
    return examples.select("example_id", F.explode("required_tables").alias("table_name"))


def _named_tables(
    names: DataFrame, norm: DataFrame, selected: DataFrame | None, index: DataFrame, tasks: int
) -> DataFrame:
    """Questions without selected tables with the rows of ``names`` whose _table_needle they hold, dealt by question."""
    named = contains_join(norm, "question_id", "_norm", names, "_table_needle", index, tasks)
    if selected is None:
        return named
    unselected = _deal(norm.select("question_id").join(selected.select("question_id").distinct(), "question_id", "left_anti"), tasks)
    return named.join(unselected, "question_id", "left_semi")


def _asked_terms(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode(extract_terms(F.col("text"))).alias("term"))


def _example_terms(examples: DataFrame) -> DataFrame:
    return _example_fields(examples).select("example_id", F.explode(extract_terms(F.col("field_text"))).alias("term"))


def score_examples(
    questions: DataFrame, examples: DataFrame,
    semantic: DataFrame | None = None, selected: DataFrame | None = None, index: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Score of every example that has something in common with a question.

    ``questions``: question_id, text. ``examples``: example_id, question_en,
    question_ar, required_tables. ``semantic``: question_id, example_id,
    semantic_score. ``selected``: question_id, table_name.

    Nearly all pairs share a word, so pairs are never shuffled: the questions are dealt to
    ``tasks`` tasks, the examples' words and table names visit them, and a task adds up the
    pairs of its questions. Where only the best are wanted, ``best_examples`` forms far fewer.
    """
    index, norm = _indexed(questions, index)
    tasks = pair_tasks(index, examples) if tasks is None else tasks
    held = _example_terms(examples).groupBy("example_id", "term").agg((F.count("*") * EXAMPLE_TERM).alias("points"))
    names = _required(examples).select("example_id", F.lower("table_name").alias("_table_needle"))
    named = _named_tables(names, norm, selected, index, tasks)
    parts = [
        _deal(_example_signals(examples, semantic, selected, index, norm), tasks),
        visited(_asked_terms(_deal(questions.select("question_id", "text"), tasks)), held, "term").select("question_id", "example_id", "points"),
        named.select("question_id", "example_id", F.lit(EXAMPLE_NAMED).alias("points")),
    ]
    return _pair_sums(parts, "score")


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys are the left ones."""
    right = right.select(*[F.col(c).alias(f"_other_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_other_{k}" for k in keys])


def _pair_sums(parts: Sequence[DataFrame], out: str = "points") -> DataFrame:
    return _union(parts).groupBy("question_id", "example_id").agg(F.sum("points").alias(out))


def ranked_terms(
    questions: DataFrame, e_terms: DataFrame, named: DataFrame | None = None, tasks: int | None = None
) -> DataFrame:
    """A question's words that some example has, rarest first, with what they can be worth.

    ``_upto``: postings of a word and all rarer ones; ``_from``: the most points that it and all
    more common ones can give one example together. ``named``: (question_id, term) of table names
    that the questions hold, which count as words, dealt to ``tasks`` tasks as the questions are.
    """
    tasks = _tasks(questions) if tasks is None else tasks
    known = e_terms.groupBy("term").agg(F.count("*").alias("_df"), F.max("_held").alias("_most"))
    asked = _asked_terms(_deal(questions.select("question_id", "text"), tasks))
    asked = asked if named is None else asked.unionByName(named)
    asked = visited(asked.groupBy("question_id", "term").agg(F.count("*").alias("_asked")), known, "term")
    each = Window.partitionBy("question_id")
    rising = each.orderBy("_df", "term").rowsBetween(Window.unboundedPreceding, 0)
    worth = F.col("_asked") * F.col("_most") * EXAMPLE_TERM
    asked = asked.withColumn("_worth", worth).withColumn("_upto", F.sum("_df").over(rising))
    asked = asked.withColumn("_from", F.sum("_worth").over(each) - F.sum("_worth").over(rising) + F.col("_worth"))
    return asked.select("question_id", "term", "_asked", "_df", "_upto", "_from")


def example_candidates(
    asked: DataFrame, e_terms: DataFrame, signals: DataFrame, n: int, tasks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pairs that can be among the best ``n`` of a question, with their points so far, and the
    question's words still to be counted for them.

    A few pairs of each question, those of its rarest words and of the other signals, are scored
    in full; the n-th best of them is a score that the result must reach. The most common words
    that together give at most a share ``ASIDE`` of it are left aside: pairs that share nothing else are never
    formed, and of the others those stay that could reach the score with all words left aside.
    Nothing is left aside for a question without an id. The pairs of a question are formed and
    added up in one of ``tasks`` tasks and are not written: they follow from the words once more
    wherever they are read.
    """
    tasks = _tasks(asked) if tasks is None else tasks
    signals = _deal(signals, tasks)
    counted = (F.col("_asked") * F.col("_held") * EXAMPLE_TERM).alias("points")
    hits = lambda rows: visited(_deal(rows.select("question_id", "term", "_asked"), tasks), e_terms, "term").select(
        "question_id", "example_id", counted
    )
    first = asked.filter((F.col("_upto") <= SEED_POSTINGS * n) | (F.col("_upto") == F.col("_df")))
    order = [F.col("points").desc(), F.col("example_id").asc()]
    seeds = top_k(_pair_sums([signals, hits(first)]), ["question_id"], order, 2 * n).select("question_id", "example_id")
    seeds = materialize(seeds, "example-seeds")
    known = _meet(signals, seeds, ["question_id", "example_id"], "left_semi")
    scored = _pair_sums([known, remaining_points(seeds, asked, e_terms, tasks)])
    best = top_k(scored, ["question_id"], order, n).groupBy("question_id").agg(
        F.min("points").alias("_least"), F.count("*").alias("_n")
    )
    # Fewer than n examples, or none above zero, set no bar.
    bar = best.filter((F.col("_n") == n) & (F.col("_least") > 0)).select("question_id", "_least")
    asked = _meet(asked, bar, ["question_id"], "left")
    aside = F.coalesce((F.col("_from") <= F.col("_least") * ASIDE) & F.col("question_id").isNotNull(), F.lit(False))
    asked = materialize(asked.withColumn("_aside", aside), "example-words")
    limits = asked.filter("_aside").groupBy("question_id").agg(F.max("_from").alias("_more"), F.max("_least").alias("_least"))
    pairs = _pair_sums([signals, hits(asked.filter("NOT _aside"))]).join(_deal(limits, tasks), "question_id", "left")
    reach = F.col("points") + F.col("_more") >= F.col("_least") - SCORE_SLACK
    pairs = pairs.filter(F.coalesce(reach, F.lit(True))).select("question_id", "example_id", "points")
    return pairs, asked.filter("_aside")


def remaining_points(pairs: DataFrame, asked: DataFrame, e_terms: DataFrame, tasks: int) -> DataFrame:
    """(question_id, example_id, points) of the words ``asked`` that the example of a pair has.

    Pairs without a question id get none. Pairs dealt by question stay where they are.
    """
    asked = _deal(asked.select("question_id", "term", "_asked"), tasks)
    listed = asked.groupBy("question_id").agg(F.collect_list(F.struct("term", "_asked")).alias("_words"))
    # A left join keeps the pairs' own dealing, and only that.
    words = pairs.select("question_id", "example_id").join(listed, "question_id", "left")
    words = words.select("question_id", "example_id", F.inline("_words"))
    held = e_terms.select(F.col("example_id").alias("_example"), F.col("term").alias("_term"), "_held")
    both = visited(words, held, F.col("example_id").eqNullSafe(F.col("_example")) & (F.col("term") == F.col("_term")))
    return both.select("question_id", "example_id", (F.col("_asked") * F.col("_held") * EXAMPLE_TERM).alias("points"))


def best_examples(
    questions: DataFrame, examples: DataFrame, n: int = MAX_EXAMPLES,
    semantic: DataFrame | None = None, selected: DataFrame | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """Best ``n`` examples with a positive score per question, ties by id: the rows that
    ``retrieve_examples`` takes of ``score_examples``, without scoring what cannot be among them.

    Ids may be null; rows of one question id count as one question, as they do there.
    """
    index, norm = _indexed(questions, index)
    tasks = pair_tasks(index, examples)
    # A table name counts as a word that is worth as much; no word begins with NAME_MARK.
    name = F.concat(F.lit(NAME_MARK), F.lower("table_name"))
    worth = F.count("*") * F.when(F.col("term").startswith(NAME_MARK), EXAMPLE_NAMED / EXAMPLE_TERM).otherwise(1.0)
    terms = _example_terms(examples).unionByName(_required(examples).select("example_id", name.alias("term")))
    e_terms = materialize(terms.groupBy("example_id", "term").agg(worth.alias("_held")), "example-terms")
    names = _required(examples).select(F.lower("table_name").alias("_table_needle"), name.alias("term")).distinct()
    named = _named_tables(names, norm, selected, index, tasks).select("question_id", "term")
    asked = materialize(ranked_terms(questions, e_terms, named, tasks), "question-terms")
    signals = materialize(_pair_sums([_example_signals(examples, semantic, selected, index, norm)]), "example-signals")
    pairs, aside = example_candidates(asked, e_terms, signals, n, tasks)
    return retrieve_examples(_pair_sums([pairs, remaining_points(pairs, aside, e_terms, tasks)], "score"), n)


def retrieve_examples(scored: DataFrame, n: int = MAX_EXAMPLES) -> DataFrame:
    """Best ``n`` examples with a positive score per question, ties by id."""
    order = [F.col("score").desc(), F.col("example_id").asc()]
    return top_k(scored.filter(F.col("score") > 0), ["question_id"], order, n)


# ---------------------------------------------------------------------- tables


def table_name_hits(norm: DataFrame, tables: DataFrame, index: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Questions that name a table as a token of its own.

    A name of letters and digits is a token, so it meets the tokens of the questions by
    an equi-join; any other name is looked for in the text and its neighbours checked.
    With ``tasks`` the rows are dealt to so many tasks by question.
    """
    norm = norm if tasks is None else _deal(norm, tasks)
    named = tables.withColumn("_name", F.lower("table_name"))
    plain = F.col("_name").rlike(r"^[\p{L}\p{N}]+$")
    tokens = F.array_distinct(F.regexp_extract_all("_norm", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    words = norm.select("question_id", F.explode(tokens).alias("_name"))
    by_word = visited(words, named.filter(plain), "_name").select("question_id", "table_name")
    hits = contains_join(norm, "question_id", "_norm", named.filter(~plain), "_name", index, tasks)
    texts = hits.select("question_id", "table_name", "_name").join(norm, "question_id")
    alone = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col("_name"), F.lit(r"\E(?![\p{L}\p{N}])"))
    by_text = texts.filter(F.regexp_like("_norm", alone)).select("question_id", "table_name")
    return by_word.unionByName(by_text)


def score_tables(
    questions: DataFrame, tables: DataFrame,
    glossary_hits: DataFrame | None = None, glossary_tables: DataFrame | None = None,
    example_scores: DataFrame | None = None, example_tables: DataFrame | None = None,
    search_hits: DataFrame | None = None, relationships: DataFrame | None = None,
    max_tables: int = MAX_TABLES, index: DataFrame | None = None, tasks: int | None = None,
) -> DataFrame:
    """Best tables per question from the points of every signal, ties by name.

    ``tables``: table_name, labels (array). ``glossary_tables``: canonical, table_name.
    ``example_tables``: example_id, table_name. ``search_hits``: question_id,
    table_name. ``relationships``: from_table, to_table, used only for questions that
    hint at a join, and only from tables that already score. ``tasks`` are those to which
    ``example_scores`` is dealt by question, so that nothing of it is shuffled.
    """
    index, norm = _indexed(questions, index)
    tasks = pair_tasks(index, tables) if tasks is None else tasks

    def signal(df: DataFrame, points: float) -> DataFrame:
        return df.select("question_id", "table_name", F.lit(points).alias("points"))

    signals = [signal(table_name_hits(norm, tables.select("table_name"), index, tasks), TABLE_NAME)]
    labels = tables.select("table_name", F.explode("labels").alias("label"))
    labels = labels.withColumn("_label_needle", F.lower("label"))
    label_hits = contains_join(norm, "question_id", "_norm", labels, "_label_needle", index, tasks)
    signals.append(signal(label_hits, TABLE_LABEL))
    if glossary_hits is not None and glossary_tables is not None:
        signals.append(signal(_deal(glossary_hits.join(glossary_tables, "canonical"), tasks), TABLE_GLOSSARY))
    if example_scores is not None and example_tables is not None:
        good = example_scores.filter(F.col("score") >= EXAMPLE_COUNTS_FROM)
        signals.append(signal(visited(good, example_tables, "example_id"), TABLE_EXAMPLE))
    if search_hits is not None:
        signals.append(signal(_deal(search_hits, tasks), TABLE_SEARCH))
    known = tables.select("table_name").distinct()
    scored = _union(signals).groupBy("question_id", "table_name").agg(F.sum("points").alias("points"))
    if relationships is None:
        scored = visited(scored, known, "table_name")
    else:
        # A known table with what it gives to each of its known neighbours.
        both = relationships.select(F.col("from_table").alias("table_name"), F.col("to_table").alias("_next")).unionByName(
            relationships.select(F.col("to_table").alias("table_name"), F.col("from_table").alias("_next"))
        )
        both = both.join(known.select(F.col("table_name").alias("_next")), "_next", "left_semi")
        both = both.groupBy("table_name", "_next").agg((F.count("*") * TABLE_NEIGHBOUR).alias("points"))
        near = both.groupBy("table_name").agg(F.collect_list(F.struct(F.col("_next").alias("table_name"), "points")).alias("_near"))
        scored = visited(scored, known.join(near, "table_name", "left"), "table_name")
        hinting = norm.filter(F.col("_norm").rlike("|".join(JOIN_HINTS))).select("question_id").distinct()
        scored = scored.join(_deal(hinting, tasks).withColumn("_hint", F.lit(True)), "question_id", "left")
        own = F.array(F.struct("table_name", "points"))
        given = F.when(F.col("_hint") & F.col("_near").isNotNull(), F.concat(own, "_near")).otherwise(own)
        scored = scored.select("question_id", F.explode(given).alias("t")).select("question_id", "t.*")
        scored = scored.groupBy("question_id", "table_name").agg(F.sum("points").alias("points"))
    ranked = scored.select("question_id", "table_name", F.col("points").alias("score"))
    order = [F.col("score").desc(), F.col("table_name").asc()]
    return top_k(ranked, ["question_id"], order, max_tables)


# --------------------------------------------------------------------- context


def _prune_sections(sections: DataFrame, budget: int) -> DataFrame:
    """Leave out sections that can never add to a question's context.

    The room left only shrinks. So of all sections of one size at most
    ``budget / size`` fit whole, and they are the first of that size; of all sections
    whose first paragraph with text has one size at most ``budget / size`` can give a cut part,
    and they too are the first. What remains per question is bounded by the budget,
    however many sections it has.
    """
    order = [F.col("priority"), F.col("name"), F.col("_tie")]
    kept = (
        sections.withColumn("_salt", F.pmod(F.xxhash64("name", "content"), F.lit(64)))
        .withColumn("_whole", F.lit(True))
        .withColumn("_part", F.lit(True))
    )
    # First within a salt, so that no task sorts a whole group, then for good.
    for salt in (["_salt"], []):
        for size, flag in (("_tokens", "_whole"), ("_lead", "_part")):
            limit = F.when(F.col(size) > 0, F.floor(F.lit(budget) / F.col(size)))
            rank = F.row_number().over(
                Window.partitionBy("question_id", flag, size, *salt).orderBy(*order)
            )
            fits = F.coalesce((F.col(size) == 0) | (rank <= limit), F.lit(False))
            kept = kept.withColumn(flag, F.col(flag) & fits)
        kept = kept.filter(F.col("_whole") | F.col("_part"))
    return kept


def pack_context(sections: DataFrame, budget: int = MAX_TOKENS) -> DataFrame:
    """Fill each question's context by section priority under a token budget.

    ``sections``: question_id, name, content and priority; without that column sections
    go by ``SECTION_PRIORITY``, other names last. A section that does not fit is
    cut at paragraph breaks while at least 50 tokens remain, else skipped; a later,
    smaller one may still fit. Gives context_text, included (names), used_tokens and
    truncated.
    """
    if "priority" not in sections.columns:
        known = F.create_map(*[F.lit(x) for pair in SECTION_PRIORITY.items() for x in pair])
        sections = sections.withColumn("priority", F.coalesce(F.try_element_at(known, F.col("name")), F.lit(len(SECTION_PRIORITY) + 1)))
    paragraphs = F.split(F.col("content"), "\n\n")
    # A cut part needs a paragraph with text, so the first such one decides what can fit.
    texts = F.filter(paragraphs, lambda p: F.length(F.trim(p)) > 0)
    sized = sections.select(
        "question_id", "name", "priority", "content",
        token_estimate(F.col("content")).alias("_tokens"),
        F.when(F.size(texts) > 0, token_estimate(F.get(texts, F.lit(0)))).alias("_lead"),
        F.xxhash64("name", "content").alias("_tie"),
    )
    totals = sized.groupBy("question_id").agg(F.sum("_tokens").alias("_total"))
    kept = _prune_sections(sized, budget).groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("priority", "name", "_tie", "content", "_tokens"))).alias("s")
    )

    def cut(content: Column, room: Column) -> Column:
        """Leading paragraphs of a text that fit into the room."""
        start = F.struct(
            F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"),
            F.lit(True).alias("open"),
        )

        def step(acc, para):
            size = token_estimate(para)
            fits = acc["open"] & (acc["used"] + size <= room)
            return F.struct(
                F.when(fits, F.concat(acc["parts"], F.array(para))).otherwise(acc["parts"]).alias("parts"),
                F.when(fits, acc["used"] + size).otherwise(acc["used"]).alias("used"),
                fits.alias("open"),
            )

        return F.array_join(F.aggregate(F.split(content, "\n\n"), start, step)["parts"], "\n\n")

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("parts"), empty.alias("names"), F.lit(0).alias("used"))

    def step(acc, s):
        room = F.lit(budget) - acc["used"]
        part = F.when(s["_tokens"] <= room, s["content"]).when(
            room >= MIN_CUT_TOKENS, cut(s["content"], room)
        )
        add = part.isNotNull() & ((s["_tokens"] <= room) | (F.length(F.trim(part)) > 0))
        return F.struct(
            F.when(add, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"),
            F.when(add, F.concat(acc["names"], F.array(s["name"]))).otherwise(acc["names"]).alias("names"),
            F.when(add, acc["used"] + token_estimate(part)).otherwise(acc["used"]).alias("used"),
        )

    packed = kept.withColumn("p", F.aggregate("s", start, step)).join(totals, "question_id")
    # Everything fits if and only if the sizes add up to no more than the budget.
    return packed.select(
        "question_id",
        F.array_join("p.parts", "\n\n").alias("context_text"),
        F.col("p.names").alias("included"),
        F.col("p.used").alias("used_tokens"),
        (F.col("_total") > budget).alias("truncated"),
    )


# -------------------------------------------------------------------- keywords


def search_source(df: DataFrame, source: str, rank: int, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One source of a keyword search: its rank, ids and searched text."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))
    return df.select(
        F.lit(source).alias("source"), F.lit(rank).alias("source_rank"),
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("_order"), text.alias("_hay"),
    )


def keyword_search(
    sources: Sequence[DataFrame], needle: str, limit: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Case-insensitive substring search over sources in a fixed order.

    Gives the first ``limit`` hits and a status row with total_hits and truncated.
    """
    hits = _union(sources).filter(F.contains("_hay", F.lit(needle.lower())))
    total = F.count("*")
    status = hits.agg(total.alias("total_hits"), (total > limit).alias("truncated"))
    first = hits.orderBy("source_rank", "_order").limit(limit)
    return first.select("source", "id"), status


# ------------------------------------------------------------------ learned pairs


def learned_pairs(activity: DataFrame, profile_id: str) -> DataFrame:
    """Question and SQL pairs worth keeping, one document per distinct pair."""
    good = (
        (F.col("status") == "success")
        & (F.col("row_count") > 0)
        & (F.length(strip(F.col("question"))) >= 3)
    )
    key = F.concat_ws(":", F.lit(profile_id), "question", "executed_sql")
    rows = activity.filter(good).select(
        F.concat(F.lit("auto:"), F.substring(F.md5(key), 1, 16)).alias("id"),
        F.concat(F.lit("Question: "), "question", F.lit("\nSQL: "), "executed_sql").alias("document"),
        F.lit("auto_learned").alias("kind"),
        "row_count",
    )
    # Pairs repeat; the largest row count is kept so that the result does not vary.
    return rows.groupBy("id", "document", "kind").agg(F.max("row_count").alias("row_count"))
