"""Line dedup by a log-template tree: fixed depth, variable fields generalised.

A line's leaf is its number of tokens and its first tokens, those with digits masked. Within
leaves that several documents reach, a token stands in the template if at its place it occurs
in enough documents, else it is a variable field. Lines whose template has enough fixed
tokens are instances; a template found in ``min_docs`` different documents recurs, and its
lines are dropped from every document.

Equal texts count as one document. A document most of whose tokens lie in recurring lines is
a copy as a whole: it is left to document-level dedup in so far as no vote comes from it, so
lines that recur only among such copies stay.

Only DataFrame functions are used. Null and empty texts stay as they are, and so does a text
of which every token would go: it is nothing but copies, of which document-level dedup keeps
one. Lines of fewer than ``min_tokens`` tokens always stay. Repeated rows are treated alike.
Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import free_name
from tallyhouse.session import materialize

MIN_DOCS, MIN_TOKENS, LEADING = 3, 4, 3
# Share of fixed tokens from which a line is an instance of its template.
SIMILARITY = 0.6
# Share of recurring tokens beyond which a document is a copy as a whole: texts that share s
# of their tokens have a similarity of s / (2 - s), which is 0.8 at 0.89.
COPY_SHARE = 0.89
# Bits of the bitmap of wanted lines at most: a million rows of 64.
MAX_BITS = 1 << 26


def plain_lines(text: Column) -> Column:
    """Lines of a text in lower case, with one kind of blank."""
    return F.split(F.lower(F.translate(F.coalesce(text, F.lit("")), "\t\r\f\u000b\u00a0", "     ")), "\n", -1)


def tokens(line: Column) -> Column:
    """Tokens between the blanks of a plain line."""
    return F.array_remove(F.split(line, " "), "")


def _leading(words: Column, n: int) -> Column:
    """First ``n`` tokens; those with a digit are variable at once."""
    return F.concat_ws(
        " ", *[F.when(F.get(words, F.lit(i)).rlike("[0-9]"), "<*>").otherwise(F.get(words, F.lit(i))) for i in range(n)]
    )


def line_key() -> list[Column]:
    """128 bits that stand for a plain line."""
    return [F.xxhash64("line").alias("la"), F.xxhash64(F.lit(7), "line").alias("lb")]


def lines(docs: DataFrame, leading: int = LEADING) -> DataFrame:
    """One row per line, without its words: key of the text (two hashes), place, number of tokens, leaf, key of the line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("ka"), F.xxhash64(F.lit(7), text).alias("kb"), F.posexplode(plain_lines(F.col("text"))).alias("i", "line")
    )
    rows = rows.withColumn("words", tokens(F.col("line"))).withColumn("n", F.size("words"))
    return rows.select("ka", "kb", "i", "n", F.xxhash64("n", _leading(F.col("words"), leading)).alias("leaf"), *line_key())


def _marked(said: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines that may be among ``wanted``, by a bitmap of their keys that all tasks have.

    It has eight bits a wanted line and no more than ``MAX_BITS``, 64 to a row; what it lets
    through wrongly goes in the join that follows, but other lines need no shuffle.
    """
    bits = min(MAX_BITS, max(1 << 16, 1 << (8 * wanted.count()).bit_length()))
    slot = F.pmod(F.col("la"), F.lit(bits))
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    marks = wanted.select(word.alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(la, {bits}L) & 63 AS INT))").alias("mark"))
    marks = marks.groupBy("word").agg(F.bit_or("mark").alias("marks"))
    tried = said.withColumns({"word": word, "bit": bit}).join(F.broadcast(marks), "word")
    return tried.filter(F.getbit("marks", F.col("bit")) == 1).select(*said.columns)


def recurring_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, leading: int = LEADING,
    similarity: float = SIMILARITY, copy_share: float = COPY_SHARE,
) -> DataFrame:
    """(ka, kb, drop): for each distinct text the places of its lines that recur."""
    # Every text is cut and hashed once; words are read again for the lines of shared leaves only.
    every = materialize(lines(docs.select("text"), leading), "lines")
    tree = every.filter(F.col("n") >= min_tokens)
    leaves = (
        tree.select("leaf", "ka", "kb").distinct().groupBy("leaf").count().filter(F.col("count") >= min_docs).select("leaf")
    )
    leaves = materialize(leaves, "leaves")
    # Lines of the leaves that documents share; one row per distinct text and place.
    shared = materialize(tree.join(leaves, "leaf", "left_semi").select("ka", "kb", "i", "n", "leaf", "la", "lb").distinct(), "shared-lines")
    counted = shared.select("leaf", "la", "lb", "ka", "kb").distinct().groupBy("leaf", "la", "lb").agg(F.count("*").alias("docs"))
    counted = materialize(counted, "shared-line-counts")
    said = docs.select(F.explode(plain_lines(F.col("text"))).alias("line")).select("line", *line_key())
    unique = (
        _marked(said, counted).join(counted, ["la", "lb"]).groupBy("leaf", "la", "lb", "docs").agg(F.first("line").alias("line"))
        .select("leaf", "la", "lb", "docs", tokens(F.col("line")).alias("words"))
    )
    unique = materialize(unique, "shared-line-words")
    words = unique.select("leaf", "la", "lb", "docs", F.posexplode("words").alias("place", "word"))
    fixed = (
        words.groupBy("leaf", "place", "word").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
        .select("leaf", "place", "word", F.lit(True).alias("fixed"))
    )
    named = (
        words.join(fixed, ["leaf", "place", "word"], "left")
        .groupBy("leaf", "la", "lb")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("word")).otherwise("<*>").alias("w")))).alias("t"),
            F.avg(F.when(F.col("fixed"), 1.0).otherwise(0.0)).alias("share"),
        )
        .filter(F.col("share") >= similarity)
        .select("leaf", "la", "lb", F.xxhash64(F.col("t.w")).alias("template"))
    )
    # Written first: a join of two plain reads is one whose hot keys Spark can split.
    named = materialize(named, "named-lines")
    found = materialize(
        shared.join(named, ["leaf", "la", "lb"])
        .select("ka", "kb", "i", "n", "leaf", "template"),
        "line-templates",
    )

    def recurrent(rows: DataFrame) -> DataFrame:
        docs_of = rows.select("leaf", "template", "ka", "kb").distinct()
        return docs_of.groupBy("leaf", "template").count().filter(F.col("count") >= min_docs).select("leaf", "template")

    first = materialize(recurrent(found), "recurring")
    inside = found.join(first, ["leaf", "template"], "left_semi").groupBy("ka", "kb").agg(F.sum("n").alias("inside"))
    # Rows of equal texts have equal lines, and each row has one first line.
    totals = every.groupBy("ka", "kb").agg((F.sum("n") / F.count_if(F.col("i") == 0)).alias("total"))
    totals = materialize(totals, "line-totals")
    copies = materialize(
        inside.join(totals, ["ka", "kb"]).filter(F.col("inside") > copy_share * F.col("total")).select("ka", "kb"), "whole-copies"
    )
    dropped = materialize(recurrent(found.join(copies, ["ka", "kb"], "left_anti")), "dropped-templates")
    drop = (
        found.join(dropped, ["leaf", "template"], "left_semi")
        .groupBy("ka", "kb").agg(F.array_sort(F.collect_set("i")).alias("drop"), F.sum("n").alias("gone"))
        .join(totals, ["ka", "kb"]).filter(F.col("gone") < F.col("total"))
    )
    return materialize(drop.select("ka", "kb", "drop"), "dropped-lines")


def drop_recurring_lines(
    docs: DataFrame, text_col: str = "text", dropped_col: str | None = None, **options
) -> DataFrame:
    """``docs`` without the lines that recur across documents.

    ``dropped_col`` names a column for the places of the dropped lines; ``options`` are those
    of ``recurring_lines``.
    """
    drops = recurring_lines(docs.select(F.col(text_col).alias("text")), **options)
    ka, kb, drop = (free_name(docs.columns, c) for c in ("ka", "kb", "drop"))
    names = [c for c in docs.columns if c != dropped_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({ka: F.xxhash64(text), kb: F.xxhash64(F.lit(7), text)})
    drops = drops.select(F.col("ka").alias(ka), F.col("kb").alias(kb), F.col("drop").alias(drop))
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains(F.col(drop), i)), "\n")
    clean = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    out = [clean if c == text_col else F.col(c) for c in names]
    if dropped_col:
        out.append(F.coalesce(F.col(drop), F.array().cast("array<int>")).alias(dropped_col))
    return rows.join(drops, [ka, kb], "left").select(*out)


# The same rules in SQL, over the whole table; texts and templates stand for themselves.
SQL = rf"""
WITH texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
every AS (
  SELECT t, i - 1 AS i, list_filter(string_split(lower(translate(l, chr(9) || chr(13) || chr(12) || chr(11) || chr(160), '     ')), ' '),
    lambda x: x <> '') AS w
  FROM (SELECT t, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM texts)),
tree AS (
  SELECT *, len(w) AS n, array_to_string(list_transform(w[1:{LEADING}], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS lead
  FROM every WHERE len(w) >= {MIN_TOKENS}),
leaves AS (SELECT n, lead FROM tree GROUP BY ALL HAVING count(DISTINCT t) >= {MIN_DOCS}),
shared AS (SELECT t, i, n, lead, w FROM tree JOIN leaves USING (n, lead)),
uniq AS (SELECT n, lead, w, count(DISTINCT t) AS docs FROM shared GROUP BY ALL),
words AS (SELECT n, lead, w, docs, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM uniq),
fixed AS (SELECT n, lead, place, word FROM words GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
named AS (
  SELECT n, lead, w, list(CASE WHEN f.word IS NULL THEN '<*>' ELSE words.word END ORDER BY place) AS template
  FROM words LEFT JOIN fixed f USING (n, lead, place, word) GROUP BY n, lead, w
  HAVING avg(CASE WHEN f.word IS NULL THEN 0.0 ELSE 1.0 END) >= {SIMILARITY}),
found AS (SELECT t, i, n, lead, template FROM shared JOIN named USING (n, lead, w)),
first AS (SELECT lead, n, template FROM found GROUP BY ALL HAVING count(DISTINCT t) >= {MIN_DOCS}),
copies AS (
  SELECT t FROM (SELECT t, sum(n) AS inside FROM found JOIN first USING (lead, n, template) GROUP BY t)
  JOIN (SELECT t, sum(len(w)) AS total FROM every GROUP BY t) USING (t) WHERE inside > {COPY_SHARE}::DOUBLE * total),
gone AS (SELECT lead, n, template FROM found ANTI JOIN copies USING (t) GROUP BY ALL HAVING count(DISTINCT t) >= {MIN_DOCS}),
drops AS (
  SELECT t, gone FROM (SELECT t, list(DISTINCT i) AS gone, sum(n) AS inside FROM found JOIN gone USING (lead, n, template) GROUP BY t)
  JOIN (SELECT t, sum(len(w)) AS total FROM every GROUP BY t) USING (t) WHERE inside < total)
SELECT doc_id, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_dropped,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(
    list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]), chr(10)), '') END AS text
FROM documents d LEFT JOIN drops ON coalesce(d.text, '') = drops.t
"""
