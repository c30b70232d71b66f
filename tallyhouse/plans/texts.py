"""Text and question-log jobs over documents and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import text as X
from tallyhouse.operators import documents as D
from tallyhouse.operators import retrieval as RT
from tallyhouse.operators import screening as S
from tallyhouse.operators.matching import contains_join
from tallyhouse.plans.registry import query
from tallyhouse.session import work_folder
from tallyhouse.sources.collections import (
    create_collection, export_csv, read_collection, upsert_collection, upsert_documents, write_collection, written_count,
)

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
# SQL has no Unicode word boundary, so boundaries are written out as neighbours.
INJECTION_SQL = (
    rf"(?is)((^|{NW})(ignore\s+(all\s+)?(previous|prior)\s+instructions?|disregard\s+(all\s+)?(previous|prior)\s+instructions?"
    rf"|you\s+are\s+now|forget\s+(everything|all|your)|override\s+(the\s+)?(system|safety)|jailbreak|do\s+anything\s+now"
    rf"|data\s*:\s*text/html)({NW}|$)|(^|{NW})(system\s*:\s*|assistant\s*:\s*|new\s+instructions?\s*:|javascript\s*:){W}"
    rf"|{W}<\s*script({NW}|$))"
)
ENGLISH_SQL = (
    rf"(?i)(^|{NW})(count|how\s+many|list|lists|show|sales|order|orders|customer|customers|top|bottom|best|worst|lowest"
    rf"|highest|total|sum|average|avg|revenue|quantity|amount)({NW}|$)"
)
WORDS_SQL = r"regexp_extract_all({c}, '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+')"
NORM_SQL = r"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


def terms_sql(c: str) -> str:
    return f"list_distinct([lower(w) for w in {WORDS_SQL.format(c=c)} if length(w) >= 2])"


def transcript(t) -> DataFrame:
    """One line per turn, speaker first."""
    line = F.concat("role", F.lit(": "), "text")
    return t.spread("conversations").select("conv_id", "turn", line.alias("line"))


@query("normalise_text", f"SELECT doc_id, {NORM_SQL.format(c='text')} AS norm FROM documents")
def normalise_text(t):
    return t.spread("documents").select("doc_id", X.normalise_text(F.col("text")).alias("norm"))


@query(
    "extract_terms",
    f"SELECT doc_id, len(x) AS n_terms, array_to_string(list_sort(x), ' ') AS terms FROM (SELECT doc_id, {terms_sql('text')} AS x FROM documents) d",
)
def extract_terms(t):
    rows = t.spread("documents").select("doc_id", X.extract_terms(F.col("text")).alias("x"))
    joined = F.array_join(F.array_sort("x"), " ")
    return rows.select("doc_id", F.size("x").cast("long").alias("n_terms"), joined.alias("terms"))


@query(
    "fingerprint",
    "SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint, sha256(text) AS full_hash FROM documents",
)
def fingerprint(t):
    c = F.col("text")
    return t.spread("documents").select("doc_id", X.fingerprint(c).alias("fingerprint"), F.sha2(c, 256).alias("full_hash"))


@query(
    "slug",
    r"SELECT page_id, CASE WHEN s = '' THEN 'chunk' ELSE s END AS slug FROM (SELECT page_id, substr(regexp_replace("
    r"regexp_replace(lower(trim(url)), '\s+', '_', 'g'), '[^\p{L}\p{N}_\-]', '', 'g'), 1, 60) AS s FROM pages) x",
)
def slug(t):
    return t.spread("pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query(
    "token_estimate",
    "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE GREATEST(1, CAST(floor(length(text) * 0.5) AS INTEGER)) END AS tokens FROM documents",
)
def token_estimate(t):
    return t.spread("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(
    "array_overlap",
    f"SELECT c.conv_id, c.turn, len(list_intersect({terms_sql('c.text')}, {terms_sql('p.text')})) AS shared FROM conversations c "
    "JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1",
)
def array_overlap(t):
    c = t.spread("conversations").select("conv_id", "turn", X.extract_terms(F.col("text")).alias("a"))
    p = t.spread("conversations").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), X.extract_terms(F.col("text")).alias("b")
    )
    joined = c.join(p, ["conv_id", "turn"])
    return joined.select("conv_id", "turn", X.overlap(F.col("a"), F.col("b")).cast("long").alias("shared"))


@query(
    "flag_injection",
    f"SELECT conv_id, turn, CASE WHEN trim(line) = '' THEN 'empty_question' WHEN regexp_matches(line, '{INJECTION_SQL}') "
    "THEN 'suspected_prompt_injection' END AS reason FROM (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations) x",
)
def flag_injection(t):
    return S.flag_injection(transcript(t), "line").select("conv_id", "turn", "reason")


@query(
    "ingress_filter",
    r"SELECT doc_id, CASE WHEN s = '' THEN 'EMPTY_MESSAGE' WHEN length(s) > 20000 THEN 'MESSAGE_TOO_LARGE' "
    f"WHEN regexp_matches(s, '{INJECTION_SQL}') THEN 'PROMPT_INJECTION' WHEN length(text) > 2000 THEN "
    r"'METADATA_TOO_LARGE_OR_DEEP' END AS code FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents) x",
)
def ingress_filter(t):
    meta = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("body"), "text")
    rows = t.spread("documents").select("doc_id", "text", meta.alias("meta"))
    return S.ingress_filter(rows, "text", "meta").select("doc_id", "code")


# A SQL log made from the events: what the statement does follows the event's type.
SQL_LOG = (
    "CASE event_type WHEN 'view' THEN 'SELECT value FROM events WHERE event_id = ' || event_id "
    "WHEN 'click' THEN '-- note' || chr(10) || 'drop table t' || user_id "
    "WHEN 'signup' THEN 'SELECT name FROM sys.objects WHERE id = ' || user_id || ' FOR XML' "
    "WHEN 'error' THEN 'SELECT 1 WHERE x = ' || user_id || ' OR 1=1; EXEC xp_cmdshell' "
    "ELSE CASE WHEN value > 10 THEN 'SELECT a FROM t PIVOT (x)' ELSE '  ' END END"
)


def sql_log(t) -> DataFrame:
    """The log, one statement per event."""
    return t.spread("events").withColumn("sql", F.expr(SQL_LOG.replace("chr(10)", "char(10)")))


@query(
    "screen_sql_log",
    "SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'POL001' WHEN 'signup' THEN 'POL004,POL014' "
    "WHEN 'error' THEN 'POL010,POL005' ELSE CASE WHEN value > 10 THEN 'POL014' ELSE 'POL009' END END AS codes FROM events",
)
def screen_sql_log(t):
    return S.screen_sql_log(sql_log(t), "sql").select("event_id", F.array_join("codes", ",").alias("codes"))


@query(
    "route_intent",
    f"SELECT doc_id, CASE WHEN regexp_matches(text, '{ENGLISH_SQL}') OR regexp_matches(text, '{'|'.join(S.ARABIC_DATA_WORDS)}') "
    "THEN 'data' ELSE 'other' END AS path FROM documents",
)
def route_intent(t):
    return S.route_intent(t.spread("documents"), "text").select("doc_id", "path")


@query(
    "needs_context",
    f"SELECT conv_id, turn, regexp_matches(lower(text), '{'|'.join(S.CONTEXT_HINTS)}') AS needs_context FROM conversations",
)
def needs_context(t):
    return S.needs_context(t.spread("conversations"), "text").select("conv_id", "turn", "needs_context")


@query(
    "clean_answer",
    r"SELECT doc_id, regexp_replace(array_to_string([l for l in string_split(split_part(split_part(text, 'Test 1', 1), 'query_results_', 1), chr(10)) "
    r"if NOT regexp_matches(lower(l), 'results saved to file|for visualize_data|query_results_|test 1|test 2|test 3|\.csv')], chr(10)), "
    r"'^\s+|\s+$', '', 'g') AS answer FROM documents",
)
def clean_answer(t):
    return t.spread("documents").select("doc_id", S.clean_answer(F.col("text")).alias("answer"))


@query(
    "has_both_languages",
    r"SELECT c.conv_id, c.turn, length(c.text) > 0 AND length(coalesce(p.text, '')) > 0 AS bilingual, "
    r"regexp_matches(c.text, '[\x{0600}-\x{06FF}]') AS is_arabic FROM conversations c LEFT JOIN conversations p "
    "ON p.conv_id = c.conv_id AND p.turn = c.turn + 1",
)
def has_both_languages(t):
    c = t.spread("conversations").select("conv_id", "turn", "text")
    p = t.spread("conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = S.has_both_languages(c.join(p, ["conv_id", "turn"], "left"), "text", "answer")
    return S.detect_arabic(rows, "text").select("conv_id", "turn", "bilingual", "is_arabic")


# --------------------------------------------------------------------- retrieval


def sentence_terms(t) -> DataFrame:
    """A glossary out of the benchmark passages: whole passage, sentences, first sentence."""
    sentences = F.filter(F.split("text", r"\. "), lambda s: F.length(s) >= 12)
    empty = F.array().cast("array<string>")
    return t["benchmark"].select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("canonical"),
        F.array(X.normalise_text(F.col("text"))).alias("phrases"),
        empty.alias("ar"), sentences.alias("en"), empty.alias("synonyms"), empty.alias("table_labels"),
    )


def doc_questions(t) -> DataFrame:
    return t.spread("documents").select(F.col("doc_id").alias("question_id"), "text")


GLOSSARY_SQL = f"""
WITH q AS (SELECT doc_id AS question_id, {NORM_SQL.format(c='text')} AS norm FROM documents),
v AS (
  SELECT 'item-' || item_id AS canonical, {NORM_SQL.format(c='text')} AS needle, {NORM_SQL.format(c='text')} AS matched_on,
    100 + length({NORM_SQL.format(c='text')}) AS priority, 0 AS step, 0 AS pos FROM benchmark
  UNION ALL
  SELECT canonical, lower(trim(s)), 'en:' || trim(s), 70, 2, pos FROM (
    SELECT 'item-' || item_id AS canonical, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM (
      SELECT item_id, [s for s in string_split(text, '. ') if length(s) >= 12] AS ss FROM benchmark) a) b
  UNION ALL SELECT 'item-' || item_id, 'item-' || item_id, 'canonical:item-' || item_id, 50, 4, 0 FROM benchmark),
hits AS (SELECT question_id, v.*, ROW_NUMBER() OVER (PARTITION BY question_id, canonical ORDER BY step, pos) AS rn
  FROM q JOIN v ON contains(q.norm, v.needle)),
ranked AS (SELECT question_id, canonical, matched_on, priority,
  ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY priority DESC, canonical) AS rank FROM hits WHERE rn = 1)
SELECT question_id, canonical, matched_on, CAST(priority AS INTEGER) AS priority, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 6
"""


@query("match_glossary", GLOSSARY_SQL)
def match_glossary(t):
    return RT.match_glossary(doc_questions(t), RT.glossary_variants(sentence_terms(t)))


@query(
    "term_join",
    f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains({NORM_SQL.format(c='d.text')}, {NORM_SQL.format(c='b.text')})",
)
def term_join(t):
    docs = t.spread("documents").select("doc_id", X.normalise_text(F.col("text")).alias("norm"))
    items = t["benchmark"].select("item_id", X.normalise_text(F.col("text")).alias("needle"))
    return contains_join(docs, "doc_id", "norm", items, "needle").select("doc_id", "item_id")


def chat_questions(t) -> DataFrame:
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return t.spread("conversations").select(key.alias("question_id"), "text")


def passage_examples(t) -> DataFrame:
    """Benchmark passages as worked examples; the first two words stand for tables."""
    return t["benchmark"].select(
        F.concat(F.lit("ex-"), F.col("item_id").cast("string")).alias("example_id"),
        F.col("text").alias("question_en"), F.lit(None).cast("string").alias("question_ar"),
        F.slice(F.split("text", " "), 1, 2).alias("required_tables"),
    )


SCORES_SQL = f"""
WITH q AS (SELECT conv_id || '-' || turn AS question_id, {NORM_SQL.format(c='text')} AS norm, {terms_sql('text')} AS terms FROM conversations),
e AS (SELECT 'ex-' || item_id AS example_id, lower(text) AS field, {terms_sql('text')} AS terms, string_split(text, ' ')[1:2] AS req FROM benchmark),
s AS (SELECT question_id, example_id,
  CASE WHEN contains(norm, field) THEN 10.0 WHEN contains(field, norm) AND length(norm) >= 10 THEN 5.0 ELSE 0.0 END
  + 2.0 * len(list_intersect(q.terms, e.terms))
  + 3.0 * len([r for r in req if length(r) > 0 AND contains(norm, lower(r))]) AS score FROM q CROSS JOIN e)
"""


@query("score_examples", SCORES_SQL + "SELECT question_id, example_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0")
def score_examples(t):
    return RT.score_examples(chat_questions(t), passage_examples(t))


@query(
    "retrieve_examples",
    SCORES_SQL + "SELECT question_id, example_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, "
    "ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY score DESC, example_id) AS rank FROM s WHERE score > 0) x WHERE rank <= 2",
)
def retrieve_examples(t):
    return RT.best_examples(chat_questions(t), passage_examples(t))


def word_tables(t) -> DataFrame:
    """Tables to choose from: words that several passages share."""
    words = t["benchmark"].select(F.explode(X.extract_terms(F.col("text"))).alias("table_name"))
    counts = words.groupBy("table_name").agg(F.count("*").alias("n")).filter(F.col("n") >= 3)
    return counts.select("table_name", F.array(F.concat(F.col("table_name"), F.lit(" "))).alias("labels"))


TABLES_SQL = (
    SCORES_SQL.strip()
    + rf""",
ex AS (SELECT question_id, lower(unnest(req)) AS table_name FROM s JOIN e USING (example_id) WHERE score >= 4),
tb AS (SELECT table_name FROM (SELECT unnest({terms_sql('text')}) AS table_name FROM benchmark) x GROUP BY 1 HAVING COUNT(*) >= 3),
pts AS (
  SELECT question_id, table_name, 10.0 AS points FROM q JOIN tb
    ON regexp_matches(norm, '(^|[^\p{{L}}\p{{N}}])' || table_name || '([^\p{{L}}\p{{N}}]|$)')
  UNION ALL SELECT question_id, table_name, 6.0 FROM q JOIN tb ON contains(norm, table_name || ' ')
  UNION ALL SELECT question_id, table_name, 4.0 FROM ex),
seed AS (SELECT question_id, table_name, SUM(points) AS points FROM pts JOIN tb USING (table_name) GROUP BY 1, 2),
rel AS (SELECT lower(req[1]) AS a, lower(req[2]) AS b FROM e),
both_ways AS (SELECT a, b FROM rel UNION ALL SELECT b, a FROM rel),
near AS (SELECT s.question_id, w.b AS table_name, 2.0 AS points FROM seed s JOIN q USING (question_id)
  JOIN both_ways w ON w.a = s.table_name WHERE regexp_matches(norm, 'join|between|across|لكل|بين')),
tot AS (SELECT question_id, table_name, SUM(points) AS score FROM
  (SELECT * FROM seed UNION ALL SELECT near.* FROM near JOIN tb USING (table_name)) y GROUP BY 1, 2)
SELECT question_id, table_name, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY score DESC, table_name) AS rank FROM tot) x WHERE rank <= 5
"""
)


@query("score_tables", TABLES_SQL)
def score_tables(t):
    tables = word_tables(t)
    examples = passage_examples(t)
    index = RT.question_index(chat_questions(t))
    example_tables = examples.select("example_id", F.explode("required_tables").alias("r")).select(
        "example_id", F.lower("r").alias("table_name")
    )
    links = examples.select(
        F.lower(F.element_at("required_tables", 1)).alias("from_table"),
        F.lower(F.element_at("required_tables", 2)).alias("to_table"),
    )
    tasks = RT.pair_tasks(index, examples)
    return RT.score_tables(
        chat_questions(t), tables, example_scores=RT.score_examples(chat_questions(t), examples, index=index, tasks=tasks),
        example_tables=example_tables, relationships=links, index=index, tasks=tasks,
    )


def _tokens_sql(c: str) -> str:
    return f"CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, CAST(floor(length({c}) * 0.5) AS BIGINT)) END"


BREAK = "chr(10) || chr(10)"
PACK_SQL = f"""
WITH RECURSIVE s AS (SELECT conv_id AS question_id, role || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS name,
  CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS priority, replace(text, chr(10), {BREAK}) AS content FROM conversations),
o AS (SELECT question_id, name, content, {_tokens_sql('content')} AS size, string_split(content, {BREAK}) AS paras,
  ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY priority, name) AS rn FROM s),
p AS (SELECT *, [list_sum([{_tokens_sql('x')} for x in paras[1:i]]) for i in range(1, len(paras) + 1)] AS sums FROM o),
r AS (SELECT question_id, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS parts, CAST([] AS VARCHAR[]) AS names, CAST(0 AS BIGINT) AS used, FALSE AS truncated
  FROM (SELECT DISTINCT question_id FROM o) d
UNION ALL SELECT question_id, rn, CASE WHEN part <> '' THEN list_append(parts, part) ELSE parts END,
  CASE WHEN part <> '' THEN list_append(names, name) ELSE names END, CAST(used + {_tokens_sql('part')} AS BIGINT), truncated OR NOT whole FROM (
  SELECT r.question_id, p.rn, r.parts, r.names, p.name, r.used, r.truncated, r.used + p.size <= 400 AS whole,
    CASE WHEN r.used + p.size <= 400 THEN p.content WHEN 400 - r.used < 50 THEN ''
    ELSE array_to_string(p.paras[1:len([c for c in p.sums if c <= 400 - r.used])], {BREAK}) END AS part
  FROM r JOIN p ON p.question_id = r.question_id AND p.rn = r.rn + 1) x)
SELECT question_id, array_to_string(parts, {BREAK}) AS context_text, array_to_string(names, ',') AS included,
  CAST(used AS INTEGER) AS used_tokens, truncated FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY rn DESC) = 1
"""


@query("pack_context", PACK_SQL)
def pack_context(t):
    sections = t.spread("conversations").select(
        F.col("conv_id").alias("question_id"), "role",
        F.concat_ws("-", "role", F.lpad(F.col("turn").cast("string"), 6, "0")).alias("name"),
        F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3).alias("priority"),
        F.regexp_replace("text", "\n", "\n\n").alias("content"),
    )
    packed = RT.pack_context(sections, 400)
    return packed.withColumn("included", F.array_join("included", ","))


def _sources(t) -> list[DataFrame]:
    return [
        RT.search_source(t["benchmark"], "benchmark", 0, "item_id", ["text"]),
        RT.search_source(t.spread("documents"), "documents", 1, "doc_id", ["text", "source"]),
        RT.search_source(t.spread("pages"), "pages", 2, "page_id", ["url", "html"]),
    ]


HAY_SQL = (
    "(SELECT 'benchmark' AS source, 0 AS r, item_id AS id, lower(text) AS hay FROM benchmark UNION ALL "
    "SELECT 'documents', 1, doc_id, lower(text || ' ' || source) FROM documents UNION ALL "
    "SELECT 'pages', 2, page_id, lower(url || ' ' || html) FROM pages) h"
)


@query(
    "keyword_search",
    f"SELECT source, CAST(id AS VARCHAR) AS id FROM {HAY_SQL} WHERE contains(hay, 'heron') ORDER BY r, h.id LIMIT 20",
)
def keyword_search(t):
    return RT.keyword_search(_sources(t), "Heron", 20)[0]


@query(
    "keyword_search_status",
    f"SELECT COUNT(*) AS total_hits, COUNT(*) > 20 AS truncated FROM {HAY_SQL} WHERE contains(hay, 'heron')",
)
def keyword_search_status(t):
    return RT.keyword_search(_sources(t), "Heron", 20)[1]


# --------------------------------------------------------------------- documents


@query(
    "build_example_documents",
    "SELECT 'chat:example:' || c.conv_id || '-' || c.turn AS id, 'Question (English): ' || c.text || chr(10) || 'SQL:' || chr(10) || trim(p.text) "
    "AS document, 'example' AS kind FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn + 1 "
    "WHERE c.role = 'user'",
)
def build_example_documents(t):
    q = t.spread("conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    a = t.spread("conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sql"))
    none = F.lit(None).cast("string")
    rows = q.join(a, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("example_id"),
        none.alias("question_ar"), F.col("text").alias("question_en"), none.alias("intent"), "sql",
        none.alias("explanation"), F.array().cast("array<string>").alias("tables"),
        F.lit("simple").alias("difficulty"), F.lit("high").alias("confidence"),
    )
    return D.example_documents("chat", rows).select("id", "document", "kind")


@query(
    "build_glossary_documents",
    "SELECT 'parts:glossary:' || regexp_replace(replace(lower(p_name || ' ' || p_partkey), ' ', '_'), '[^a-z0-9_-]', '', 'g') AS id, "
    "'Glossary term: ' || p_name || ' ' || p_partkey || chr(10) || 'English: ' || array_to_string(string_split(p_name, ' '), ', ') || chr(10) || "
    "'Maps to tables: part' AS document, 'glossary' AS kind FROM part",
)
def build_glossary_documents(t):
    """One term per part; its lists come from the row itself."""
    empty = F.array().cast("array<string>")
    terms = t["part"].select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("canonical"), F.split("p_name", " ").alias("en"),
        F.array(F.lit("part")).alias("tables"), *[empty.alias(c) for c in ("ar", "synonyms", "columns", "phrases")],
    )
    return D.glossary_documents("parts", terms).select("id", "document", "kind")


@query(
    "build_relationship_documents",
    "SELECT 'geo:relationship:nation_' || n_nationkey AS id, 'Relationship: ' || n_name || '(n_regionkey) → ' || r_name || "
    "'(r_regionkey) [explicit, many-to-one, confidence: high]' AS document, 'relationship' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def build_relationship_documents(t):
    rows = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("rel_id"), F.col("n_name").alias("from_table"),
        F.array(F.lit("n_regionkey")).alias("from_columns"), F.col("r_name").alias("to_table"), F.array(F.lit("r_regionkey")).alias("to_columns"),
        F.lit("explicit").alias("kind"), F.lit("many-to-one").alias("cardinality"), F.lit("high").alias("confidence"),
        F.lit(None).cast("string").alias("reason"),
    )
    return D.relationship_documents("geo", rows).select("id", "document", "kind")


@query(
    "build_rule_documents",
    "SELECT 'shop:business_rule:label_' || doc_id AS id, 'Business rule [label_' || doc_id || ']: quality ' || quality || chr(10) || "
    "'Applies to tables: documents, labels' || CASE WHEN toxic = 1 THEN chr(10) || '[Needs human review]' ELSE '' END AS document, "
    "'business_rule' AS kind FROM labels",
)
def build_rule_documents(t):
    rows = t["labels"].select(
        F.concat(F.lit("label_"), F.col("doc_id").cast("string")).alias("rule_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("description"),
        F.array(F.lit("documents"), F.lit("labels")).alias("tables"), F.lit("high").alias("confidence"),
        (F.col("toxic") == 1).alias("needs_review"),
    )
    return D.rule_documents("shop", rows).select("id", "document", "kind")


@query(
    "build_meaning_documents",
    "SELECT 'shop:business_rule:meanings_' || replace(lower(n_name), ' ', '_') || '_n_regionkey' AS id, 'Code meanings for ' || n_name || '.n_regionkey:' || chr(10) || "
    "n_regionkey || '=' || r_name AS document, 'business_rule' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def build_meaning_documents(t):
    code = F.struct(F.col("n_regionkey").cast("string").alias("code"), F.col("r_name").alias("label"))
    rows = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("table_name"), F.lit("n_regionkey").alias("column_name"), F.array(code).alias("codes")
    )
    return D.meaning_documents("shop", rows).select("id", "document", "kind")


@query(
    "build_metric_documents",
    "SELECT 'shop:metric:' || lower(p_type) AS id, 'Metric: ' || p_type || chr(10) || 'Description: ' || COUNT(*) || ' parts' || chr(10) || "
    "'SQL expression: SUM(p_size) = ' || CAST(SUM(p_size) AS BIGINT) || chr(10) || 'Required tables: part' AS document, 'metric' AS kind FROM part GROUP BY p_type",
)
def build_metric_documents(t):
    empty = F.array().cast("array<string>")
    sums = t["part"].groupBy("p_type").agg(F.count("*").cast("string").alias("n"), F.sum("p_size").cast("string").alias("size"))
    rows = sums.select(
        F.col("p_type").alias("metric_id"), F.col("p_type").alias("name_en"), F.lit(None).cast("string").alias("name_ar"),
        F.concat("n", F.lit(" parts")).alias("description"), F.concat(F.lit("SUM(p_size) = "), "size").alias("expression"),
        F.array(F.lit("part")).alias("tables"), empty.alias("caveats"), F.lit("high").alias("confidence"),
    )
    return D.metric_documents("shop", rows).select("id", "document", "kind")


@query(
    "build_profile_documents",
    "SELECT 'shop:table_profile:' || lower(replace(s_name, '#', '')) AS id, 'Table profile: ' || s_name || chr(10) || 'Business name (English): ' || s_name || chr(10) || "
    "'Grain: one supplier' || chr(10) || 'Common questions:' || chr(10) || '  - nation ' || s_nationkey || chr(10) || '  - key ' || s_suppkey AS document, "
    "'table_profile' AS kind FROM supplier",
)
def build_profile_documents(t):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    questions = F.array(
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), F.concat(F.lit("key "), F.col("s_suppkey").cast("string"))
    )
    rows = t["supplier"].select(
        F.col("s_name").alias("table_name"), none.alias("business_name_ar"), F.col("s_name").alias("business_name_en"),
        none.alias("description"), F.lit("one supplier").alias("grain"), questions.alias("questions"), empty.alias("filters"),
        F.lit("high").alias("confidence"),
    )
    return D.table_profile_documents("shop", rows).select("id", "document", "kind")


@query(
    "build_table_documents",
    "SELECT 'geo:schema_table:' || replace(lower(r_name), ' ', '_') AS id, 'Table: dbo.' || r_name || chr(10) || 'Primary key: r_regionkey' || chr(10) || "
    "'Columns:' || chr(10) || string_agg('  - ' || n_name || ' (' || c || ') NOT NULL', chr(10) ORDER BY n_nationkey) AS document, "
    "'schema_table' AS kind FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey, CAST(COUNT(*) AS VARCHAR) AS c "
    "FROM customer GROUP BY 1) x ON c_nationkey = n_nationkey GROUP BY r_name",
)
def build_table_documents(t):
    tables = t["region"].select(
        F.col("r_name").alias("table_name"), F.lit("dbo").alias("schema_name"), F.lit("").alias("description"),
        F.array(F.lit("r_regionkey")).alias("primary_key"),
    )
    sizes = t["customer"].groupBy("c_nationkey").agg(F.count("*").cast("string").alias("type"))
    nations = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    columns = nations.join(sizes, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("r_name").alias("table_name"), F.col("n_nationkey").alias("position"),
        F.col("n_name").alias("name"), "type", F.lit(False).alias("nullable"),
        F.lit(None).cast("string").alias("default_value"),
    )
    return D.table_documents("geo", tables, columns).select("id", "document", "kind")


UPSERT_SQL = (
    "SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN l.doc_id IS NULL THEN d.text ELSE 'quality ' || l.quality END AS document FROM documents d "
    "LEFT JOIN (SELECT doc_id, MAX(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id"
)


def documents_and_notes(t) -> tuple[DataFrame, DataFrame]:
    key = F.col("doc_id").cast("string").alias("id")
    note = F.concat(F.lit("quality "), F.col("quality").cast("string"))
    return t.spread("documents").select(key, F.col("text").alias("document")), t["labels"].select(key, note.alias("document"), "quality")


@query("upsert_documents", UPSERT_SQL)
def upsert(t):
    existing, batch = documents_and_notes(t)
    return upsert_documents(existing, batch, "quality")


@query("upsert_collection", UPSERT_SQL)
def upsert_in_place(t):
    """The documents as a bucketed collection, after a batch of labels was written over it."""
    path = f"{work_folder(t.spark)}/bucketed-{uuid.uuid4().hex}"
    existing, batch = documents_and_notes(t)
    create_collection(existing, path)
    upsert_collection(batch, path, "quality")
    return read_collection(t.spark, path)


@query("upsert_written", "SELECT COUNT(DISTINCT doc_id) AS written FROM labels")
def upsert_written(t):
    """How many documents the batch of labels writes."""
    return written_count(t["labels"].select(F.col("doc_id").cast("string").alias("id")))


@query(
    "export_csv",
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
)
def export_round_trip(t):
    """The supplier list after it was exported and read back as text."""
    path = f"{work_folder(t.spark)}/export-{uuid.uuid4().hex}"
    export_csv(t["supplier"].select("s_suppkey", "s_name", "s_nationkey"), path)
    schema = "s_suppkey STRING, s_name STRING, s_nationkey STRING"
    return t.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query("reset_collection", "SELECT doc_id AS id, toxic FROM labels WHERE toxic = 1")
def reset_round_trip(t):
    """A collection that was written, then reset with other rows, as it reads afterwards."""
    path = f"{work_folder(t.spark)}/collection-{uuid.uuid4().hex}"
    rows = t["labels"].select(F.col("doc_id").alias("id"), "toxic")
    write_collection(rows, path)
    write_collection(rows.filter(F.col("toxic") == 1), path, force=True)
    return t.spark.read.schema("id BIGINT, toxic INT").parquet(path)
