"""Catalog rows to searchable text documents, one builder per kind.

Every builder gives ``id STRING, document STRING, kind STRING, metadata MAP``. Lists
are arrays on the input row; columns of a table are gathered per table first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import slug


def _line(prefix: str, value: Column) -> Column:
    """``prefix + value``, or null (skipped by concat_ws) where there is no value."""
    return F.when(F.length(value) > 0, F.concat(F.lit(prefix), value))


def _list(prefix: str, values: Column, sep: str = ", ") -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(values, sep)))


def _bullets(prefix: str, values: Column) -> Column:
    lines = F.transform(values, lambda v: F.concat(F.lit("  - "), v))
    return F.when(F.size(values) > 0, F.concat(F.lit(prefix + "\n"), F.array_join(lines, "\n")))


def _document(
    df: DataFrame, profile_id: str, kind: str, key: Column, parts: Sequence[Column],
    metadata: Mapping[str, Column],
) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.concat(F.lit(f"{profile_id}:{kind}:"), key).alias("id"),
        F.concat_ws("\n", *parts).alias("document"),
        F.lit(kind).alias("kind"),
        F.create_map(F.lit("profile_id"), F.lit(profile_id), F.lit("kind"), F.lit(kind), *pairs).alias(
            "metadata"
        ),
    )


def table_documents(
    profile_id: str, tables: DataFrame, columns: DataFrame, foreign_keys: DataFrame | None = None
) -> DataFrame:
    """``tables``: table_name, schema_name, description, primary_key. ``columns``:
    table_name, position, name, type, nullable, default_value. ``foreign_keys``:
    table_name, position, columns, to_table, to_columns."""
    text = F.concat(
        F.lit("  - "), "name", F.lit(" ("), "type", F.lit(")"),
        F.when(F.col("nullable"), "").otherwise(" NOT NULL"),
        F.when(
            F.length("default_value") > 0,
            F.concat(F.lit(" [default: "), "default_value", F.lit("]")),
        ).otherwise(""),
    )

    def gathered(df: DataFrame, line: Column, out: str) -> DataFrame:
        rows = df.groupBy("table_name").agg(
            F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("_l")
        )
        return rows.select("table_name", F.array_join(F.col("_l.line"), "\n").alias(out))

    df = tables.join(gathered(columns, text, "_columns"), "table_name", "left")
    if foreign_keys is None:
        df = df.withColumn("_fks", F.lit(""))
    else:
        fk = F.concat(
            F.lit("Foreign key: "), F.array_join("columns", ", "), F.lit(" → "), "to_table",
            F.lit("("), F.array_join("to_columns", ", "), F.lit(")"),
        )
        df = df.join(gathered(foreign_keys, fk, "_fks"), "table_name", "left")
    parts = [
        F.concat(F.lit("Table: "), "schema_name", F.lit("."), "table_name"),
        _line("", F.col("description")),
        _list("Primary key: ", F.col("primary_key")),
        F.concat(F.lit("Columns:\n"), F.coalesce(F.col("_columns"), F.lit(""))),
        _line("", F.col("_fks")),
    ]
    meta = {"table": F.col("table_name"), "schema": F.col("schema_name")}
    return _document(df, profile_id, "schema_table", slug(F.col("table_name")), parts, meta)


def relationship_documents(profile_id: str, rels: DataFrame) -> DataFrame:
    """``rels``: rel_id, from_table, from_columns, to_table, to_columns, kind,
    cardinality, confidence, reason."""
    head = F.concat(
        F.lit("Relationship: "), "from_table", F.lit("("), F.array_join("from_columns", ", "),
        F.lit(") → "), "to_table", F.lit("("), F.array_join("to_columns", ", "), F.lit(") ["),
        "kind", F.lit(", "), "cardinality", F.lit(", confidence: "), "confidence", F.lit("]"),
    )
    meta = {c: F.col(c) for c in ("from_table", "to_table", "rel_id")}
    parts = [head, _line("", F.col("reason"))]
    return _document(rels, profile_id, "relationship", F.col("rel_id"), parts, meta)


def rule_documents(profile_id: str, rules: DataFrame) -> DataFrame:
    """``rules``: rule_id, description, tables, confidence, needs_review."""
    parts = [
        F.concat(F.lit("Business rule ["), "rule_id", F.lit("]: "), "description"),
        _list("Applies to tables: ", F.col("tables")),
        F.when(F.col("needs_review"), "[Needs human review]"),
    ]
    meta = {c: F.col(c) for c in ("rule_id", "confidence", "needs_review")}
    return _document(rules, profile_id, "business_rule", slug(F.col("rule_id")), parts, meta)


def meaning_documents(profile_id: str, meanings: DataFrame) -> DataFrame:
    """``meanings``: table_name, column_name, codes (array of {code, label})."""
    codes = F.transform("codes", lambda c: F.concat(c["code"], F.lit("="), c["label"]))
    parts = [
        F.concat(F.lit("Code meanings for "), "table_name", F.lit("."), "column_name", F.lit(":")),
        F.array_join(codes, "; "),
    ]
    key = F.concat(F.lit("meanings_"), slug(F.concat_ws("_", "table_name", "column_name")))
    meta = {"table": F.col("table_name"), "column": F.col("column_name")}
    return _document(meanings, profile_id, "business_rule", key, parts, meta)


def glossary_documents(profile_id: str, terms: DataFrame) -> DataFrame:
    """``terms``: canonical, ar, en, synonyms, tables, columns, phrases."""
    parts = [
        F.concat(F.lit("Glossary term: "), "canonical"),
        _list("Arabic: ", F.col("ar")),
        _list("English: ", F.col("en")),
        _list("Synonyms: ", F.col("synonyms")),
        _list("Maps to tables: ", F.col("tables")),
        _list("Maps to columns: ", F.col("columns")),
        _list("Common phrases: ", F.col("phrases"), "; "),
    ]
    meta = {"canonical": F.col("canonical")}
    return _document(terms, profile_id, "glossary", slug(F.col("canonical")), parts, meta)


def metric_documents(profile_id: str, metrics: DataFrame) -> DataFrame:
    """``metrics``: metric_id, name_en, name_ar, description, expression, tables,
    caveats, confidence."""
    parts = [
        F.concat(F.lit("Metric: "), "name_en"),
        _line("Arabic name: ", F.col("name_ar")),
        _line("Description: ", F.col("description")),
        F.concat(F.lit("SQL expression: "), "expression"),
        _list("Required tables: ", F.col("tables")),
        _list("Caveats: ", F.col("caveats"), "; "),
    ]
    meta = {"metric_id": F.col("metric_id"), "confidence": F.col("confidence")}
    return _document(metrics, profile_id, "metric", slug(F.col("metric_id")), parts, meta)


def example_documents(profile_id: str, examples: DataFrame) -> DataFrame:
    """``examples``: example_id, question_ar, question_en, intent, sql, explanation,
    tables, difficulty, confidence."""
    parts = [
        _line("Question (Arabic): ", F.col("question_ar")),
        _line("Question (English): ", F.col("question_en")),
        _line("Intent: ", F.col("intent")),
        F.concat(F.lit("SQL:\n"), F.trim("sql")),
        _line("Explanation: ", F.col("explanation")),
        _list("Tables: ", F.col("tables")),
    ]
    meta = {c: F.col(c) for c in ("example_id", "difficulty", "confidence")}
    return _document(examples, profile_id, "example", slug(F.col("example_id")), parts, meta)


def table_profile_documents(profile_id: str, profiles: DataFrame) -> DataFrame:
    """``profiles``: table_name, business_name_ar, business_name_en, description, grain,
    questions, filters, confidence."""
    parts = [
        F.concat(F.lit("Table profile: "), "table_name"),
        _line("Business name (Arabic): ", F.col("business_name_ar")),
        _line("Business name (English): ", F.col("business_name_en")),
        _line("Description: ", F.col("description")),
        _line("Grain: ", F.col("grain")),
        _bullets("Common questions:", F.col("questions")),
        _bullets("Common filters:", F.col("filters")),
    ]
    meta = {"table": F.col("table_name"), "confidence": F.col("confidence")}
    return _document(profiles, profile_id, "table_profile", slug(F.col("table_name")), parts, meta)


def build_documents(profile_id: str, catalog: Mapping[str, DataFrame]) -> DataFrame:
    """All kinds together. ``catalog`` keys: tables, columns, foreign_keys,
    relationships, rules, meanings, glossary, metrics, examples, profiles."""
    makers = {
        "relationships": relationship_documents,
        "rules": rule_documents,
        "meanings": meaning_documents,
        "glossary": glossary_documents,
        "metrics": metric_documents,
        "examples": example_documents,
        "profiles": table_profile_documents,
    }
    frames = [make(profile_id, catalog[k]) for k, make in makers.items() if k in catalog]
    if "tables" in catalog:
        frames.append(
            table_documents(
                profile_id, catalog["tables"], catalog["columns"], catalog.get("foreign_keys")
            )
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
