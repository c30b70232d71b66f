"""Column jobs over message, answer and SQL logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import has_arabic, let, strip

# Fixed value: phrases that try to override instructions. The closing word boundary
# means that a colon must be followed by a word character, and the opening one that
# "<script" must be preceded by one.
INJECTION = (
    r"(?isU)\b("
    r"ignore\s+(all\s+)?(previous|prior)\s+instructions?"
    r"|disregard\s+(all\s+)?(previous|prior)\s+instructions?"
    r"|system\s*:\s*"
    r"|assistant\s*:\s*"
    r"|you\s+are\s+now"
    r"|forget\s+(everything|all|your)"
    r"|new\s+instructions?\s*:"
    r"|override\s+(the\s+)?(system|safety)"
    r"|jailbreak"
    r"|do\s+anything\s+now"
    r"|<\s*script"
    r"|javascript\s*:"
    r"|data\s*:\s*text/html"
    r")\b"
)
# Limits on an incoming message and its metadata.
MAX_MESSAGE_CHARS = 20_000
MAX_METADATA_KEYS = 50
MAX_METADATA_KEY_CHARS = 100
MAX_METADATA_VALUE_CHARS = 2_000
# The narrower limits of the request schema.
REQUEST_METADATA_KEYS = 32
REQUEST_METADATA_KEY_CHARS = 128
REQUEST_METADATA_BYTES = 8_192

# First keywords that are not a query.
BLOCKED_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "MERGE", "DROP", "ALTER",
    "CREATE", "TRUNCATE", "EXEC", "EXECUTE", "GRANT", "REVOKE",
    "DENY", "BACKUP", "RESTORE", "BULK", "KILL", "SHUTDOWN",
)
# Fixed value: functions and procedures that reach outside the database.
DANGEROUS_FUNCTIONS = (
    r"(?i)\b(OPENROWSET|OPENQUERY|OPENDATASOURCE|xp_cmdshell|xp_\w+|sp_oacreate|sp_oamethod)\b"
)
# Phrases of an injection attempt inside SQL text.
SQL_INJECTION = (
    r"(?i)\bignore\s+(previous\s+)?instructions?\b",
    r"(?i)\bdisregard\s+(all\s+)?(previous\s+)?(instructions?|rules?)\b",
    r"(?i)\bnow\s+(you\s+are|act\s+as)\b",
    r"(?i)\bOR\s+1\s*=\s*1\b",
    r"(?i)\bOR\s+'[^']+'\s*=\s*'[^']+'\b",
)
# Fixed value: system schemas.
SYSTEM_SCHEMAS = r"(?i)\b(INFORMATION_SCHEMA|sys)\b"
# SQL features that stay blocked by default.
BLOCKED_FEATURES = ("PIVOT", "UNPIVOT", "OPENJSON", "FOR XML", "FOR JSON")

# Words that mark a question about data, Arabic by substring and English
# by whole word.
ARABIC_DATA_WORDS = (
    "كم", "عدد", "اعرض", "أعرض", "عرض", "جيب", "أفضل", "افضل", "أعلى", "اعلى",
    "أضعف", "اضعف", "مبيعات", "عملاء", "طلبات", "طلب", "طلبا", "منتج", "منتجات",
)
ENGLISH_DATA_WORDS = (
    r"(?iU)\b("
    r"count|how\s+many|list|lists|show|sales|order|orders|customer|customers|"
    r"top|bottom|best|worst|lowest|highest|total|sum|average|avg|revenue|"
    r"quantity|amount"
    r")\b"
)
# Hints, by substring, of a question that needs wider context.
CONTEXT_HINTS = (
    "مع", "بين", "لكل", "حسب", "توزيع", "مقارنة",
    "compare", "versus", "vs", "breakdown", "distribution", "per", "across", "correlation",
)
# Where an answer turns into export noise, and lines to leave out.
EXPORT_MARKERS = ("Results saved to file", "FOR VISUALIZE_DATA", "query_results_", "Test 1")
BANNED_LINES = (
    "results saved to file", "for visualize_data", "query_results_", "important: for visualize",
    "test 1", "test 2", "test 3", ".csv",
)
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _any_of(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.length(strip(c)) == 0)


def flag_injection(df: DataFrame, col: str) -> DataFrame:
    """Add ``allowed`` and ``reason`` for empty messages and override attempts."""
    c = F.col(col)
    reason = F.when(_blank(c), "empty_question").when(c.rlike(INJECTION), "suspected_prompt_injection")
    return df.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def metadata_code(meta: Column) -> Column:
    """Code of the first metadata limit a flat text map breaks, else null."""
    too_long = F.exists(F.map_values(meta), lambda v: F.length(v) > MAX_METADATA_VALUE_CHARS)
    long_key = F.exists(F.map_keys(meta), lambda k: F.length(k) > MAX_METADATA_KEY_CHARS)
    return F.when(F.size(meta) > MAX_METADATA_KEYS, "METADATA_TOO_MANY_KEYS").when(
        too_long | long_key, "METADATA_TOO_LARGE_OR_DEEP"
    )


def request_metadata_ok(meta: Column) -> Column:
    """Whether a flat text map passes the request schema."""
    keys, values = F.map_keys(meta), F.map_values(meta)
    bad_key = F.exists(keys, lambda k: _blank(k) | (F.length(k) > REQUEST_METADATA_KEY_CHARS))
    long_value = F.exists(values, lambda v: F.length(v) > MAX_METADATA_VALUE_CHARS)
    encoded = F.octet_length(F.to_json(meta))
    fits = (F.size(meta) <= REQUEST_METADATA_KEYS) & ~bad_key & ~long_value
    return meta.isNull() | (fits & (encoded <= REQUEST_METADATA_BYTES))


def ingress_filter(df: DataFrame, text_col: str, meta_col: str | None = None) -> DataFrame:
    """Add ``code``, the first limit a message breaks, and ``allowed``."""
    text = strip(F.col(text_col))
    code = (
        F.when(_blank(F.col(text_col)), "EMPTY_MESSAGE")
        .when(F.length(text) > MAX_MESSAGE_CHARS, "MESSAGE_TOO_LARGE")
        .when(text.rlike(INJECTION), "PROMPT_INJECTION")
    )
    if meta_col is not None:
        code = F.coalesce(code, metadata_code(F.col(meta_col)))
    return df.withColumn("code", code).withColumn("allowed", F.col("code").isNull())


def first_keyword(sql: Column) -> Column:
    """First word of a statement after its comments, upper case, without a semicolon."""
    plain = F.regexp_replace(sql, r"(?s)/\*.*?\*/", " ")
    plain = F.regexp_replace(plain, r"--[^\n]*", " ")
    word = F.upper(F.regexp_extract(plain, r"(?U)^\s*(\S+)", 1))
    return F.regexp_replace(word, r";+$", "")


def screen_sql_log(
    df: DataFrame, sql_col: str, blocked_features: Sequence[str] = BLOCKED_FEATURES
) -> DataFrame:
    """Add ``codes``: what a text-level look at a SQL statement objects to.

    A hit of the cheap checks (POL010, POL001, POL005) ends the screening, as does an
    empty text (POL009); system schemas and blocked features are looked at otherwise.
    """
    features = r"(?i)\b(" + _any_of(blocked_features) + r")\b" if blocked_features else "(?!)"

    def present(*codes: Column) -> Column:
        return F.filter(F.array(*codes), lambda c: c.isNotNull())

    def cheap(sql: Column) -> Column:
        injected = F.lit(False)
        for pattern in SQL_INJECTION:
            injected = injected | sql.rlike(pattern)
        return present(
            F.when(injected, "POL010"),
            F.when(first_keyword(sql).isin(*BLOCKED_KEYWORDS), "POL001"),
            F.when(sql.rlike(DANGEROUS_FUNCTIONS), "POL005"),
        )

    def rest(sql: Column) -> Column:
        return present(
            F.when(sql.rlike(SYSTEM_SCHEMAS), "POL004"), F.when(sql.rlike(features), "POL014")
        )

    def screened(sql: Column) -> Column:
        early = let(cheap(sql), lambda codes: F.when(F.size(codes) > 0, codes).otherwise(rest(sql)))
        return F.when(F.length(sql) == 0, F.array(F.lit("POL009"))).otherwise(early)

    codes = let(strip(F.coalesce(F.col(sql_col), F.lit(""))), screened)
    return df.withColumn("codes", codes).withColumn("allowed", F.size("codes") == 0)


def route_intent(df: DataFrame, col: str) -> DataFrame:
    """Add ``path``: ``data`` for a question about data, ``other`` for the rest."""
    c = F.coalesce(F.col(col), F.lit(""))
    data = c.rlike(_any_of(ARABIC_DATA_WORDS)) | c.rlike(ENGLISH_DATA_WORDS)
    return df.withColumn("path", F.when(data, "data").otherwise("other"))


def needs_context(df: DataFrame, col: str) -> DataFrame:
    """Add ``needs_context``: a hint of a comparison or breakdown occurs in the text."""
    hit = F.lower(F.coalesce(F.col(col), F.lit(""))).rlike(_any_of(CONTEXT_HINTS))
    return df.withColumn("needs_context", hit)


def clean_answer(c: Column) -> Column:
    """Cut a text at the first export marker and leave out banned lines."""
    cut = F.coalesce(c, F.lit(""))
    for marker in EXPORT_MARKERS:
        cut = F.substring_index(cut, marker, 1)
    banned = _any_of(BANNED_LINES)
    kept = F.filter(F.split(cut, _LINE_BREAK), lambda line: ~F.lower(line).rlike(banned))
    return strip(F.array_join(kept, "\n"))


def has_both_languages(df: DataFrame, arabic: str, english: str) -> DataFrame:
    """Add ``bilingual``: both question texts are present."""
    both = (F.length(F.coalesce(F.col(arabic), F.lit(""))) > 0) & (
        F.length(F.coalesce(F.col(english), F.lit(""))) > 0
    )
    return df.withColumn("bilingual", both)


def detect_arabic(df: DataFrame, col: str) -> DataFrame:
    """Add ``is_arabic``: a character of the Arabic block occurs."""
    return df.withColumn("is_arabic", has_arabic(F.col(col)))
