"""Text columns: normalising, tokens, fingerprints and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of a word, in Latin and Arabic script, and the least
# length of a search term.
WORD = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"
WORD_CHAR = r"[\p{L}\p{N}_]"
MIN_TERM_LEN = 2
ARABIC = r"[\x{0600}-\x{06FF}]"
# Groups that a request may never claim for itself.
PROTECTED_GROUPS = ("admin", "superadmin", "root")
SLUG_LENGTH = 60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise_text(c: Column) -> Column:
    """Collapse whitespace and lower the case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def extract_terms(c: Column) -> Column:
    """Distinct lower-cased word tokens of at least two characters."""
    words = F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))
    long_enough = F.filter(words, lambda w: F.length(w) >= MIN_TERM_LEN)
    return F.array_distinct(F.transform(long_enough, F.lower))


def overlap(a: Column, b: Column) -> Column:
    """Number of values two arrays share."""
    return F.size(F.array_intersect(a, b))


def fingerprint(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def slug(c: Column) -> Column:
    """Short identifier made from a text."""
    joined = F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", "_")
    kept = F.substring(F.regexp_replace(joined, r"[^\p{L}\p{N}_\-]", ""), 1, SLUG_LENGTH)
    return F.when(F.length(kept) == 0, "chunk").otherwise(kept)


def token_estimate(c: Column) -> Column:
    """Estimated token count: half a token per character, at least one, none if empty."""
    half = F.floor(F.length(c) * 0.5).cast("int")
    return F.when(c.isNull() | (F.length(c) == 0), 0).otherwise(F.greatest(F.lit(1), half))


def parse_groups(c: Column) -> Column:
    """Comma list to trimmed names, without empty and protected ones."""
    names = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda g: strip(g))
    return F.filter(names, lambda g: (F.length(g) > 0) & ~F.lower(g).isin(*PROTECTED_GROUPS))


def has_arabic(c: Column) -> Column:
    """Whether a text holds a character of the Arabic block."""
    return F.coalesce(c.rlike(ARABIC), F.lit(False))
