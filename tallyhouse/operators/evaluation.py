"""Checks over a question set and their roll-up into a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK = "struct<code: string, passed: boolean, severity: string, message: string>"


def check(code: str, passed: Column, severity: Column | str, message: Column | str = "") -> Column:
    """One check result."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.lit(code).alias("code"), passed.alias("passed"), lit(severity).alias("severity"),
        lit(message).alias("message"),
    ).cast(CHECK)


def missing_references(refs: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """References to names the schema lacks; only the distinct names are compared."""
    unknown = refs.select(*keys).distinct().join(columns.select(*keys).distinct(), keys, "left_anti")
    return refs.join(unknown, keys)


def required_overlap(items: DataFrame) -> DataFrame:
    """Add ``overlap_ok`` and ``join_ok``.

    ``items``: sql, required_tables, tables (those the SQL names), must_reject. The SQL
    has to name one of the required tables; with two or more required it needs two
    tables and either a join or as many tables as required.
    """
    shared = F.size(F.array_intersect("required_tables", "tables"))
    required, named = F.size("required_tables"), F.size(F.array_distinct("tables"))
    overlap_ok = F.when(required > 0, (shared > 0) | (named == 0))
    has_join = F.contains(F.lower("sql"), F.lit("join"))
    join_ok = F.when(
        (required >= 2) & ~F.coalesce("must_reject", F.lit(False)),
        (named >= 2) & (has_join | (named >= required)),
    )
    return items.withColumn("overlap_ok", overlap_ok).withColumn("join_ok", join_ok)


def text_presence(items: DataFrame) -> DataFrame:
    """Add the checks on the texts of an item: empty SQL, both languages, reject-only."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    both = (F.length(text("question_ar")) > 0) & (F.length(text("question_en")) > 0)
    no_sql = F.length(F.trim(text("sql"))) == 0
    reject_only = no_sql & F.coalesce("must_reject", F.lit(False))
    checks = F.array(
        check("BN008", both, F.when(both, "info").otherwise("warning")),
        F.when(reject_only, check("BN011", F.lit(True), "info")),
        F.when(no_sql & ~reject_only, check("BN009", F.lit(False), "error")),
    )
    return items.withColumn("checks", F.filter(checks, lambda c: c.isNotNull()))


def _unknown(items: DataFrame, lists: dict[str, str], known: DataFrame) -> DataFrame:
    """(id, one column of names per list): names in an item's lists that the schema lacks, null where
    a list has none. All lists are looked up together, so the schema is read once; null names are
    passed over."""
    none = F.array().cast("array<string>")

    def named(out: str) -> Column:
        return F.transform(F.coalesce(F.array_distinct(lists[out]), none), lambda n: F.struct(F.lit(out).alias("_list"), n.alias("name")))

    names = items.select("id", F.explode(F.concat(*[named(out) for out in lists])).alias("n")).select("id", "n.*")
    lacking = missing_references(names, known, ["name"])
    found = lambda out: F.collect_set(F.when(F.col("_list") == out, F.col("name")))
    rows = lacking.groupBy("id").agg(*[F.sort_array(found(out)).alias(out) for out in lists])
    return rows.select("id", *[F.when(F.size(out) > 0, F.col(out)).alias(out) for out in lists])


def sql_checks(items: DataFrame, known: DataFrame) -> DataFrame:
    """Add the checks on the tables of an item's SQL to ``checks``, which the roll-up reads.

    ``items``: id (unique), sql, tables, required_tables, must_reject, checks. ``known``: name.
    Unknown tables in the SQL fail an item that is not to be rejected; every required table
    that the schema lacks fails it; required tables that the SQL does not touch, or does not
    join, are warnings. Items without SQL get the check on required tables only.
    """
    items = items.join(_unknown(items, {"_bad": "tables", "_lost": "required_tables"}, known), "id", "left")
    rows = required_overlap(items)
    none = F.array().cast("array<string>")
    has_sql = F.length(F.trim(F.coalesce("sql", F.lit("")))) > 0
    allowed = ~F.coalesce("must_reject", F.lit(False))
    shown = lambda c: F.array_join(c, ", ")
    lost = F.transform(F.coalesce("_lost", none), lambda n: check("BN010", F.lit(False), "error", n))
    more = F.array(
        F.when(has_sql & allowed, check("BN002", F.col("_bad").isNull(), "error", shown(F.coalesce("_bad", none)))),
        F.when(has_sql & F.col("overlap_ok").isNotNull(), check("BN006", F.col("overlap_ok"), "warning")),
        F.when(has_sql & F.col("join_ok").isNotNull(), check("BN007", F.col("join_ok"), "warning")),
    )
    every = F.concat("checks", lost, F.filter(more, lambda c: c.isNotNull()))
    return rows.withColumn("checks", every).drop("_bad", "_lost", "overlap_ok", "join_ok")


def item_passed(items: DataFrame) -> DataFrame:
    """Add ``passed``: every check of severity error has passed; none at all also passes."""
    ok = F.forall("checks", lambda c: (c["severity"] != "error") | c["passed"])
    return items.withColumn("passed", F.coalesce(ok, F.lit(True)))


def benchmark_summary(items: DataFrame) -> DataFrame:
    """Total, passed and failed items, and failed checks of severity warning."""
    failed_warning = F.filter("checks", lambda c: (c["severity"] == "warning") & ~c["passed"])
    rows = item_passed(items).select("passed", F.size(failed_warning).alias("w"))
    zero = F.lit(0).cast("long")
    return rows.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.col("passed").cast("int")), zero).alias("passed"),
        F.coalesce(F.sum((~F.col("passed")).cast("int")), zero).alias("failed"),
        F.coalesce(F.sum("w"), zero).alias("warnings"),
    )


def failures(items: DataFrame) -> DataFrame:
    """Failing items, one row per failed check."""
    failing = item_passed(items).filter(~F.col("passed"))
    return failing.select("id", F.explode("checks").alias("c")).filter(~F.col("c.passed")).select(
        "id", "c.code", "c.severity", "c.message"
    )
