"""Masking, small-group suppression, row filters, column tiers and catalog checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.limits import Capped, cap_rows

ADMIN = "admin"
# Result columns that hold a group's size.
COUNT_COLUMNS = ("count", "cnt", "total_count", "row_count", "n")
# Groups that may read each column tier.
TIER_READERS = {
    "secret": ("admin",),
    "pii": ("admin", "pii_reader"),
    "sensitive": ("admin", "security"),
}
# Parts of a column name that suggest personal data.
PII_NAME_PARTS = (
    "email", "phone", "mobile", "fax", "address", "street",
    "zipcode", "postalcode", "birthdate", "dateofbirth", "dob",
    "firstname", "lastname", "fullname", "nationalid", "passport",
    "ipaddress", "deviceid",
)
# Parts of a column name that suggest secrets.
SECRET_NAME_PARTS = (
    "password", "passwd", "pwd", "secret", "token", "apikey",
    "privatekey", "creditcard", "cardnumber", "cvv", "ssn",
    "socialsecurity",
)


@dataclass(frozen=True)
class MaskingRule:
    column: str
    mask_type: str
    groups: tuple[str, ...] = ()


@dataclass(frozen=True)
class RowFilter:
    table: str
    expression: str
    groups: tuple[str, ...] = ()


@dataclass(frozen=True)
class AccessGroup:
    name: str
    allowed_tables: tuple[str, ...] = ()
    blocked_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    """What a caller may see. Plain data; the operators below give it effect."""

    allowed_schemas: tuple[str, ...] = ()
    blocked_schemas: tuple[str, ...] = ()
    allowed_tables: tuple[str, ...] = ()
    blocked_tables: tuple[str, ...] = ()
    secret_columns: tuple[str, ...] = ()
    pii_columns: tuple[str, ...] = ()
    sensitive_columns: tuple[str, ...] = ()
    masking_rules: tuple[MaskingRule, ...] = ()
    row_filters: tuple[RowFilter, ...] = ()
    access_groups: tuple[AccessGroup, ...] = ()
    min_group_size: int = 1
    max_rows: int = 10_000
    default_limit: int = 100
    # Schemas that are closed whatever the policy says.
    closed_schemas: tuple[str, ...] = field(default=("sys", "information_schema"))


class AccessDenied(ValueError):
    """A column or table lies outside what the caller may read."""


def _concerns(rule_groups: Sequence[str], groups: Iterable[str]) -> bool:
    return not rule_groups or bool(set(rule_groups) & set(groups))


# --------------------------------------------------------------------- masking


def mask_redact(c: Column) -> Column:
    return F.when(c.isNotNull(), "[REDACTED]")


def mask_partial(c: Column) -> Column:
    """Keep the first character and the part after the first at sign, else hide all."""
    text = c.cast("string")
    at = F.instr(text, "@")
    kept = F.concat(F.substring(text, 1, 1), F.lit("***@"), F.substr(text, at + 1))
    looks_like_mail = text.rlike(r"(?U)\S+@\S+") & (at > 1)
    return F.when(c.isNull(), None).when(looks_like_mail, kept).otherwise("***")


def mask_hash(c: Column) -> Column:
    digest = F.substring(F.sha2(c.cast("string"), 256), 1, 12)
    return F.concat(F.lit("[HASH:"), digest, F.lit("]"))


MASKS: dict[str, Callable[[Column], Column]] = {
    "redact": mask_redact,
    "partial": mask_partial,
    "hash": mask_hash,
}


def _rule_hits(rule_column: str, name: str) -> bool:
    rule, col = rule_column.strip().lower(), name.strip().lower()
    return rule == col or rule.endswith(f".{col}")


def apply_masking_rules(
    df: DataFrame, rules: Sequence[MaskingRule], groups: Sequence[str]
) -> DataFrame:
    """Apply the rules in order; each hits the first column its name matches."""
    if ADMIN in groups:
        return df
    masked: dict[str, Column] = {}
    for rule in rules:
        hit = next((c for c in df.columns if _rule_hits(rule.column, c)), None)
        if hit is None or not _concerns(rule.groups, groups):
            continue
        current = masked.get(hit, F.col(f"`{hit}`"))
        mask = MASKS.get(rule.mask_type, lambda c: F.when(c.isNotNull(), "[MASKED]"))
        masked[hit] = mask(current)
    return df.select(*[masked.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def min_group_size(
    df: DataFrame, k: int, groups: Sequence[str], count_cols: Sequence[str] | None = None
) -> DataFrame:
    """Drop rows in which a numeric count column lies below ``k``; a null count stays.

    Counts compare as whole numbers, and ``int(x) < k`` is the same as ``x < k`` for a
    whole ``k``, so no cast is needed. NaN stands for null and stays as well.
    """
    if ADMIN in groups or k <= 1:
        return df
    names = {c.lower() for c in (COUNT_COLUMNS if count_cols is None else count_cols)}
    tests = []
    for f in df.schema.fields:
        if f.name.lower() not in names:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif not isinstance(f.dataType, T.NumericType):
            continue
        tests.append(F.coalesce(c < k, F.lit(False)))
    return df.filter(~reduce(lambda a, b: a | b, tests)) if tests else df


# ------------------------------------------------------------ rows and columns


def row_filter(
    df: DataFrame, table: str, filters: Sequence[RowFilter], groups: Sequence[str]
) -> DataFrame:
    """Keep only the rows the caller's filters for this table allow."""
    for f in filters:
        if f.table.lower() == table.lower() and _concerns(f.groups, groups):
            df = df.filter(F.expr(f.expression))
    return df


def _listed(entries: Sequence[str], table: str, col: str, strict: bool) -> bool:
    full, bare = f"{table}.{col}".lower(), col.lower()
    for entry in (e.lower() for e in entries):
        if entry in (full, bare):
            return True
        if not strict and "." in entry and entry.split(".", 1)[1] == bare:
            return True
    return False


def column_tier(col: str, table: str, policy: Policy, strict: bool = False) -> str | None:
    """The first tier that lists a column: secret, then pii, then sensitive."""
    tiers = {
        "secret": policy.secret_columns,
        "pii": policy.pii_columns,
        "sensitive": policy.sensitive_columns,
    }
    return next((t for t, e in tiers.items() if _listed(e, table, col, strict)), None)


def restrict_columns(
    df: DataFrame, table: str, policy: Policy, groups: Sequence[str],
    mode: str = "drop", strict: bool = False,
) -> DataFrame:
    """Drop the columns of tiers the caller may not read, or refuse the frame.

    A tier entry also hits its bare column name in any other table unless ``strict``.
    """
    hidden = []
    for c in df.columns:
        tier = column_tier(c, table, policy, strict)
        if tier is not None and not set(TIER_READERS[tier]) & set(groups):
            hidden.append(c)
    if hidden and mode == "raise":
        raise AccessDenied(f"columns of {table} are not readable: {', '.join(hidden)}")
    return df.drop(*hidden)


def classify_columns(df: DataFrame, col: str = "column_name") -> DataFrame:
    """Guess from a column's name whether it holds secrets or personal data."""
    plain = F.regexp_replace(F.lower(F.col(col)), r"(?U)[_\-\s]", "")
    category = (
        F.when(plain.rlike("|".join(SECRET_NAME_PARTS)), "secret")
        .when(plain.rlike("|".join(PII_NAME_PARTS)), "pii")
        .otherwise("none")
    )
    return df.withColumn("category", category)


# -------------------------------------------------------------------- catalogs


def _table_open(name: str, policy: Policy) -> bool:
    schema, _, table = name.lower().rpartition(".")
    closed = {s.lower() for s in (*policy.closed_schemas, *policy.blocked_schemas)}
    if schema in closed:
        return False
    if schema and policy.allowed_schemas:
        if schema not in {s.lower() for s in policy.allowed_schemas}:
            return False
    if table in {b.lower() for b in policy.blocked_tables}:
        return False
    return not policy.allowed_tables or table in {a.lower() for a in policy.allowed_tables}


def govern_catalog(
    spark: SparkSession, tables: Mapping[str, DataFrame], policy: Policy,
    groups: Sequence[str] = (), caller: str = "",
) -> dict[str, str]:
    """Register a view for each table the policy opens, filtered and restricted.

    Gives the view of each opened table. Views are shared by a session, so their names hold
    the caller's name, or else its groups, and the schema: neither another caller nor a table
    of the same name in another schema can take a view's place. The caller's views of tables
    that the policy closes are dropped.
    """
    who = caller or "_".join(sorted(groups)) or "anyone"
    views = {name: _plain_name(f"{who}__{name}") for name in tables}
    if len({v.lower() for v in views.values()}) < len(views):
        raise ValueError("two tables would share one view")
    for name, view in views.items():
        if _table_open(name, policy):
            bare = name.rpartition(".")[2]
            df = row_filter(tables[name], bare, policy.row_filters, groups)
            restrict_columns(df, bare, policy, groups).createOrReplaceTempView(view)
        else:
            spark.catalog.dropTempView(view)
    return {name: view for name, view in views.items() if _table_open(name, policy)}


def _plain_name(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_") if not re.search(r"[^0-9A-Za-z_.]", name) else "v_" + name.encode().hex()


def scope(
    tables: Mapping[str, DataFrame], policy: Policy, groups: Sequence[str]
) -> dict[str, DataFrame]:
    """The tables and columns the caller's access groups leave open.

    A caller without any group is held to the blocked columns of every group.
    """
    mine = [g for g in policy.access_groups if not groups or g.name in groups]
    allowed = {t.lower() for g in mine for t in g.allowed_tables}
    blocked = tuple(c for g in mine for c in g.blocked_columns)
    out = {}
    for name in tables:
        if not _table_open(name, policy) or (allowed and name.lower() not in allowed):
            continue
        df = restrict_columns(tables[name], name, policy, groups)
        drop = [c for c in df.columns if _listed(blocked, name, c, strict=True)]
        out[name] = df.drop(*drop)
    return out


def governed_result(
    tables: Mapping[str, DataFrame], policy: Policy, groups: Sequence[str],
    run: Callable[[Mapping[str, DataFrame]], DataFrame],
) -> Capped:
    """Run a query under a policy: row filter, column tiers, the query, row cap, small
    groups, masking. Gives the shaped rows with the status of the cap, both from one run.

    Filters and tiers act before the query sees a frame. Suppression comes before
    masking so that a mask on a count cannot hide a small group.
    """
    seen = {}
    for name in tables:
        if _table_open(name, policy):
            df = row_filter(tables[name], name, policy.row_filters, groups)
            seen[name] = restrict_columns(df, name, policy, groups)

    def shape(capped: DataFrame) -> DataFrame:
        kept = min_group_size(capped, policy.min_group_size, groups)
        return apply_masking_rules(kept, policy.masking_rules, groups)

    return cap_rows(run(seen), policy.max_rows).shaped(shape)


def key_audit(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Whether a declared key holds: rows, rows with a null part, keys that repeat."""
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
    per_key = df.select(*pk).groupBy(*pk).agg(F.count("*").alias("_n"))
    # Keys are folded once; the totals come from the folded rows.
    zero = F.lit(0).cast("long")
    return per_key.agg(
        F.coalesce(F.sum("_n"), zero).alias("rows"),
        F.coalesce(F.sum(F.when(has_null, F.col("_n")).otherwise(0)), zero).alias("nulls"),
        F.coalesce(F.sum(F.when(~has_null & (F.col("_n") > 1), 1).otherwise(0)), zero).alias(
            "duplicates"
        ),
    )


def catalog_lint(refs: DataFrame, columns: DataFrame) -> DataFrame:
    """Issues in a list of references to catalog names.

    ``refs``: ref_id, table_name, column_name (null for a table reference), table_code,
    column_code, severity. ``columns``: table_name, column_name. A reference to an
    unknown table reports ``table_code``; a known table without the column reports
    ``column_code``. Only the distinct references reach the joins.
    """
    names = refs.groupBy("table_name", "column_name").agg(F.count("*").alias("_uses"))
    tables = columns.select("table_name").distinct().withColumn("_t", F.lit(True))
    cols = columns.select("table_name", "column_name").distinct().withColumn("_c", F.lit(True))
    known = names.join(tables, "table_name", "left").join(
        cols, ["table_name", "column_name"], "left"
    )
    bad = known.filter(F.col("_t").isNull() | (F.col("column_name").isNotNull() & F.col("_c").isNull()))
    same = bad.select(
        F.col("table_name").alias("_tn"), F.col("column_name").alias("_cn"), F.col("_t")
    )
    cond = F.col("table_name").eqNullSafe(F.col("_tn")) & F.col("column_name").eqNullSafe(F.col("_cn"))
    return refs.join(same, cond).select(
        "ref_id", "table_name", "column_name",
        F.when(F.col("_t").isNull(), F.col("table_code")).otherwise(F.col("column_code")).alias("code"),
        "severity",
    )


def duplicate_ids(df: DataFrame, col: str, code: str, severity: str = "error") -> DataFrame:
    """Identifiers that occur more than once."""
    counts = df.groupBy(F.col(col).alias("ref_id")).agg(F.count("*").alias("occurrences"))
    return counts.filter(F.col("occurrences") > 1).select(
        "ref_id", "occurrences", F.lit(code).alias("code"), F.lit(severity).alias("severity")
    )
