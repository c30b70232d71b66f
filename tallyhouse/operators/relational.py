"""Projections, filters, joins and set operations."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- projections


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Named columns only; a star is refused."""
    if not cols or any("*" in c for c in cols):
        raise ValueError("name the columns explicitly; * is not allowed")
    return df.select(*cols)


def tag(df: DataFrame, name: str, value: Any) -> DataFrame:
    """Add a constant column that marks where a row came from."""
    return df.withColumn(name, F.lit(value))


def safe_alias(df: DataFrame) -> DataFrame:
    """Rename a column called RowCount, in any case, to ``record_count``."""
    hits = [c for c in df.columns if re.fullmatch(r"\[?rowcount\]?", c, re.IGNORECASE)]
    return reduce(lambda d, c: d.withColumnRenamed(c, "record_count"), hits, df)


def decode(df: DataFrame, col: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Replace a code by its label; an unknown code gives null."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(pairs, F.col(col).cast("string")))


# -------------------------------------------------------------------- filters


def date_range(df: DataFrame, col: str, lo: datetime, hi: datetime) -> DataFrame:
    """Half-open range ``lo <= col < hi``; reaches the Parquet scan as a filter."""
    return df.filter((F.col(col) >= _stamp(lo)) & (F.col(col) < _stamp(hi)))


def year_filter(df: DataFrame, col: str, year: int) -> DataFrame:
    """Rows of one year, written as a range because ``year(col) = n`` is not pushed down."""
    return date_range(df, col, datetime(year, 1, 1), datetime(year + 1, 1, 1))


def date_between(df: DataFrame, col: str, lo: datetime, hi: datetime) -> DataFrame:
    """Inclusive BETWEEN: a time later than ``hi`` on the last day falls outside."""
    return df.filter(F.col(col).between(_stamp(lo), _stamp(hi)))


def _stamp(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def late(df: DataFrame, shipped: str, required: Column) -> DataFrame:
    """Rows shipped after the required date."""
    return df.filter(F.col(shipped) > required)


def above_average(df: DataFrame, col: str, inner_filter: Column | None = None) -> DataFrame:
    """Rows whose value lies above the average, the average taken by a scalar subquery."""
    inner = df if inner_filter is None else df.filter(inner_filter)
    return df.filter(F.col(col) > inner.agg(F.avg(col)).scalar())


# ---------------------------------------------------------------------- joins


@dataclass(frozen=True)
class Relationship:
    """A declared link between two tables; several columns mean a composite key."""

    rel_id: str
    from_table: str
    from_columns: tuple[str, ...]
    to_table: str
    to_columns: tuple[str, ...]
    join_type: str = "inner"

    def condition(self, left: DataFrame, right: DataFrame) -> Column:
        pairs = zip(self.from_columns, self.to_columns, strict=True)
        return reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in pairs])


def without_match(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Rows of ``a`` that have no partner in ``b``."""
    right = b.select(F.col(b_key).alias("_k"))
    return a.join(right, a[a_key] == right["_k"], "left_anti")


def join_by_relationship(
    tables: Mapping[str, DataFrame], rel: Relationship, how: str | None = None
) -> DataFrame:
    """Join two tables the way their relationship declares."""
    left, right = tables[rel.from_table], tables[rel.to_table]
    return left.join(right, rel.condition(left, right), how or rel.join_type)


def join_path(tables: Mapping[str, DataFrame], rels: Sequence[Relationship]) -> DataFrame:
    """Join along a chain of relationships, each step starting from a table already joined.

    Where an inner join matches two columns of one name, one of them is kept.
    """
    frames = {rels[0].from_table: tables[rels[0].from_table]}
    merged: dict[tuple[str, str], Column] = {}
    out = frames[rels[0].from_table]
    for rel in rels:
        sides = ((rel.from_table, rel.from_columns), (rel.to_table, rel.to_columns))
        (old, old_cols), (new, new_cols) = sides if rel.from_table in frames else sides[::-1]
        if old not in frames or new in frames:
            raise ValueError(f"{rel.rel_id} does not extend the path")
        frames[new] = tables[new]
        pairs = [
            (a, b, merged.get((old, a), frames[old][a])) for a, b in zip(old_cols, new_cols, strict=True)
        ]
        cond = reduce(lambda x, y: x & y, [left == frames[new][b] for _, b, left in pairs])
        out = out.join(frames[new], cond, rel.join_type)
        for a, b, left in pairs:
            if a == b and rel.join_type == "inner":
                out = out.drop(frames[new][b])
                merged[(new, b)] = left
    return out


def self_join(df: DataFrame, fk: str, pk: str, out: str, label: str) -> DataFrame:
    """Attach the parent's ``label`` as ``out``; rows without a parent keep null."""
    parent = df.select(F.col(pk).alias("_parent"), F.col(label).alias(out))
    return df.join(parent, df[fk] == parent["_parent"], "left").drop("_parent")


def bridge_join(
    a: DataFrame, a_key: str, bridge: DataFrame, a_fk: str, b_fk: str, b: DataFrame, b_key: str
) -> DataFrame:
    """Many-to-many through a bridge; repeated links are folded before the joins."""
    links = bridge.select(a_fk, b_fk).distinct()
    return links.join(a, links[a_fk] == a[a_key]).join(b, links[b_fk] == b[b_key])


def orphan_rows(tables: Mapping[str, DataFrame], rel: Relationship) -> DataFrame:
    """Child keys with no parent and the number of rows that carry them.

    Children are counted per key first, so a heavily repeated key is one row by the
    time it reaches the anti join.
    """
    child, parent = tables[rel.from_table], tables[rel.to_table]
    fks = [F.col(c) for c in rel.from_columns]
    present = reduce(lambda x, y: x & y, [c.isNotNull() for c in fks])
    keys = child.filter(present).groupBy(*rel.from_columns).agg(F.count("*").alias("n"))
    parents = parent.select(*rel.to_columns).alias("p")
    pairs = zip(rel.from_columns, rel.to_columns, strict=True)
    cond = reduce(lambda x, y: x & y, [keys[a] == F.col(f"p.{b}") for a, b in pairs])
    return keys.join(parents, cond, "left_anti").select(
        F.lit(rel.rel_id).alias("rel_id"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in rel.from_columns]).alias("key"),
        "n",
    )


# -------------------------------------------------------------- set operations


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL UNION: rows of both, duplicates removed."""
    return a.union(b).distinct()


def union_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION ALL by name; columns of ``b`` are cast to the types of ``a``."""
    types = {f.name: f.dataType for f in a.schema.fields}
    return a.unionByName(b.select(*[F.col(c).cast(types[c]).alias(c) for c in a.columns]))
