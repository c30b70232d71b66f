"""Schema-driven rebuilding of records: JSON-safe values and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys whose content never reaches a log, and the texts put in its place.
SECRET_KEYS = (
    "sql",
    "query",
    "database_url",
    "connection_string",
    "password",
    "api_key",
    "authorization",
    "token",
)
REDACTED = "[REDACTED]"
REDACTED_SQL = "[REDACTED_SQL]"
SQL_HASH = "sql_hash"


def _iso(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))


def json_safe_value(c: Column, kind: T.DataType) -> Column:
    """One value in the form a JSON document can carry."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.DecimalType):
        return c.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _iso(c)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """NaN to null, decimals to doubles, dates to ISO text, bytes to base64; one select."""
    return df.select(
        *[json_safe_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def _redact_fields(fields: list[T.StructField], get) -> list[Column]:
    names = {f.name for f in fields}
    out: list[Column] = []
    for f in fields:
        key, value = f.name.lower(), get(f.name)
        if key == "sql" and isinstance(f.dataType, T.StringType):
            if SQL_HASH not in names:
                out.append(F.sha2(value, 256).alias(SQL_HASH))
            shown = F.when(value.isNotNull(), REDACTED_SQL).otherwise(REDACTED)
            out.append(shown.alias(f.name))
        elif key in SECRET_KEYS:
            out.append(F.lit(REDACTED).alias(f.name))
        else:
            out.append(_redact_value(value, f.dataType).alias(f.name))
    return out


def _redact_map(c: Column, kind: T.MapType) -> Column:
    is_text = isinstance(kind.valueType, T.StringType)
    if not is_text:
        inner = lambda k, v: F.when(
            F.lower(k).isin(*SECRET_KEYS), F.lit(None).cast(kind.valueType)
        ).otherwise(_redact_value(v, kind.valueType))
        return F.transform_values(c, inner)
    sql_entries = F.map_filter(c, lambda k, v: (F.lower(k) == "sql") & v.isNotNull())
    sql_text = F.element_at(F.map_values(sql_entries), -1)
    shown = F.transform_values(
        c,
        lambda k, v: F.when((F.lower(k) == "sql") & v.isNotNull(), REDACTED_SQL)
        .when(F.lower(k).isin(*SECRET_KEYS), REDACTED)
        .otherwise(v),
    )
    others = F.map_filter(shown, lambda k, v: k != SQL_HASH)
    with_hash = F.map_concat(others, F.create_map(F.lit(SQL_HASH), F.sha2(sql_text, 256)))
    return F.when(F.size(sql_entries) > 0, with_hash).otherwise(shown)


def _redact_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        rebuilt = F.struct(*_redact_fields(kind.fields, c.getField))
        return F.when(c.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType) and isinstance(
        kind.elementType, (T.StructType, T.ArrayType, T.MapType)
    ):
        return F.transform(c, lambda x: _redact_value(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _redact_map(c, kind)
    return c


def redact_payload(df: DataFrame) -> DataFrame:
    """Redact SQL and secrets at every level of a nested record.

    An ``sql`` text is replaced and its SHA-256 kept beside it as ``sql_hash``. A map
    whose values are not text cannot hold the redaction text, so a secret entry of
    such a map becomes null.
    """
    return df.select(*_redact_fields(df.schema.fields, lambda n: F.col(f"`{n}`")))
