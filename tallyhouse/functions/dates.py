"""Date parts and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_name(c: Column) -> Column:
    """Year as text."""
    return F.date_format(c, "yyyy")


def year_text(c: Column) -> Column:
    """First four characters of the yyyy/MM/dd text form."""
    return F.substring(F.date_format(c, "yyyy/MM/dd"), 1, 4)


def micros(c: Column) -> Column:
    """Microseconds since the epoch (the session time zone is expected to be UTC)."""
    return F.unix_micros(c.cast("timestamp"))
