"""Dates as columns; all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_ts() -> Column:
    """Captured, else modified, else created."""
    return F.coalesce("captured_at", "modified_at", "created_at")


def exif_seconds(text: Column) -> Column:
    """Epoch seconds of either spelling of a capture date, null for anything else."""
    dashes, colons = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$"
    found = F.when(text.rlike(dashes), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))).when(text.rlike(colons), F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))
    return F.unix_timestamp(found)


def month_key(ts: Column) -> Column:
    """``YYYY-MM``, or ``unknown`` for null and zero. The session's zone must be UTC."""
    return F.when(ts.isNull() | (ts == 0), F.lit("unknown")).otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM"))


def gps_degrees(parts: Column, ref: Column, negative: str) -> Column:
    """Degrees, minutes and seconds as decimal degrees; null under three parts."""
    value = F.get(parts, 0) + F.get(parts, 1) / 60 + F.get(parts, 2) / 3600
    return F.when(F.size(parts) >= 3, F.when(F.coalesce(ref, F.lit("")).contains(negative), -value).otherwise(value))
