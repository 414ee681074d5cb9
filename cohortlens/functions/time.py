"""Time tags and time-based transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(c: Column) -> Column:
    """Epoch seconds given as number or digit string; '' / 'x' / 0 / null -> null."""
    v = c.cast("string").try_cast("bigint")
    return F.when(v != 0, v)


def day_tag(created_utc: Column) -> Column:
    """UTC day ``yyyy-MM-dd`` (falsy or invalid epochs stay untagged)."""
    return F.date_format(F.timestamp_seconds(epoch_seconds(created_utc)), "yyyy-MM-dd")


def month_tag(created_utc: Column) -> Column:
    """UTC month ``yyyy-MM``."""
    return F.date_format(F.timestamp_seconds(epoch_seconds(created_utc)), "yyyy-MM")


def epoch_reject(created_utc: Column) -> Column:
    """why a row gets no day or month: ``missing``, ``not a number`` or
    ``zero``; null for rows that are tagged."""
    s = created_utc.cast("string")
    return F.when(s.isNull() | (F.trim(s) == ""), "missing").when(s.try_cast("bigint").isNull(), "not a number") \
        .when(s.try_cast("bigint") == 0, "zero")


def log_scale(x: Column, offset: float = 1e-9) -> Column:
    """``ln(x + offset)``; non-positive arguments give null (not an error)."""
    a = x.cast("double") + F.lit(offset)
    return F.when(a > 0, F.log(a))


def decay(days_ago: Column, rate: float = 0.05) -> Column:
    """``exp(-rate * days_ago)``."""
    return F.exp(F.lit(-rate) * days_ago.cast("double"))


def split_name(name: Column) -> tuple[Column, Column, Column]:
    """``grp-type-YYYY-MM`` -> (group, type, month date or null)."""
    parts = F.split(name, "-")
    month = F.regexp_extract(name, r"(\d{4}-\d{2})", 1)
    when_ok = F.when(month != "", F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))
    return parts.getItem(0), parts.getItem(1), when_ok


__all__ = ["epoch_seconds", "day_tag", "month_tag", "log_scale", "decay", "split_name", "math"]
