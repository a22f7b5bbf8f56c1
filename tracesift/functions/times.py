"""Column expressions over event times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .network import col
from .text import one_decimal


def zeek_time(value: Column | str) -> Column:
    """Epoch seconds from an epoch number or an ISO timestamp given as text."""
    text = F.trim(col(value).cast("string"))
    iso = F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6)
    return F.coalesce(text.try_cast("double"), iso)


def utc_text(ts: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds as text; the session time zone is expected to be UTC."""
    return F.date_format(F.timestamp_micros(F.floor(col(ts) * 1e6).cast("long")), pattern)


def epoch_bucket(ts: Column | str, seconds: float) -> Column:
    return F.floor(col(ts) / F.lit(float(seconds))).cast("long")


def duration_text(seconds: Column | str) -> Column:
    s = col(seconds)
    return (
        F.when(s < 60, one_decimal(s, "s"))
        .when(s < 3600, one_decimal(s / 60, "min"))
        .otherwise(one_decimal(s / 3600, "hrs"))
    )
