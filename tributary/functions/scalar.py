"""Scalar expressions: time coercion and bins, logarithmic bins, domains in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"s": 1, "m": 60, "h": 3600, "H": 3600, "d": 86400, "D": 86400}
UNITS = {"h": "hour", "H": "hour", "d": "day", "D": "day", "m": "minute", "M": "month", "Y": "year"}
#: Fixed value: the pattern of a host after the scheme, without user part or www.
DOMAIN = r"(?:https?:)(?:\/\/)?(?:[^@\n]+@)?(?:www\.)?([^:\/\n]+)"


def bin_start(time: Column, unit: str) -> Column:
    """Start of the calendar bin; bins are labelled by their start."""
    return F.date_trunc(UNITS.get(unit, unit), time)


def epoch(time: Column) -> Column:
    return F.unix_micros(time) / F.lit(1e6)


def whole_units(later: Column, earlier: Column, unit: str) -> Column:
    """Whole units between two times, towards zero."""
    return ((epoch(later) - epoch(earlier)) / SECONDS[unit]).cast("bigint")


def coerce_time(raw: Column, kind: str) -> Column:
    """Numbers from 10^11 on are milliseconds, others seconds; texts that are no number are parsed."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return raw.cast("timestamp")
    number = raw.try_cast("bigint")
    return F.when(number >= 10**11, F.timestamp_millis(number)).when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(
        F.try_to_timestamp(raw.cast("string")))


def log_bin(value: Column, low: float, high: float, edges: int) -> Column:
    """Floor of the right edge of the right-closed logarithmic bin; null outside."""
    at = [10 ** (low + (high - low) * i / (edges - 1)) for i in range(edges)]
    out = F.when(value <= at[0], None)
    for right in at[1:]:
        out = out.when(value <= right, F.lit(float(int(right // 1))))
    return out.cast("double")


def url_domains(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(DOMAIN), F.lit(1)), F.array().cast("array<string>"))


def iso_time(raw: Column, kind: str) -> Column:
    return F.date_format(coerce_time(raw, kind), "yyyy-MM-dd'T'HH:mm:ss'Z'")
