"""Time arithmetic in whole microseconds. Timestamps hold UTC; the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def unit_micros(unit_days: int) -> int:
    return unit_days * DAY_US


def window_flags(age: Column, unit_days: int) -> dict[str, Column]:
    """Membership of a post ``age`` microseconds before the anchor in each nested window."""
    u = unit_micros(unit_days)
    return {
        "baseline": age > 4 * u,
        "pre_4w": (age > 0) & (age <= 4 * u),
        "pre_2w": (age > 0) & (age <= 2 * u),
        "pre_1w": (age > 0) & (age <= u),
    }


def back_bucket(distance: Column, width_us: int) -> Column:
    """Index of the bucket ``[end-(k+1)w, end-k*w)`` for a point ``distance`` before ``end``."""
    return F.call_function("div", distance - 1, F.lit(width_us))


def seconds_to_ntz(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def epoch_text_to_ntz(text: Column) -> Column:
    """Epoch seconds given as text, with a fraction or without; null if they are no time of the years 1 to 9999."""
    micros = F.round(text.try_cast("decimal(30,9)") * F.lit(1_000_000)).try_cast("bigint")
    micros = F.coalesce(micros, F.round(text.try_cast("double") * F.lit(1e6)).try_cast("bigint"))
    return F.timestamp_micros(F.when(micros.between(-62_135_596_800_000_000, 253_402_300_799_999_999), micros)).cast("timestamp_ntz")


def week_start(ts: Column, start_day: int = 1) -> Column:
    """Start of the 7-day bucket; ``start_day`` 0 is Monday, 1 Tuesday (the default)."""
    shift = F.make_dt_interval(F.lit(start_day))
    return (F.date_trunc("week", ts - shift) + shift).cast("timestamp_ntz")


def day_span(first: Column, last: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.timestamp_diff("DAY", first, last)
