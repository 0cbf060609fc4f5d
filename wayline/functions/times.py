"""Time rules. Every function takes its clock as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions.numbers import round_half_up, safe_number


def iso_time(text: Column) -> Column:
    """Timestamp from ISO-8601 text, null if it does not parse."""
    return F.try_to_timestamp(text)


def iso_time_since_2000(text: Column, fallback: Column) -> Column:
    parsed = F.try_to_timestamp(text)
    return F.when(parsed > F.lit("2000-01-01 00:00:00").cast("timestamp"), parsed).otherwise(fallback)


def epoch_time(value: Column, fallback: Column) -> Column:
    """Timestamp from epoch seconds above 1e9, else the fallback."""
    seconds = safe_number(value)
    return F.when(seconds > F.lit(1e9), F.timestamp_micros((seconds * 1000000).cast("bigint"))).otherwise(fallback)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def older_than(updated_at: Column, now: Column, ttl_s: Column | float) -> Column:
    """Staleness flag; an unknown update time is stale."""
    ttl = ttl_s if isinstance(ttl_s, Column) else F.lit(float(ttl_s))
    return F.coalesce(seconds_between(now, updated_at) > ttl, F.lit(True))


def delay_label(scheduled: Column, expected: Column) -> Column:
    minutes = round_half_up(seconds_between(expected, scheduled) / F.lit(60.0))
    return (
        F.when(minutes.isNull(), "")
        .when(minutes >= 2, F.concat(minutes.cast("string"), F.lit(" min late")))
        .when(minutes <= -2, F.concat(F.abs(minutes).cast("string"), F.lit(" min early")))
        .otherwise("on time")
    )


def relative_age(updated_at: Column, now: Column) -> Column:
    seconds = F.greatest(F.lit(0).cast("bigint"), round_half_up(seconds_between(now, updated_at)))
    return (
        F.when(updated_at.isNull(), "update time unavailable")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .otherwise(F.concat(round_half_up(seconds / F.lit(60.0)).cast("string"), F.lit("m ago")))
    )
