"""Dates and instants as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def long_date(day: Column) -> Column:
    """March 4, 2026."""
    return F.date_format(day, "MMMM d, yyyy")


def parsed_long_date(x: Column) -> Column:
    """From ``March 4 2026`` or ``March 4, 2026``; null if it is neither."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.trim(x), ",", ""), F.lit("MMMM d yyyy")))


def iso_day(x: Column) -> Column:
    return F.try_to_date(F.substring(x, 1, 10)) if hasattr(F, "try_to_date") else F.to_date(F.substring(x, 1, 10))


def mixed_instant(x: Column) -> Column:
    """An instant from epoch seconds or ISO text, whichever the string holds; null otherwise."""
    number = F.when(x.rlike(r"^[0-9]+(\.[0-9]+)?([eE]\+?[0-9]+)?$"), F.timestamp_seconds(x.try_cast("double")))
    text = F.try_to_timestamp(F.substring(x, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(number, text)


def local_day(ts: Column, hours_behind: int = 7) -> Column:
    """The day at a fixed offset behind UTC."""
    return F.to_date(ts - F.make_dt_interval(hours=F.lit(hours_behind)))


def zone_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def phase(now: Column, begin: Column, end: Column) -> Column:
    return F.when(now < begin, "before").when(now < end, "during").otherwise("after")


def countdown(now: Column, goal: Column) -> Column:
    """Days, hours, minutes and seconds left, 0 once the goal has passed."""
    left = F.greatest(F.lit(0), F.unix_timestamp(goal) - F.unix_timestamp(now))
    return F.struct(
        F.floor(left / 86400).cast("int").alias("days"), F.floor(left % 86400 / 3600).cast("int").alias("hours"),
        F.floor(left % 3600 / 60).cast("int").alias("minutes"), (left % 60).cast("int").alias("seconds"),
    )
