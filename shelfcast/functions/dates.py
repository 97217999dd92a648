"""Date and time expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PLACEHOLDER_DATE, WEEKEND_FROM


def parse_date(text: Column) -> Column:
    """``yyyy-MM-dd`` text to a date; anything else becomes null.

    The cast is the fast path of the engine but also takes forms like ``2025-1-3``,
    so the shape is tested first. A pattern-based parser would raise and catch an
    exception for every bad value.
    """
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def without_placeholder(date: Column) -> Column:
    """The placeholder day stands for "no date"."""
    return F.nullif(date, F.lit(PLACEHOLDER_DATE).cast("date"))


def iso_weekday(date: Column) -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(date) + 1


def is_weekend(date: Column) -> Column:
    """1 from Friday on: the threshold compares ISO weekdays."""
    return (iso_weekday(date) >= WEEKEND_FROM).cast("tinyint")


def lead_time_days(delivery: Column, created: Column) -> Column:
    return F.datediff(delivery, created)


def next_day(created: Column) -> Column:
    """Default delivery date: the day after the order."""
    return F.date_add(created, 1)


def order_hour(hhmmss: Column) -> Column:
    """Hour of an HHMMSS integer, rounded down also below zero."""
    return F.floor(hhmmss / 10000).cast("bigint")


def order_hour_from_text(text: Column) -> Column:
    """First two characters as a number; null when they are not one."""
    return F.substring(text, 1, 2).try_cast("int")


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
