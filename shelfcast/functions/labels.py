"""Labels, bands and flags."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c


def shortage_label(ordered: Column, delivered: Column) -> Column:
    """1 when less was delivered than ordered, 0 otherwise, null when unknown."""
    short = (ordered > delivered) | ((delivered == 0) & (ordered > 0))
    return short.cast("tinyint")


def raw_shortage_flag(ordered: Column, delivered: Column) -> Column:
    """Boolean flag on uncleaned rows; a missing delivery leaves it null."""
    return ordered > delivered


def purchase_shortage_flag(ordered: Column, received: Column) -> Column:
    return ordered > received


def known(score: Column) -> Column:
    """A score with NaN read as null: Spark orders NaN above every number."""
    return F.nanvl(score.cast("double"), F.lit(None).cast("double"))


def risk_level(
    probability: Column,
    critical: float = c.CRITICAL_FROM,
    high: float = c.HIGH_FROM,
    medium: float = c.MEDIUM_FROM,
) -> Column:
    """Risk band of a probability; an unknown one counts as low."""
    p = known(probability)
    return (
        F.when(p >= critical, c.CRITICAL)
        .when(p >= high, c.HIGH)
        .when(p >= medium, c.MEDIUM)
        .otherwise(c.LOW)
    )


def recommended_action(substitutes: Column, labels: tuple[str, str] = c.ACTION_LABELS) -> Column:
    offer, notify = labels
    return F.when(F.size(substitutes) > 0, offer).otherwise(notify)


def verdict(probability: Column, threshold: float = c.VERDICT_FROM) -> Column:
    """Two-way answer for a single order or product."""
    return F.when(known(probability) >= threshold, "high").otherwise("low")
