"""Risk bands, actions and their substitutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions.labels import recommended_action, risk_level
from ..functions.text import joined_substitutes
from .joins import attach

SORTED = ("order_number", "product_code", "customer_number", "order_qty")


def with_risk_level(scored: DataFrame) -> DataFrame:
    return scored.withColumn("risk_level", risk_level(F.col("shortage_probability")))


def risk_levels(spark: SparkSession) -> DataFrame:
    """The four levels as a literal table, in order of urgency."""
    return spark.createDataFrame(
        list(enumerate(c.RISK_LEVELS, 1)), "level_order INT, risk_level STRING"
    )


def risk_summary(predictions: DataFrame) -> DataFrame:
    """Orders and percentage per risk level; absent levels show 0."""
    counts = predictions.groupBy("risk_level").agg(F.count("*").alias("_n"))
    levels = risk_levels(predictions.sparkSession)
    orders = F.coalesce(F.col("_n"), F.lit(0).cast("bigint"))
    total = F.sum(orders).over(Window.partitionBy())  # over the four level rows
    return levels.join(counts, "risk_level", "left").select(
        "level_order", "risk_level", orders.alias("orders"),
        (orders * 100.0 / F.nullif(total, F.lit(0))).alias("pct"),
    )


def high_priority(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("risk_level").isin(c.CRITICAL, c.HIGH))


def _with_substitutes(rows: DataFrame, substitutes: DataFrame, limit: int, slice_rows: int) -> DataFrame:
    joined = attach(rows, substitutes, ["product_code"], max_broadcast_rows=limit, slice_rows=slice_rows)
    empty = F.array().cast("array<string>")
    return joined.withColumn("substitutes", F.coalesce("substitutes", empty))


def _urgent_first(actions: DataFrame) -> DataFrame:
    return actions.orderBy(F.col("shortage_probability").desc_nulls_first(), *SORTED)


def actions(
    predictions: DataFrame,
    substitutes: DataFrame,
    labels: tuple[str, str] = c.ACTION_LABELS,
    max_broadcast_rows: int = c.MAX_BROADCAST_ROWS,
    slice_rows: int = c.SLICE_ROWS,
) -> DataFrame:
    """One action per high-risk order line, most urgent first.

    ``substitutes`` maps a product to its list; up to three go to columns of their
    own. No high-risk line means an empty result.
    """
    rows = _with_substitutes(high_priority(predictions), substitutes, max_broadcast_rows, slice_rows)
    subs = F.col("substitutes")
    picked = rows.select(
        "order_number", "risk_level", "product_code", "customer_number", "order_qty",
        "shortage_probability",
        recommended_action(subs, labels).alias("recommended_action"),
        *[F.get(subs, F.lit(i)).alias(f"substitute_{i + 1}") for i in range(3)],
    )
    return _urgent_first(picked)


def short_actions(
    predictions: DataFrame,
    substitutes: DataFrame,
    labels: tuple[str, str] = c.SHORT_ACTION_LABELS,
    max_broadcast_rows: int = c.MAX_BROADCAST_ROWS,
    slice_rows: int = c.SLICE_ROWS,
) -> DataFrame:
    """The interactive variant: substitutes as one text, shorter labels."""
    rows = _with_substitutes(high_priority(predictions), substitutes, max_broadcast_rows, slice_rows)
    subs = F.col("substitutes")
    picked = rows.select(
        "order_number", "risk_level", "product_code", "customer_number", "order_qty",
        "shortage_probability",
        recommended_action(subs, labels).alias("recommended_action"),
        joined_substitutes(subs).alias("substitutes"),
    )
    return _urgent_first(picked)


def dispatch(
    scored: DataFrame,
    substitutes: DataFrame,
    labels: tuple[str, str] = c.ACTION_LABELS,
    max_broadcast_rows: int = c.MAX_BROADCAST_ROWS,
    slice_rows: int = c.SLICE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(predictions with risk level, actions)."""
    predictions = with_risk_level(scored)
    return predictions, actions(predictions, substitutes, labels, max_broadcast_rows, slice_rows)
