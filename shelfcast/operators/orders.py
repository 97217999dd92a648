"""Domains, newest orders, top lists, lookups and overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALERT_FROM, CRITICAL, NOTIFIED, PENDING
from ..functions.labels import known, risk_level
from ..storage import materialize
from .joins import attach


def _descending_nulls_first(column: str):
    return F.col(column).desc_nulls_first()


def domain(df: DataFrame, column: str, drop_nulls: bool = False) -> DataFrame:
    """Sorted distinct values of a column."""
    values = df.select(column)
    if drop_nulls:
        values = values.where(F.col(column).isNotNull())
    return values.distinct().orderBy(column)


def distinct_head(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.select(column).distinct().orderBy(column).limit(n)


def by_date(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("order_created_date").asc_nulls_first())


def newest(df: DataFrame, n: int = 1000, ties: Sequence[str] | None = None) -> DataFrame:
    """The newest n rows, undated ones first; the other columns break ties."""
    ties = [c for c in (ties or df.columns) if c != "order_created_date"]
    return df.orderBy(_descending_nulls_first("order_created_date"), *ties).limit(n)


def first_from(df: DataFrame, since, n: int = 1000, until=None) -> DataFrame:
    """The first n rows dated ``since`` or later (up to ``until``), by date and columns."""
    day = F.col("order_created_date")
    kept = df.where(day >= F.lit(since).cast("date"))
    if until is not None:
        kept = kept.where(day <= F.lit(until).cast("date"))
    ties = [c for c in df.columns if c != "order_created_date"]
    return kept.orderBy("order_created_date", *ties).limit(n)


def top_predictions(scored: DataFrame, n: int = 10, ties: Sequence[str] | None = None) -> DataFrame:
    ties = [c for c in (ties or scored.columns) if c != "shortage_probability"]
    return scored.orderBy(F.col("shortage_probability").desc_nulls_first(), *ties).limit(n)


def top_critical(scored: DataFrame, ties: Sequence[str] | None = None) -> DataFrame:
    critical = scored.where(risk_level(F.col("shortage_probability")) == CRITICAL)
    return top_predictions(critical, 1, ties)


def high_risk(scored: DataFrame, threshold: float = ALERT_FROM) -> DataFrame:
    return scored.where(known(F.col("shortage_probability")) >= threshold).orderBy(
        F.col("shortage_probability").desc_nulls_first()
    )


def lookup_order(scored: DataFrame, order_number: int, product_code: str) -> DataFrame:
    return scored.where(
        (F.col("order_number") == order_number) & (F.col("product_code") == product_code)
    )


def key_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """How many distinct keys of ``left`` occur in ``right``, and how many there are.

    Keys are made distinct on both sides first, so no key weighs more than another.
    """
    wanted = left.select(F.col(left_key).cast("string").alias("k")).distinct()
    found = right.select(F.col(right_key).cast("string").alias("k")).distinct()
    flagged = wanted.join(found.withColumn("hit", F.lit(1)), wanted.k.eqNullSafe(found.k), "left")
    return flagged.agg(F.count("hit").alias("overlap"), F.count("*").alias("total"))


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values, the empty value included."""
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.col(column).asc_nulls_first()).limit(n)


def category_members(products: DataFrame) -> DataFrame:
    """Product codes per category as sorted rows, with the times each is listed.

    Rows instead of one list value per category: a category may hold a third of
    the master, and a list is a single value that no second task can share.
    """
    members = products.groupBy("category", F.col("product_code").cast("string").alias("product_code"))
    return members.agg(F.count("*").alias("listings")).orderBy(
        F.col("category").asc_nulls_first(), "product_code"
    )


def notified_status(actions: DataFrame, notified: DataFrame) -> DataFrame:
    """Whether the customer of each action was already notified."""
    # stored, as it is measured before it is joined
    done = materialize(notified.select("order_number").distinct().withColumn("_done", F.lit(True)), "notified")
    status = F.when(F.col("_done"), NOTIFIED).otherwise(PENDING)
    return attach(actions, done, ["order_number"]).withColumn("status", status).drop("_done")


def matched_products(joined: DataFrame) -> DataFrame:
    """Rows with product data and their share, before empty attributes are filled."""
    return joined.agg(
        F.count("*").alias("rows"),
        F.count("vendorName").alias("matched"),
        (F.count("vendorName") * 100.0 / F.count("*")).alias("matched_pct"),
    )
