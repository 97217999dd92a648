"""Data exploration: null counts, distinct counts, rates and overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DATE_COLUMNS
from ..functions.labels import purchase_shortage_flag, raw_shortage_flag
from ..storage import materialize
from .cleaning import parse_dates
from .orders import key_overlap, value_counts


def _long(row: DataFrame, name: str, value: str, kind: str) -> DataFrame:
    """One row of measures turned into (name, value) rows."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast(kind).alias(value)) for c in row.columns]
    )
    return row.select(F.inline(pairs))


def _nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def _distinct(column: str) -> Column:
    """Distinct values, the empty one counted as a value."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))


def _percent(flag: Column) -> Column:
    """Share of true among the known flags."""
    return F.avg(flag.cast("int")) * 100


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for all columns from one pass."""
    return _long(df.agg(*[_nulls(c).alias(c) for c in df.columns]), "column", "nulls", "bigint")


def distinct_counts(df: DataFrame, columns) -> DataFrame:
    return _long(
        df.agg(*[F.coalesce(_distinct(c), F.lit(0)).alias(c) for c in columns]),
        "column", "distinct_values", "bigint",
    )


def raw_rates(sales: DataFrame) -> DataFrame:
    """Shortage and missing-delivery percentage of uncleaned lines."""
    short = raw_shortage_flag(F.col("order_qty"), F.col("delivered_qty"))
    return sales.agg(
        _percent(short).alias("shortage_pct"),
        _percent(F.col("delivered_qty").isNull()).alias("null_delivery_pct"),
    )


def purchase_rate(purchases: DataFrame) -> DataFrame:
    short = purchase_shortage_flag(F.col("ordered_qty"), F.col("received_qty"))
    return purchases.agg(_percent(short).alias("purchase_shortage_pct"))


def placeholder_counts(sales: DataFrame) -> DataFrame:
    """Placeholder dates per date column."""
    parsed = parse_dates(sales)
    hits = [F.count_if(F.col(c) == F.lit("1970-01-01").cast("date")).alias(c) for c in DATE_COLUMNS]
    return _long(parsed.agg(*hits), "column", "placeholders", "bigint")


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and removed duplicates.

    Copies are counted, not listed: rows fold into (row, copies) before the
    shuffle, and only two sums leave the tasks.
    """
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("removed"),
    )


def _tagged(long: DataFrame, table: str, prefix: str) -> DataFrame:
    name, value = long.columns
    return long.select(
        F.lit(table).alias("table"),
        F.concat(F.lit(prefix), F.col(name)).alias("metric"),
        F.col(value).cast("double").alias("value"),
    )


def _top(df: DataFrame, table: str, column: str) -> DataFrame:
    counts = value_counts(df, column)
    label = F.concat(F.lit(f"top_{column}:"), F.coalesce(F.col(column), F.lit("null")))
    return counts.select(
        F.lit(table).alias("table"), label.alias("metric"), F.col("count").cast("double").alias("value")
    )


def profile(
    sales: DataFrame, purchases: DataFrame, products: DataFrame, replacements: DataFrame
) -> DataFrame:
    """All exploration figures as (table, metric, value) rows."""

    def overlap(table, left, left_key, right, right_key, name):
        row = key_overlap(left, left_key, right, right_key).select(F.col("overlap").alias(name))
        return _tagged(_long(row, "metric", "value", "double"), table, "")

    def measures(df):
        return _long(df, "metric", "value", "double")

    parts = [
        _tagged(null_counts(sales), "sales", "nulls:"),
        _tagged(
            distinct_counts(sales, ["order_number", "customer_number", "product_code"]),
            "sales", "distinct:",
        ),
        _tagged(measures(raw_rates(sales)), "sales", ""),
        _tagged(distinct_counts(purchases, ["order_number", "product_code"]), "purchases", "distinct:"),
        _tagged(measures(purchase_rate(purchases)), "purchases", ""),
        overlap("purchases", purchases, "order_number", sales, "order_number", "orders_in_sales"),
        _tagged(distinct_counts(products, ["salesUnitGtin"]), "products", "distinct:"),
        overlap("sales", sales, "product_code", products, "salesUnitGtin", "products_in_master"),
        _top(products, "products", "vendorName"),
        _top(products, "products", "category"),
        _tagged(
            measures(replacements.agg(F.count("*").alias("rows"))), "replacements", ""
        ),
        _tagged(
            distinct_counts(replacements, ["order_number", "product_code"]), "replacements", "distinct:"
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def stored_profile(*tables: DataFrame) -> DataFrame:
    """``profile`` over tables stored once, when reading them is costly."""
    return profile(*[materialize(t, "profiled") for t in tables])
