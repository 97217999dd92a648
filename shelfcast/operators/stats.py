"""Statistics of labelled order lines, one table per key.

All are two-step hash aggregations. With an exact distinct count Spark first
groups by (key, order_number), so even a key that holds a third of the rows is
spread over the cluster before its partial results meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LABEL, SLICE_ROWS
from ..storage import materialize_all, side_by_side
from .joins import ROWS


def _rate(name: str) -> Column:
    return F.avg(LABEL).alias(name)


def _orders(name: str) -> Column:
    return F.count_distinct("order_number").alias(name)


def _by(df: DataFrame, keys, *aggregates: Column, weights: bool) -> DataFrame:
    extra = [F.count("*").alias(ROWS)] if weights else []
    return df.groupBy(*keys).agg(*aggregates, *extra)


def product_stats(lines: DataFrame, delivered: bool = True, weights: bool = False) -> DataFrame:
    extra = [F.avg("delivered_qty").alias("product_avg_delivered_qty")] if delivered else []
    return _by(
        lines,
        ["product_code"],
        _rate("product_shortage_rate"),
        F.avg("order_qty").alias("product_avg_order_qty"),
        F.stddev_samp("order_qty").alias("product_order_qty_std"),
        *extra,
        _orders("product_order_count"),
        weights=weights,
    )


def category_stats(lines: DataFrame, weights: bool = False) -> DataFrame:
    return _by(lines, ["category"], _rate("category_shortage_rate"), weights=weights)


def temperature_stats(lines: DataFrame, weights: bool = False) -> DataFrame:
    return _by(
        lines, ["temperatureCondition"], _rate("temp_condition_shortage_rate"), weights=weights
    )


def customer_stats(lines: DataFrame, weights: bool = False) -> DataFrame:
    return _by(
        lines,
        ["customer_number"],
        _rate("customer_shortage_rate"),
        F.sum("order_qty").alias("customer_total_order_qty"),
        _orders("customer_order_count"),
        F.avg("lead_time_days").alias("customer_avg_lead_time"),
        weights=weights,
    )


def customer_product_stats(lines: DataFrame, weights: bool = False) -> DataFrame:
    return _by(
        lines,
        ["customer_number", "product_code"],
        _rate("customer_product_shortage_rate"),
        _orders("customer_product_order_count"),
        weights=weights,
    )


def vendor_stats(lines: DataFrame, weights: bool = False) -> DataFrame:
    return _by(
        lines,
        ["vendorName"],
        _rate("vendor_shortage_rate"),
        _orders("vendor_order_count"),
        weights=weights,
    )


def plant_stats(lines: DataFrame, orders: bool = True, weights: bool = False) -> DataFrame:
    extra = [_orders("plant_order_count")] if orders else []
    return _by(lines, ["plant"], _rate("plant_shortage_rate"), *extra, weights=weights)


def storage_stats(lines: DataFrame, weights: bool = False) -> DataFrame:
    return _by(lines, ["storage_location"], _rate("storage_shortage_rate"), weights=weights)


def replacement_counts(rows: DataFrame) -> DataFrame:
    """Rows per product; on sales rows instead of replacements it is the older variant."""
    return rows.groupBy(F.col("product_code").cast("string").alias("product_code")).agg(
        F.count("*").alias("replacement_frequency")
    )


#: Statistics by product. An order's lines differ in their products, so they are not folded before the first of the two
#: shuffles of an exact distinct count; without a hot key one shuffle, by key, does.
_PRODUCT_KEYS = {"product": ["product_code"], "customer_product": ["customer_number", "product_code"]}


def _no_hot_product(lines: DataFrame) -> bool:
    """Whether no product, and so no pair with one, has more than ``SLICE_ROWS`` lines."""
    if "product_code" not in lines.columns:
        return False
    return (lines.groupBy("product_code").agg(F.count("*").alias(ROWS)).agg(F.max(ROWS)).first()[0] or 0) <= SLICE_ROWS


def training_stats(lines: DataFrame) -> dict[str, DataFrame]:
    """Every table the training features need, with row counts as join weights."""
    builders = {
        "product": ("product_code", product_stats),
        "category": ("category", category_stats),
        "temperature": ("temperatureCondition", temperature_stats),
        "customer": ("customer_number", customer_stats),
        "customer_product": ("product_code", customer_product_stats),
        "vendor": ("vendorName", vendor_stats),
        "plant": ("plant", plant_stats),
        "storage": ("storage_location", storage_stats),
    }
    by_product = _no_hot_product(lines)
    return {
        name: build(lines.repartition(*_PRODUCT_KEYS[name]) if by_product and name in _PRODUCT_KEYS else lines, weights=True)
        for name, (key, build) in builders.items()
        if key in lines.columns
    }


def serving_stats(lines: DataFrame) -> dict[str, DataFrame]:
    """The statistics bundle that scoring of new orders reads."""
    return {
        "product": product_stats(lines, delivered=False),
        "customer": customer_stats(lines),
        "customer_product": customer_product_stats(lines),
        "plant": plant_stats(lines, orders=False),
        "storage": storage_stats(lines),
        "category": category_stats(lines),
        "temperature": temperature_stats(lines),
        "vendor": vendor_stats(lines),
    }


def stored(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Compute the tables once and keep them, for joins and for serving."""
    return materialize_all(tables)


def save_stats(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


#: Rows that a bucket of a stored table is planned for at most.
ROWS_OF_A_BUCKET = 250_000
#: Keys of the tables of a bundle.
BUNDLE_KEYS = {
    "product": ["product_code"], "customer": ["customer_number"], "customer_product": ["customer_number", "product_code"],
    "plant": ["plant"], "storage": ["storage_location"], "category": ["category"], "temperature": ["temperatureCondition"],
    "vendor": ["vendorName"],
}


def save_bucketed_stats(
    tables: dict[str, DataFrame], path: str, prefix: str, buckets: int, rows_per_bucket: int = ROWS_OF_A_BUCKET
) -> None:
    """Save tables as ``prefix_name``, their rows bucketed and sorted by key, with files under ``path``.

    Orders that are joined to such a table are shuffled; the table is not. A join then has as
    many tasks as the table has buckets: ``buckets``, or more where a table's rows ask for more.
    Rows are counted, from file footers if the tables are stored.
    """

    def save(name: str, df: DataFrame) -> None:
        keys = BUNDLE_KEYS[name]
        n = max(buckets, -(-df.count() // rows_per_bucket))
        # one file for each bucket
        rows = df.repartition(n, *keys).write.mode("overwrite").option("path", f"{path}/{name}")
        rows.bucketBy(n, *keys).sortBy(*keys).saveAsTable(f"{prefix}_{name}")

    side_by_side(save, tables)


def load_bucketed_stats(spark, prefix: str, names=tuple(BUNDLE_KEYS)) -> dict[str, DataFrame]:
    return {name: spark.table(f"{prefix}_{name}") for name in names}


def load_stats(spark, path: str) -> dict[str, DataFrame]:
    names = (
        "product", "customer", "customer_product", "plant", "storage",
        "category", "temperature", "vendor",
    )
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
