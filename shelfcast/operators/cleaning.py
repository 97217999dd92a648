"""Cleaning of order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DATE_COLUMNS, DEFAULT_ORDER_TIME, LABEL, PLACEHOLDER_DATE, UNKNOWN
from ..functions.dates import next_day, parse_date, without_placeholder
from ..functions.labels import shortage_label
from .joins import attach

MASTER_COLUMNS = ("vendorName", "category", "temperatureCondition")


def parse_dates(df: DataFrame) -> DataFrame:
    """Text dates to dates, leniently, for the date columns that exist."""
    present = [c for c in DATE_COLUMNS if c in df.columns]
    return df.withColumns({c: parse_date(F.col(c).cast("string")) for c in present})


def drop_placeholder_dates(df: DataFrame) -> DataFrame:
    present = [c for c in DATE_COLUMNS if c in df.columns]
    return df.withColumns({c: without_placeholder(F.col(c)) for c in present})


def fill_quantities(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return df.withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("delivered_qty", "picking_picked_qty") if c in df.columns}
    )


def add_label(df: DataFrame) -> DataFrame:
    return df.withColumn(LABEL, shortage_label(F.col("order_qty"), F.col("delivered_qty")))


def add_unknown_master(df: DataFrame) -> DataFrame:
    """Literal product attributes for order lines without a product master."""
    return df.withColumns({c: F.lit(UNKNOWN) for c in MASTER_COLUMNS})


def fill_unknown(df: DataFrame, columns=("storage_location", "plant")) -> DataFrame:
    """Categorical nulls become ``UNKNOWN``; the columns become text."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in columns if c in df.columns}
    )


def text_product_code(df: DataFrame) -> DataFrame:
    return df.withColumn("product_code", F.col("product_code").cast("string"))


def clean_orders(sales: DataFrame) -> DataFrame:
    """Clean, labelled, distinct order lines.

    Copies are folded inside each map task before anything is shuffled. Columns
    that follow from others are added afterwards, to keep the compared row short.
    """
    return add_unknown_master(add_label(_distinct_lines(sales)))


class CleaningReport:
    """Counts that are taken while the rows pass through cleaning, without jobs of their own.

    They are there once the cleaned table was written or otherwise run in full, once. Tasks
    that are repeated after a failure may count twice, so the figures are for a report, not
    for decisions.
    """

    def __init__(self):
        self._observed: list[Observation] = []

    def watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        observation = Observation()
        self._observed.append(observation)
        return df.observe(observation, *[c.alias(name) for name, c in counts.items()])

    def counts(self) -> dict[str, int]:
        """All counts; waits for the run of the cleaned table."""
        return {name: n or 0 for o in self._observed for name, n in o.get.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """``metric``, ``value``: the counts and what follows from them."""
        n = self.counts()
        derived = {"duplicates": n["rows"] - n["distinct_rows"]}
        if "joined_rows" in n:
            derived["added_by_master"] = n["joined_rows"] - n["distinct_rows"]
        rows = [(name, int(value)) for name, value in {**n, **derived}.items()]
        return spark.createDataFrame(rows, "metric string, value bigint")


def _distinct_lines(sales: DataFrame, report: CleaningReport | None = None) -> DataFrame:
    parsed = parse_dates(sales)
    if report is not None:
        present = [c for c in DATE_COLUMNS if c in sales.columns]
        placeholders = {f"placeholders:{c}": F.count_if(F.col(c) == F.lit(PLACEHOLDER_DATE).cast("date")) for c in present}
        parsed = report.watch(parsed, rows=F.count("*"), **placeholders)
    df = fill_unknown(fill_quantities(drop_placeholder_dates(parsed))).dropDuplicates()
    if report is not None:
        df = report.watch(df, distinct_rows=F.count("*"))
    return text_product_code(df)


def product_master(products: DataFrame) -> DataFrame:
    """Product master keyed by textual ``product_code``."""
    return text_product_code(products.withColumnRenamed("salesUnitGtin", "product_code"))


def join_products(lines: DataFrame, products: DataFrame, **bounds) -> DataFrame:
    """Order lines with their product attributes.

    A code listed several times in the master multiplies its lines. A master that
    is measured to be small is broadcast, so the lines are not shuffled; beyond
    that hot codes are salted. ``bounds`` are those of ``attach``.
    """
    codes = text_product_code(lines.select("product_code"))
    return attach(
        text_product_code(lines), product_master(products), ["product_code"], count_from=codes, **bounds
    )


def clean_orders_with_products(
    sales: DataFrame, products: DataFrame, report: CleaningReport | None = None, codes: DataFrame | None = None, **bounds
) -> DataFrame:
    """As ``clean_orders`` but with real product attributes; ``report`` counts rows on the way.

    Hot product codes are looked for in ``codes``, if a table with the product codes of the lines
    is cheaper to read than ``sales``; more of its rows than those of ``sales`` do no harm.

    Copies are folded on both sides before the join, which keeps them out of its
    shuffle. Distinct lines joined to distinct master rows are distinct, so the
    result is the same as removing duplicates afterwards.
    """
    df = add_label(_distinct_lines(sales, report))
    master = fill_unknown(product_master(products), MASTER_COLUMNS).dropDuplicates()
    counted = (sales if codes is None else codes).select("product_code")
    joined = attach(df, master, ["product_code"], count_from=text_product_code(counted), **bounds)
    if report is not None:
        # attributes of the master are filled, so an empty one stands for no match
        matched = F.count(MASTER_COLUMNS[0])
        joined = report.watch(joined, joined_rows=F.count("*"), matched_rows=matched)
    return fill_unknown(joined, MASTER_COLUMNS)


def app_clean(sales: DataFrame) -> DataFrame:
    """The interactive variant: dates come parsed, picked quantity stays null.

    Delivery date defaults to the day after the order, the lead time is added and
    duplicates are kept.
    """
    df = text_product_code(sales).withColumn("delivered_qty", F.coalesce("delivered_qty", F.lit(0.0)))
    df = add_unknown_master(add_label(df))
    if "requested_delivery_date" not in df.columns:
        df = df.withColumn("requested_delivery_date", next_day(F.col("order_created_date")))
    return df.withColumn(
        "lead_time_days", F.datediff("requested_delivery_date", "order_created_date")
    )


def select_existing(df: DataFrame, columns) -> DataFrame:
    """The listed columns that exist, in list order. Reads the schema only."""
    return df.select(*[c for c in columns if c in df.columns])


def drop_null_rows(df: DataFrame, columns) -> DataFrame:
    """Rows without a null in ``columns``; NaN is a value and stays."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull()
    return df.where(keep)


def with_order_defaults(orders: DataFrame) -> DataFrame:
    """Columns an incoming order may lack."""
    extra = {}
    if "order_created_time" not in orders.columns:
        extra["order_created_time"] = F.lit(DEFAULT_ORDER_TIME).cast("bigint")
    if "requested_delivery_date" not in orders.columns:
        extra["requested_delivery_date"] = next_day(F.col("order_created_date"))
    return orders.withColumns(extra) if extra else orders
