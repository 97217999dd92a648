"""Sorting, limits, top lists and overlaps (O1 – O10)."""

from pyspark.sql import functions as F

from shelfcast.operators import orders as od

from . import shared
from .aggregates import SPLIT_SQL, split_lines
from .registry import query, rounded
from .tables import view

_TIES = ["order_number", "product_code", "customer_number", "order_qty"]
_LINE = ["order_created_date", *_TIES, "delivered_qty", "plant", "storage_location"]


def _lines(spark, d):
    return shared.clean(spark, d).select(*_LINE)


@query(
    "o1_order_overlap",
    """SELECT CAST(count(*) FILTER (WHERE o IN (SELECT order_number FROM sales)) AS BIGINT) AS overlap,
       CAST(count(*) AS BIGINT) AS total FROM (SELECT DISTINCT order_number AS o FROM purchases)""",
)
def o1(spark, d):
    return od.key_overlap(
        view(spark, d, "purchases"), "order_number", view(spark, d, "sales"), "order_number"
    )


@query(
    "o2_product_overlap",
    """SELECT CAST(count(*) FILTER (WHERE p IN (SELECT salesUnitGtin FROM products)) AS BIGINT) AS overlap,
       CAST(count(*) AS BIGINT) AS total FROM (SELECT DISTINCT CAST(product_code AS VARCHAR) AS p FROM sales)""",
)
def o2(spark, d):
    return od.key_overlap(
        view(spark, d, "sales"), "product_code", view(spark, d, "products"), "salesUnitGtin"
    )


@query("o3_distinct_head", "SELECT DISTINCT product_code FROM sales ORDER BY product_code LIMIT 20")
def o3(spark, d):
    return od.distinct_head(view(spark, d, "sales"), "product_code", 20)


@query("o4_customer_domain", "SELECT DISTINCT customer_number FROM sales ORDER BY 1")
def o4_customers(spark, d):
    return od.domain(view(spark, d, "sales"), "customer_number")


@query("o4_product_domain", "SELECT DISTINCT CAST(product_code AS VARCHAR) AS product_code FROM sales ORDER BY 1")
def o4_products(spark, d):
    codes = view(spark, d, "sales").withColumn("product_code", F.col("product_code").cast("string"))
    return od.domain(codes, "product_code")


@query("o4_plant_domain", "SELECT DISTINCT plant FROM sales WHERE plant IS NOT NULL ORDER BY 1")
def o4_plants(spark, d):
    return od.domain(view(spark, d, "sales"), "plant", drop_nulls=True)


@query(
    "o4_storage_domain",
    "SELECT DISTINCT storage_location FROM sales WHERE storage_location IS NOT NULL ORDER BY 1",
)
def o4_storages(spark, d):
    return od.domain(view(spark, d, "sales"), "storage_location", drop_nulls=True)


@query(
    "o5_sort_by_date",
    f"SELECT {', '.join(_LINE)} FROM clean ORDER BY order_created_date NULLS FIRST",
)
def o5(spark, d):
    return od.by_date(_lines(spark, d))


@query(
    "o6_newest_orders",
    f"""SELECT {', '.join(_LINE)} FROM clean
    ORDER BY order_created_date DESC NULLS FIRST, {', '.join(c + ' NULLS FIRST' for c in _LINE[1:])} LIMIT 1000""",
)
def o6(spark, d):
    return od.newest(_lines(spark, d), 1000)


@query(
    "o7_first_after_date",
    f"""SELECT {', '.join(_LINE)} FROM clean WHERE order_created_date >= DATE '1999-03-01'
    ORDER BY order_created_date, {', '.join(c + ' NULLS FIRST' for c in _LINE[1:])} LIMIT 1000""",
)
def o7(spark, d):
    return od.first_from(_lines(spark, d), "1999-03-01", 1000)


@query(
    "o8_positional_cut",
    f"""SELECT split, order_created_date, CAST(count(*) AS BIGINT) AS n FROM ({SPLIT_SQL}) GROUP BY 1, 2""",
)
def o8(spark, d):
    return split_lines(spark, d).groupBy("split", "order_created_date").agg(F.count("*").alias("n"))


@query(
    "o9_top_predictions",
    """SELECT order_number, product_code, customer_number, order_qty,
       round(shortage_probability, 6) AS shortage_probability FROM predictions
    ORDER BY predictions.shortage_probability DESC, order_number, product_code, customer_number, order_qty LIMIT 10""",
)
def o9(spark, d):
    return rounded(od.top_predictions(shared.scored(spark, d).drop("delivered_qty"), 10, _TIES))


@query(
    "o10_top_critical",
    """SELECT order_number, product_code, customer_number, order_qty,
       round(shortage_probability, 6) AS shortage_probability FROM predictions WHERE risk_level = '🔴 CRITICAL'
    ORDER BY predictions.shortage_probability DESC, order_number, product_code, customer_number, order_qty LIMIT 1""",
)
def o10(spark, d):
    return rounded(od.top_critical(shared.scored(spark, d).drop("delivered_qty"), _TIES))
