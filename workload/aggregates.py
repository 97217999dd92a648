"""Aggregations (A1 – A23) and the exploration profile (F12)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import metrics, profile, states
from shelfcast.operators import stats as st
from shelfcast.operators.cleaning import CleaningReport, clean_orders, clean_orders_with_products, fill_quantities, join_products, parse_dates
from shelfcast.operators.dispatch import risk_summary
from shelfcast.operators.orders import category_members, matched_products, value_counts
from shelfcast.operators.serving import modal_context
from shelfcast.operators.split import split_summary, time_split
from shelfcast.operators.joins import ROWS
from shelfcast.storage import fresh_path, materialize

from . import shared
from .registry import query, rounded
from .tables import view


@query(
    "a1_product_stats",
    """SELECT product_code, round(product_shortage_rate, 6) AS product_shortage_rate,
       round(product_avg_order_qty, 6) AS product_avg_order_qty,
       round(product_order_qty_std, 4) AS product_order_qty_std,
       round(product_avg_delivered_qty, 6) AS product_avg_delivered_qty, product_order_count FROM product_stats""",
)
def a1(spark, d):
    return rounded(st.product_stats(shared.clean(spark, d)), product_order_qty_std=4)


@query(
    "a2_category_stats",
    "SELECT category, round(category_shortage_rate, 6) AS category_shortage_rate FROM category_stats",
)
def a2(spark, d):
    return rounded(st.category_stats(shared.enriched(spark, d)))


@query(
    "a3_temperature_stats",
    """SELECT temperatureCondition, round(temp_condition_shortage_rate, 6) AS temp_condition_shortage_rate
    FROM temperature_stats""",
)
def a3(spark, d):
    return rounded(st.temperature_stats(shared.enriched(spark, d)))


@query(
    "a4_customer_stats",
    """SELECT customer_number, round(customer_shortage_rate, 6) AS customer_shortage_rate,
       round(customer_total_order_qty, 6) AS customer_total_order_qty, customer_order_count,
       round(customer_avg_lead_time, 6) AS customer_avg_lead_time FROM customer_stats""",
)
def a4(spark, d):
    return rounded(st.customer_stats(shared.dated(spark, d)))


@query(
    "a5_customer_product_stats",
    """SELECT customer_number, product_code,
       round(customer_product_shortage_rate, 6) AS customer_product_shortage_rate, customer_product_order_count
    FROM customer_product_stats""",
)
def a5(spark, d):
    return rounded(st.customer_product_stats(shared.clean(spark, d)))


@query(
    "a6_vendor_stats",
    "SELECT vendorName, round(vendor_shortage_rate, 6) AS vendor_shortage_rate, vendor_order_count FROM vendor_stats",
)
def a6(spark, d):
    return rounded(st.vendor_stats(shared.enriched(spark, d)))


@query(
    "a7_plant_stats",
    "SELECT plant, round(plant_shortage_rate, 6) AS plant_shortage_rate, plant_order_count FROM plant_stats",
)
def a7(spark, d):
    return rounded(st.plant_stats(shared.clean(spark, d)))


@query(
    "a8_storage_stats",
    "SELECT storage_location, round(storage_shortage_rate, 6) AS storage_shortage_rate FROM storage_stats",
)
def a8(spark, d):
    return rounded(st.storage_stats(shared.clean(spark, d)))


@query("a9_replacement_counts", "SELECT * FROM replacement_counts")
def a9(spark, d):
    return st.replacement_counts(view(spark, d, "replacements"))


_BUNDLE = {
    "product": ("product_stats", "product_code", "product_shortage_rate", "product_order_count"),
    "customer": ("customer_stats", "CAST(customer_number AS VARCHAR)", "customer_shortage_rate", "customer_order_count"),
    "customer_product": (
        "customer_product_stats", "CAST(customer_number AS VARCHAR) || '/' || product_code",
        "customer_product_shortage_rate", "customer_product_order_count",
    ),
    "plant": ("plant_stats", "plant", "plant_shortage_rate", None),
    "storage": ("storage_stats", "storage_location", "storage_shortage_rate", None),
    "category": ("category_stats", "category", "category_shortage_rate", None),
    "temperature": ("temperature_stats", "temperatureCondition", "temp_condition_shortage_rate", None),
    "vendor": ("vendor_stats", "vendorName", "vendor_shortage_rate", "vendor_order_count"),
}


@query(
    "a10_serving_stats",
    " UNION ALL ".join(
        f"SELECT '{name}' AS bundle, {key} AS key, round({rate}, 6) AS rate, "
        f"CAST({orders or 'NULL'} AS BIGINT) AS orders FROM {table}"
        for name, (table, key, rate, orders) in _BUNDLE.items()
    ),
)
def a10(spark, d):
    """All eight tables of the bundle in one long form."""
    return _bundle(st.serving_stats(shared.stored_lines(spark, d)))


def _bundle(tables):
    keys = {
        "product": "product_code", "customer": "customer_number", "plant": "plant",
        "storage": "storage_location", "category": "category",
        "temperature": "temperatureCondition", "vendor": "vendorName",
    }
    parts = []
    for name, (_, _, rate, orders) in _BUNDLE.items():
        key = (
            F.concat_ws("/", F.col("customer_number").cast("string"), "product_code")
            if name == "customer_product"
            else F.col(keys[name]).cast("string")
        )
        parts.append(
            tables[name].select(
                F.lit(name).alias("bundle"), key.alias("key"), F.col(rate).alias("rate"),
                (F.col(orders) if orders else F.lit(None)).cast("bigint").alias("orders"),
            )
        )
    return rounded(reduce(DataFrame.unionByName, parts))


_LATER_FROM = 1997


def _continued(spark, d, *names):
    """Statistics after history was stored, later years were added, and the last one came once more."""
    lines = shared.stored_lines(spark, d, without=("picking_confirmed_date", "picking_picked_qty", "salesUnit"))
    path, year = fresh_path(spark, "states"), F.year("order_created_date")
    old = F.coalesce(year < _LATER_FROM, F.lit(True))
    states.store_states(states.line_states(lines.where(old), year, names=names), path)
    states.store_states(states.line_states(lines.where(~old), year, names=names), path)
    return states.continued_stats(path, lines.where(year >= 1998), year, names=names)


@query("a10_continued_stats", like="a10_serving_stats")
def a10_continued(spark, d):
    return _bundle(_continued(spark, d, *_BUNDLE))


@query("a1_continued_product_stats", like="a1_product_stats")
def a1_continued(spark, d):
    return rounded(_continued(spark, d, "product")["product"].drop(ROWS), product_order_qty_std=4)


@query("a4_continued_customer_stats", like="a4_customer_stats")
def a4_continued(spark, d):
    return rounded(_continued(spark, d, "customer")["customer"].drop(ROWS))


@query(
    "a11_sales_row_counts",
    """SELECT CAST(product_code AS VARCHAR) AS product_code, CAST(count(*) AS BIGINT) AS replacement_frequency
    FROM clean GROUP BY 1""",
)
def a11(spark, d):
    return st.replacement_counts(shared.clean(spark, d))


@query(
    "a12_shortage_totals",
    """SELECT CAST(sum(is_shortage) AS BIGINT) AS shortages, CAST(count(*) AS BIGINT) AS order_lines,
       round(sum(is_shortage) * 100.0 / count(*), 6) AS shortage_pct FROM clean""",
)
def a12(spark, d):
    return rounded(metrics.shortage_totals(shared.clean(spark, d)))


@query(
    "a13_class_balance",
    """SELECT round(r, 6) AS shortage_rate, round(1 - r, 6) AS non_shortage_rate,
       round((1 - r) / r, 6) AS imbalance_ratio FROM (SELECT avg(is_shortage) AS r FROM clean)""",
)
def a13(spark, d):
    return rounded(metrics.class_balance(shared.clean(spark, d)))


@query(
    "a14_raw_rates",
    """SELECT round(avg(CAST(order_qty > delivered_qty AS INTEGER)) * 100, 6) AS shortage_pct,
       round(avg(CAST(delivered_qty IS NULL AS INTEGER)) * 100, 6) AS null_delivery_pct FROM sales""",
)
def a14(spark, d):
    return rounded(profile.raw_rates(view(spark, d, "sales")))


@query(
    "a14_purchase_rate",
    """SELECT round(avg(CAST(ordered_qty > received_qty AS INTEGER)) * 100, 6) AS purchase_shortage_pct
    FROM purchases""",
)
def a14_purchases(spark, d):
    return rounded(profile.purchase_rate(view(spark, d, "purchases")))


_SALES = (
    "order_number", "order_created_date", "order_created_time", "requested_delivery_date",
    "picking_confirmed_date", "customer_number", "product_code", "order_qty", "delivered_qty",
    "picking_picked_qty", "plant", "storage_location",
)


@query(
    "a15_null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM sales" for c in _SALES
    ),
)
def a15(spark, d):
    return profile.null_counts(view(spark, d, "sales"))


@query(
    "a16_distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS BIGINT)"
        f" AS distinct_values FROM sales"
        for c in ("order_number", "customer_number", "product_code", "plant")
    ),
)
def a16(spark, d):
    columns = ["order_number", "customer_number", "product_code", "plant"]
    return profile.distinct_counts(view(spark, d, "sales"), columns)


@query(
    "a17_vendor_counts",
    """SELECT vendorName, CAST(count(*) AS BIGINT) AS count FROM products GROUP BY 1
    ORDER BY count DESC, vendorName NULLS FIRST LIMIT 10""",
)
def a17_vendor(spark, d):
    return value_counts(view(spark, d, "products"), "vendorName")


@query(
    "a17_category_counts",
    """SELECT category, CAST(count(*) AS BIGINT) AS count FROM products GROUP BY 1
    ORDER BY count DESC, category NULLS FIRST LIMIT 10""",
)
def a17_category(spark, d):
    return value_counts(view(spark, d, "products"), "category")


@query(
    "a18_risk_summary",
    """SELECT l.level_order, l.risk_level, CAST(count(p.risk_level) AS BIGINT) AS orders,
       round(count(p.risk_level) * 100.0 / (SELECT count(*) FROM predictions), 6) AS pct
    FROM (VALUES (1, '🔴 CRITICAL'), (2, '🟡 HIGH'), (3, '🟠 MEDIUM'), (4, '🟢 LOW')) AS l(level_order, risk_level)
    LEFT JOIN predictions p ON l.risk_level = p.risk_level GROUP BY 1, 2""",
)
def a18(spark, d):
    return rounded(risk_summary(shared.predictions(spark, d)))


SPLIT_COLUMNS = (
    "order_created_date", "order_number", "product_code", "customer_number", "order_qty",
    "delivered_qty", "is_shortage",
)
SPLIT_SQL = f"""SELECT *, CASE WHEN rn <= floor(total * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM (
    SELECT {', '.join(SPLIT_COLUMNS)}, row_number() OVER (ORDER BY
      {', '.join(c + ' NULLS FIRST' for c in SPLIT_COLUMNS)}) AS rn, count(*) OVER () AS total FROM clean)"""


def split_lines(spark, d):
    lines = materialize(shared.clean(spark, d).select(*SPLIT_COLUMNS), "lines")
    return time_split(lines)


@query(
    "a19_split_summary",
    f"""SELECT split, CAST(count(*) AS BIGINT) AS n, min(order_created_date) AS first_date,
       max(order_created_date) AS last_date, round(avg(is_shortage), 6) AS shortage_rate
    FROM ({SPLIT_SQL}) GROUP BY split""",
)
def a19(spark, d):
    return rounded(split_summary(split_lines(spark, d)))


@query(
    "a20_most_frequent",
    """SELECT (SELECT customer_number FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS customer_number,
       (SELECT plant FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS plant,
       (SELECT storage_location FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS storage_location""",
)
def a20(spark, d):
    return modal_context(shared.clean(spark, d))


@query(
    "a21_category_members",
    """SELECT category, salesUnitGtin AS product_code, CAST(count(*) AS BIGINT) AS listings FROM products
    GROUP BY 1, 2""",
)
def a21(spark, d):
    products = view(spark, d, "products").withColumnRenamed("salesUnitGtin", "product_code")
    return category_members(products)


@query(
    "a22_placeholder_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(CASE WHEN {c} = '1970-01-01' THEN 1 END) AS BIGINT) AS placeholders"
        f" FROM sales"
        for c in ("order_created_date", "requested_delivery_date", "picking_confirmed_date")
    ),
)
def a22_placeholders(spark, d):
    return profile.placeholder_counts(view(spark, d, "sales"))


@query(
    "a22_duplicates",
    """SELECT CAST((SELECT count(*) FROM sales) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS distinct_rows,
       CAST((SELECT count(*) FROM sales) - count(*) AS BIGINT) AS removed FROM (SELECT DISTINCT * FROM sales)""",
)
def a22_duplicates(spark, d):
    return profile.duplicate_counts(fill_quantities(parse_dates(view(spark, d, "sales"))))


@query(
    "a22_cleaning_report",
    """WITH joined AS (SELECT c.order_number, p.code FROM clean c LEFT JOIN (
        SELECT DISTINCT salesUnitGtin AS code, coalesce(vendorName, 'UNKNOWN'), coalesce(category, 'UNKNOWN'), coalesce(temperatureCondition, 'UNKNOWN'), salesUnit
        FROM products) p ON c.product_code = p.code)
    SELECT metric, CAST(value AS BIGINT) AS value FROM (
      SELECT 'rows' AS metric, count(*) AS value FROM sales
      UNION ALL SELECT 'placeholders:order_created_date', count(*) FROM sales WHERE TRY_CAST(order_created_date AS DATE) = DATE '1970-01-01'
      UNION ALL SELECT 'placeholders:requested_delivery_date', count(*) FROM sales WHERE TRY_CAST(requested_delivery_date AS DATE) = DATE '1970-01-01'
      UNION ALL SELECT 'placeholders:picking_confirmed_date', count(*) FROM sales WHERE TRY_CAST(picking_confirmed_date AS DATE) = DATE '1970-01-01'
      UNION ALL SELECT 'distinct_rows', count(*) FROM clean
      UNION ALL SELECT 'joined_rows', count(*) FROM joined
      UNION ALL SELECT 'matched_rows', count(code) FROM joined
      UNION ALL SELECT 'duplicates', (SELECT count(*) FROM sales) - (SELECT count(*) FROM clean)
      UNION ALL SELECT 'added_by_master', (SELECT count(*) FROM joined) - (SELECT count(*) FROM clean))""",
)
def a22_report(spark, d):
    """What cleaning did, counted while the cleaned table was written."""
    report = CleaningReport()
    materialize(clean_orders_with_products(view(spark, d, "sales"), view(spark, d, "products"), report), "clean")
    return report.table(spark)


@query(
    "a22_matched_products",
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(p.vendorName) AS BIGINT) AS matched,
       round(count(p.vendorName) * 100.0 / count(*), 6) AS matched_pct
    FROM clean c LEFT JOIN products p ON c.product_code = p.salesUnitGtin""",
)
def a22_matched(spark, d):
    lines = clean_orders(view(spark, d, "sales")).select("order_number", "product_code")
    return rounded(matched_products(join_products(lines, view(spark, d, "products"))))


@query(
    "a23_positive_weight",
    """SELECT CAST(sum(1 - is_shortage) AS BIGINT) AS negatives, CAST(sum(is_shortage) AS BIGINT) AS positives,
       round(sum(1 - is_shortage) / sum(is_shortage), 6) AS pos_weight FROM judged""",
)
def a23(spark, d):
    return rounded(metrics.positive_weight(shared.judged(spark, d)))


def _profile_sql() -> str:
    parts = [
        f"SELECT 'sales' AS \"table\", 'nulls:{c}' AS metric, CAST(count(*) - count({c}) AS DOUBLE) AS value FROM sales"
        for c in _SALES
    ]
    for table, columns in (
        ("sales", ("order_number", "customer_number", "product_code")),
        ("purchases", ("order_number", "product_code")),
        ("products", ("salesUnitGtin",)),
        ("replacements", ("order_number", "product_code")),
    ):
        parts += [
            f"SELECT '{table}', 'distinct:{c}', CAST(count(DISTINCT {c}) AS DOUBLE) FROM {table}" for c in columns
        ]
    parts += [
        "SELECT 'sales', 'shortage_pct', round(avg(CAST(order_qty > delivered_qty AS INTEGER)) * 100, 6) FROM sales",
        "SELECT 'sales', 'null_delivery_pct', round(avg(CAST(delivered_qty IS NULL AS INTEGER)) * 100, 6) FROM sales",
        "SELECT 'purchases', 'purchase_shortage_pct', "
        "round(avg(CAST(ordered_qty > received_qty AS INTEGER)) * 100, 6) FROM purchases",
        "SELECT 'purchases', 'orders_in_sales', CAST(count(DISTINCT order_number) AS DOUBLE) FROM purchases "
        "WHERE order_number IN (SELECT order_number FROM sales)",
        "SELECT 'sales', 'products_in_master', CAST(count(DISTINCT product_code) AS DOUBLE) FROM sales "
        "WHERE CAST(product_code AS VARCHAR) IN (SELECT salesUnitGtin FROM products)",
        "SELECT 'replacements', 'rows', CAST(count(*) AS DOUBLE) FROM replacements",
    ]
    for column in ("vendorName", "category"):
        parts.append(
            f"SELECT 'products', 'top_{column}:' || coalesce({column}, 'null'), CAST(n AS DOUBLE) FROM ("
            f"SELECT {column}, count(*) AS n FROM products GROUP BY 1 ORDER BY n DESC, {column} NULLS FIRST LIMIT 10)"
        )
    return " UNION ALL ".join(parts)


@query("f12_profile", _profile_sql())
def f12(spark, d):
    names = ("sales", "purchases", "products", "replacements")
    return rounded(profile.stored_profile(*[view(spark, d, n) for n in names]))
