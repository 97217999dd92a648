"""Joins (J1 – J8)."""

from pyspark.sql import functions as F

from shelfcast.operators import stats as st
from shelfcast.operators.cleaning import join_products, product_master
from shelfcast.operators.explain import feature_importance
from shelfcast.operators.features import replacement_feature
from shelfcast.operators.joins import ROWS, attach, which_fit
from shelfcast.operators.orders import notified_status
from shelfcast.operators.requests import look_up, parse_requests
from shelfcast.operators.substitutes import substitute_details, substitute_rows
from shelfcast.storage import materialize

from . import shared
from .registry import query, rounded
from .tables import view

_SINGLE = (
    ("product", ["product_code"]),
    ("category", ["category"]),
    ("temperature", ["temperatureCondition"]),
    ("customer", ["customer_number"]),
    ("vendor", ["vendorName"]),
    ("plant", ["plant"]),
    ("storage", ["storage_location"]),
)
#: Columns of the lines that no statistic and no result of ``j1`` reads.
_NOT_IN_STATS = ("salesUnit", "picking_picked_qty", "picking_confirmed_date")


@query(
    "j1_single_key_stats",
    """SELECT order_number, d.product_code, d.customer_number, order_qty,
       round(product_shortage_rate, 6) AS product_shortage_rate,
       round(product_order_qty_std, 4) AS product_order_qty_std,
       round(category_shortage_rate, 6) AS category_shortage_rate,
       round(temp_condition_shortage_rate, 6) AS temp_condition_shortage_rate,
       round(customer_shortage_rate, 6) AS customer_shortage_rate,
       round(customer_avg_lead_time, 6) AS customer_avg_lead_time,
       round(vendor_shortage_rate, 6) AS vendor_shortage_rate, plant_order_count,
       round(storage_shortage_rate, 6) AS storage_shortage_rate
    FROM features d""",
)
def j1(spark, d):
    lines = shared.stored_lines(spark, d, without=_NOT_IN_STATS)
    tables = st.training_stats(lines)
    # statistics of pairs are not joined here
    tables = st.stored({name: tables[name] for name, _ in _SINGLE})
    # tables that are broadcast come first: a rate is shorter than the text that it is looked up by, and the lines are shuffled afterwards
    small = which_fit(tables)
    for name, keys in sorted(_SINGLE, key=lambda s: not small[s[0]]):
        lines = attach(lines, tables[name], keys, weights=tables[name].select(*keys, ROWS), small=small[name])
    columns = [
        "order_number", "product_code", "customer_number", "order_qty", "product_shortage_rate",
        "product_order_qty_std", "category_shortage_rate", "temp_condition_shortage_rate",
        "customer_shortage_rate", "customer_avg_lead_time", "vendor_shortage_rate",
        "plant_order_count", "storage_shortage_rate",
    ]
    return rounded(lines.select(*columns), product_order_qty_std=4)


@query(
    "j2_pair_stats",
    """SELECT order_number, d.customer_number, d.product_code, order_qty,
       round(customer_product_shortage_rate, 6) AS customer_product_shortage_rate, customer_product_order_count
    FROM dated d LEFT JOIN customer_product_stats s
      ON d.customer_number = s.customer_number AND d.product_code = s.product_code""",
)
def j2(spark, d):
    lines = shared.stored_lines(spark, d)
    pairs = materialize(st.customer_product_stats(lines, weights=True), "pairs")
    keys = ["customer_number", "product_code"]
    joined = attach(lines, pairs, keys, weights=pairs.select(*keys, ROWS))
    return rounded(
        joined.select(
            "order_number", *keys, "order_qty", "customer_product_shortage_rate",
            "customer_product_order_count",
        )
    )


# Bounds under which no lookup is broadcast and every key with more than a few rows is salted.
FORCED = {"max_broadcast_rows": 0, "slice_rows": 20}


@query("j2_pair_stats_shuffled", like="j2_pair_stats")
def j2_shuffled(spark, d):
    lines = shared.stored_lines(spark, d)
    pairs = materialize(st.customer_product_stats(lines), "pairs")
    keys = ["customer_number", "product_code"]
    joined = attach(lines, pairs, keys, spread_by=["order_number"], **FORCED)
    return rounded(joined.select("order_number", *keys, "order_qty", "customer_product_shortage_rate", "customer_product_order_count"))


@query(
    "j3_product_master",
    """SELECT order_number, c.product_code, order_qty, p.category, p.vendorName, p.temperatureCondition, p.salesUnit
    FROM clean c LEFT JOIN products p ON c.product_code = p.salesUnitGtin""",
)
def j3(spark, d):
    lines = shared.clean(spark, d).select("order_number", "product_code", "order_qty")
    columns = ["category", "vendorName", "temperatureCondition", "salesUnit"]
    return join_products(lines, view(spark, d, "products")).select(
        "order_number", "product_code", "order_qty", *columns
    )


@query("j3_product_master_shuffled", like="j3_product_master")
def j3_shuffled(spark, d):
    lines = shared.clean(spark, d).select("order_number", "product_code", "order_qty")
    columns = ["category", "vendorName", "temperatureCondition", "salesUnit"]
    return join_products(lines, view(spark, d, "products"), **FORCED).select("order_number", "product_code", "order_qty", *columns)


@query(
    "j4_replacement_counts",
    """SELECT order_number, c.product_code, order_qty, coalesce(replacement_frequency, 0) AS replacement_frequency
    FROM clean c LEFT JOIN replacement_counts r ON c.product_code = r.product_code""",
)
def j4(spark, d):
    counts = materialize(st.replacement_counts(view(spark, d, "replacements")), "replacements")
    joined = replacement_feature(shared.clean(spark, d), counts)
    return joined.select("order_number", "product_code", "order_qty", "replacement_frequency")


@query(
    "j5_substitute_details",
    """SELECT s.product_code AS target_product, p.salesUnitGtin AS product_code, p.category, p.vendorName, p.salesUnit
    FROM substitute_list s JOIN products p ON s.substitute = p.salesUnitGtin WHERE s.rank <= 3""",
)
def j5(spark, d):
    master = product_master(view(spark, d, "products"))
    rows = materialize(substitute_rows(master, 3), "substitutes")
    return substitute_details(rows, master)


@query(
    "j6_feature_importance",
    """SELECT order_number, f.feature, f.value, coalesce(i.importance, 0) AS importance FROM (
      SELECT order_number, 'order_qty' AS feature, order_qty AS value FROM judged
      UNION ALL SELECT order_number, 'is_weekend', CAST(is_shortage AS DOUBLE) FROM judged
      UNION ALL SELECT order_number, 'unknown_feature', order_qty * 2 FROM judged) f
    LEFT JOIN (VALUES ('order_qty', CAST(0.5 AS DOUBLE)), ('is_weekend', CAST(0.25 AS DOUBLE)))
      AS i(feature, importance) ON f.feature = i.feature""",
)
def j6(spark, d):
    qty = F.col("order_qty")
    pairs = [("order_qty", qty), ("is_weekend", F.col("is_shortage").cast("double")), ("unknown_feature", qty * 2)]
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in pairs])
    values = shared.judged(spark, d).select("order_number", F.inline(entries))
    importances = spark.createDataFrame(
        [("order_qty", 0.5), ("is_weekend", 0.25)], "feature STRING, importance DOUBLE"
    )
    return feature_importance(importances, values).select("order_number", "feature", "value", "importance")


@query(
    "j7_request_lookup",
    """SELECT order_number, product_code, customer_number, order_qty, customer_email, risk_level,
       round(shortage_probability, 6) AS shortage_probability, recommended_action FROM routed""",
)
def j7(spark, d):
    todo = materialize(shared.actions(spark, d), "actions")
    return rounded(look_up(parse_requests(view(spark, d, "requests")), todo).drop("_order"))


@query("j7_request_lookup_shuffled", like="j7_request_lookup")
def j7_shuffled(spark, d):
    todo = materialize(shared.actions(spark, d), "actions")
    return rounded(look_up(parse_requests(view(spark, d, "requests")), todo, **FORCED).drop("_order"))


@query(
    "j8_notified_status",
    """SELECT order_number, product_code, CASE WHEN order_number IN (
         SELECT order_number FROM predictions WHERE shortage_probability >= 0.9)
       THEN 'AI Call Generated ✅' ELSE 'Pending' END AS status FROM actions""",
)
def j8(spark, d):
    scored = shared.scored(spark, d)
    notified = scored.where(F.col("shortage_probability") >= 0.9).select("order_number")
    todo = shared.actions(spark, d)
    return notified_status(todo, notified).select("order_number", "product_code", "status")
