"""User-level operators (F1 – F14)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast.config import FEATURES
from shelfcast.functions.labels import verdict
from shelfcast.learners import BEST, fit_boosted, fit_logistic, load_model, save_model, score
from shelfcast.operators import dispatch
from shelfcast.operators import requests as rq
from shelfcast.operators.cleaning import app_clean, product_master
from shelfcast.operators.explain import explain, explain_text
from shelfcast.operators.features import engineer_features
from shelfcast.operators.serving import serve_features
from shelfcast.operators.stats import load_bucketed_stats, save_bucketed_stats, serving_stats, stored
from shelfcast.operators.substitutes import substitutes
from shelfcast.plans import best_model, prepare_from_sales, product_status, run_dispatch
from shelfcast.sources import read_actions, read_sales_typed
from shelfcast.storage import fresh_path, materialize

from . import shared
from .aggregates import SPLIT_SQL, split_lines
from .joins import FORCED
from .registry import query, rounded
from .tables import view


@query("f1_clean_orders", "SELECT * FROM clean")
def f1(spark, d):
    return shared.clean(spark, d)


@query("f2_clean_orders_with_products", "SELECT * FROM enriched")
def f2(spark, d):
    return shared.enriched(spark, d)


@query(
    "f1_interactive_variant",
    """SELECT order_number, CAST(product_code AS VARCHAR) AS product_code,
       TRY_CAST(order_created_date AS DATE) AS order_created_date, order_qty,
       coalesce(delivered_qty, 0) AS delivered_qty, picking_picked_qty,
       CAST(order_qty > coalesce(delivered_qty, 0)
            OR (coalesce(delivered_qty, 0) = 0 AND order_qty > 0) AS TINYINT) AS is_shortage,
       CAST(TRY_CAST(requested_delivery_date AS DATE) - TRY_CAST(order_created_date AS DATE) AS INTEGER)
         AS lead_time_days, 'UNKNOWN' AS vendorName FROM sales""",
)
def f1_interactive(spark, d):
    """Lines read with parsed dates: copies, placeholder dates and missing picks stay."""
    path = fresh_path(spark, "sales")
    view(spark, d, "sales").write.option("header", True).csv(path)
    return app_clean(read_sales_typed(spark, path)).select(
        "order_number", "product_code", "order_created_date", "order_qty", "delivered_qty",
        "picking_picked_qty", "is_shortage", "lead_time_days", "vendorName",
    )


_KEYS = ("is_shortage", "order_created_date", "order_number", "product_code", "customer_number")
_EXACT = {
    "order_day_of_week", "order_day_of_month", "order_month", "order_quarter", "is_weekend",
    "lead_time_days", "order_hour", "product_order_count", "customer_order_count",
    "customer_product_order_count", "vendor_order_count", "replacement_frequency",
}


def _rounded_sql(columns) -> str:
    return ", ".join(
        c if c in _EXACT else f"round({c}, {4 if c.endswith('_std') else 6}) AS {c}" for c in columns
    )


@query("f3_engineer_features", f"SELECT {_rounded_sql(FEATURES)}, {', '.join(_KEYS)} FROM features")
def f3(spark, d):
    return rounded(shared.features(spark, d).select(*FEATURES, *_KEYS), product_order_qty_std=4)


@query("f3_engineer_features_shuffled", like="f3_engineer_features")
def f3_shuffled(spark, d):
    """All lookups shuffled and salted, as where no statistics table is small."""
    features = engineer_features(shared.enriched(spark, d), view(spark, d, "replacements"), **FORCED)
    return rounded(features.select(*FEATURES, *_KEYS), product_order_qty_std=4)


@query(
    "f3_features_without_master",
    """SELECT f.order_number, f.product_code, round(f.product_shortage_rate, 6) AS product_shortage_rate,
       round(c.r, 6) AS vendor_shortage_rate, CAST(c.n AS BIGINT) AS vendor_order_count,
       round(c.r, 6) AS category_shortage_rate, round(c.r, 6) AS temp_condition_shortage_rate
    FROM features f JOIN (SELECT avg(is_shortage) AS r, count(DISTINCT order_number) AS n FROM clean) c ON TRUE""",
)
def f3_plain(spark, d):
    """The default path, in which every line shares one unknown vendor and category."""
    features = engineer_features(shared.clean(spark, d), view(spark, d, "replacements"))
    return rounded(
        features.select(
            "order_number", "product_code", "product_shortage_rate", "vendor_shortage_rate",
            "vendor_order_count", "category_shortage_rate", "temp_condition_shortage_rate",
        )
    )


@query(
    "f4_substitutes",
    "SELECT product_code, CAST(rank AS INTEGER) AS rank, substitute FROM substitute_list",
)
def f4(spark, d):
    lists = shared.substitute_lists(spark, d, 5)
    return lists.select("product_code", F.posexplode("substitutes").alias("at", "substitute")).select(
        "product_code", (F.col("at") + 1).alias("rank"), "substitute"
    )


_REPEATED = "SELECT * FROM products UNION ALL SELECT * FROM products WHERE CAST(salesUnitGtin AS BIGINT) % 10 IN (0, 3)"


@query(
    "f4_substitutes_repeated",
    f"""WITH listed AS (SELECT category, salesUnitGtin AS code, count(*) AS copies FROM ({_REPEATED}) GROUP BY 1, 2),
    entries AS (
      SELECT a.code AS product_code, coalesce(a.category, '') AS place, unnest(range(a.copies)) AS round, b.code AS substitute, b.copies
      FROM listed a JOIN listed b ON a.category IS NOT DISTINCT FROM b.category AND a.code <> b.code),
    each AS (SELECT product_code, place, round, substitute, unnest(range(copies)) AS copy FROM entries),
    ranked AS (SELECT product_code, substitute, row_number() OVER (PARTITION BY product_code ORDER BY place, round, substitute, copy) AS rank FROM each)
    SELECT product_code, CAST(rank AS INTEGER) AS rank, substitute FROM ranked WHERE rank <= 5""",
)
def f4_repeated(spark, d):
    """The list without removal of repeats: a product listed twice is offered twice, and gets its list twice."""
    products = view(spark, d, "products")
    again = products.unionAll(products.where(F.col("salesUnitGtin").cast("bigint") % 10 == 0)).unionAll(
        products.where(F.col("salesUnitGtin").cast("bigint") % 10 == 3)
    )
    lists = substitutes(product_master(again), view(spark, d, "replacements"), 5, distinct=False)
    return lists.select("product_code", F.posexplode("substitutes").alias("at", "substitute")).select(
        "product_code", (F.col("at") + 1).alias("rank"), "substitute"
    )


@query(
    "f4_substitute_texts",
    """SELECT k.product_code, CAST(count(substitute) AS INTEGER) AS n,
       coalesce(string_agg(substitute, '|' ORDER BY rank), '') AS list
    FROM known_products k LEFT JOIN substitute_list s ON k.product_code = s.product_code GROUP BY 1""",
)
def f4_texts(spark, d):
    return shared.substitute_lists(spark, d, 5).select(
        "product_code", F.size("substitutes").alias("n"), F.concat_ws("|", "substitutes").alias("list")
    )


@query(
    "f5_time_split",
    f"SELECT split, order_created_date, order_number, product_code, customer_number, order_qty FROM ({SPLIT_SQL})",
)
def f5(spark, d):
    return split_lines(spark, d).select(
        "split", "order_created_date", "order_number", "product_code", "customer_number", "order_qty"
    )


_CUT = "1999-01-01"
_SERVED = (
    "order_number", "product_code", "customer_number", "order_qty", "order_hour", "lead_time_days",
    "is_weekend", "picking_picked_qty", "product_shortage_rate", "product_avg_order_qty",
    "product_order_qty_std", "product_order_count", "customer_shortage_rate",
    "customer_total_order_qty", "customer_order_count", "customer_avg_lead_time",
    "customer_product_shortage_rate", "customer_product_order_count", "plant_shortage_rate",
    "storage_shortage_rate", "vendor_shortage_rate", "vendor_order_count", "replacement_frequency",
    "category_shortage_rate", "temp_condition_shortage_rate",
)


def _served_sql(vendor_rate: str, vendor_orders: str) -> str:
    """New orders from the cut on, with statistics of the lines before it."""
    old = f"(SELECT * FROM dated WHERE order_created_date < DATE '{_CUT}')"
    return f"""SELECT d.order_number, d.product_code, d.customer_number, d.order_qty,
       CAST(14 AS BIGINT) AS order_hour, 1 AS lead_time_days, d.is_weekend,
       CAST(0 AS DOUBLE) AS picking_picked_qty,
       round(coalesce(p.r, 0.04), 6) AS product_shortage_rate, round(coalesce(p.q, d.order_qty), 6) AS product_avg_order_qty,
       round(coalesce(p.s, 0), 4) AS product_order_qty_std, CAST(coalesce(p.n, 0) AS BIGINT) AS product_order_count,
       round(coalesce(c.r, 0.04), 6) AS customer_shortage_rate, round(coalesce(c.q, 0), 6) AS customer_total_order_qty,
       CAST(coalesce(c.n, 0) AS BIGINT) AS customer_order_count, round(coalesce(c.l, 1), 6) AS customer_avg_lead_time,
       round(coalesce(cp.r, 0.04), 6) AS customer_product_shortage_rate,
       CAST(coalesce(cp.n, 0) AS BIGINT) AS customer_product_order_count,
       round(coalesce(pl.r, 0.04), 6) AS plant_shortage_rate, round(coalesce(st.r, 0.04), 6) AS storage_shortage_rate,
       {vendor_rate} AS vendor_shortage_rate, CAST({vendor_orders} AS BIGINT) AS vendor_order_count,
       CAST(0 AS BIGINT) AS replacement_frequency, CAST(0.04 AS DOUBLE) AS category_shortage_rate,
       CAST(0.04 AS DOUBLE) AS temp_condition_shortage_rate
    FROM dated d
    LEFT JOIN (SELECT product_code, avg(is_shortage) r, avg(order_qty) q, stddev_samp(order_qty) s,
               count(DISTINCT order_number) n FROM {old} GROUP BY 1) p ON d.product_code = p.product_code
    LEFT JOIN (SELECT customer_number, avg(is_shortage) r, sum(order_qty) q, count(DISTINCT order_number) n,
               avg(lead_time_days) l FROM {old} GROUP BY 1) c ON d.customer_number = c.customer_number
    LEFT JOIN (SELECT customer_number, product_code, avg(is_shortage) r, count(DISTINCT order_number) n
               FROM {old} GROUP BY 1, 2) cp
      ON d.customer_number = cp.customer_number AND d.product_code = cp.product_code
    LEFT JOIN (SELECT plant, avg(is_shortage) r FROM {old} GROUP BY 1) pl ON d.plant = pl.plant
    LEFT JOIN (SELECT storage_location, avg(is_shortage) r FROM {old} GROUP BY 1) st
      ON d.storage_location = st.storage_location
    LEFT JOIN (SELECT vendorName, avg(is_shortage) r, count(DISTINCT order_number) n FROM {old} GROUP BY 1) v
      ON d.vendorName = v.vendorName
    WHERE d.order_created_date >= DATE '{_CUT}'"""


def _new_orders(spark, d, *extra):
    lines = shared.stored_lines(spark, d)
    day = F.col("order_created_date")
    cut = F.lit(_CUT).cast("date")
    stats = stored(serving_stats(lines.where(day < cut)))
    columns = [
        "order_number", "order_created_date", "customer_number", "product_code", "order_qty", "plant",
        "storage_location", *extra,
    ]
    return lines.where(day >= cut).select(*columns), stats


@query("f6_serve_features", _served_sql("CAST(0.04 AS DOUBLE)", "0"))
def f6(spark, d):
    orders, stats = _new_orders(spark, d)
    return rounded(serve_features(orders, stats).select(*_SERVED), product_order_qty_std=4)


@query("f6_serve_features_shuffled", like="f6_serve_features")
def f6_shuffled(spark, d):
    orders, stats = _new_orders(spark, d)
    return rounded(serve_features(orders, stats, **FORCED).select(*_SERVED), product_order_qty_std=4)


@query("f6_serve_features_bucketed", like="f6_serve_features")
def f6_bucketed(spark, d):
    """Statistics kept as tables bucketed by key, and no lookup small enough to broadcast."""
    orders, stats = _new_orders(spark, d)
    path = fresh_path(spark, "bundle")
    prefix = f"bundle_{path.split('/')[-2]}"
    save_bucketed_stats(stats, path, prefix, buckets=4)
    served = serve_features(orders, load_bucketed_stats(spark, prefix), max_broadcast_rows=0)
    return rounded(served.select(*_SERVED), product_order_qty_std=4)


@query("f7_serve_features_with_vendor", _served_sql("round(coalesce(v.r, 0.04), 6)", "coalesce(v.n, 0)"))
def f7(spark, d):
    orders, stats = _new_orders(spark, d, "vendorName")
    served = serve_features(orders, stats, use_vendor_stats=True)
    return rounded(served.select(*_SERVED), product_order_qty_std=4)


@query(
    "f8_score",
    f"""SELECT order_number, product_code, order_qty, TRUE AS in_range, TRUE AS consistent
    FROM dated WHERE order_created_date >= DATE '{_CUT}'""",
)
def f8(spark, d):
    """New orders scored by a model fitted on the lines before them, which alone give the statistics."""
    earlier = view(spark, d, "sales").where(F.col("order_created_date") < _CUT)  # ISO dates compare as text
    data = prepare_from_sales(earlier, view(spark, d, "replacements"), extra=())
    model = fit_logistic(data.train)
    orders, stats = _new_orders(spark, d)
    p = F.col("shortage_probability")
    return score(serve_features(orders, stats), model).select(
        "order_number", "product_code", "order_qty", p.between(0, 1).alias("in_range"),
        ((p >= 0.5).cast("int") == F.col("predicted_shortage").cast("int")).alias("consistent"),
    )


@query(
    "f10_run_dispatch",
    f"""SELECT order_number, product_code, order_qty, TRUE AS band_fits, TRUE AS action_fits, TRUE AS substitutes_fit
    FROM dated WHERE order_created_date >= DATE '{_CUT}'""",
)
def f10_run(spark, d):
    """From orders to written predictions and actions with a boosted model that was kept and loaded."""
    earlier = view(spark, d, "sales").where(F.col("order_created_date") < _CUT)
    data = prepare_from_sales(earlier, view(spark, d, "replacements"), extra=())
    kept = fresh_path(spark, "model")
    save_model(best_model({BEST: fit_boosted(data.train, rounds=20)}), spark, kept)
    orders, stats = _new_orders(spark, d)
    top3 = shared.top3(spark, d)
    predictions_path, actions_path = fresh_path(spark, "predictions"), fresh_path(spark, "actions")
    run_dispatch(orders, stats, load_model(spark, kept), top3, predictions_path, actions_path)
    predictions = spark.read.parquet(predictions_path).withColumn("line", F.xxhash64("order_number", "product_code", "customer_number", "order_qty"))
    actions = read_actions(spark, actions_path).withColumn("line", F.xxhash64("order_number", "product_code", "customer_number", "order_qty"))
    p = F.col("shortage_probability")
    band = F.when(p >= 0.8, "🔴 CRITICAL").when(p >= 0.5, "🟡 HIGH").when(p >= 0.3, "🟠 MEDIUM").otherwise("🟢 LOW")
    per_line = actions.groupBy("line").agg(
        F.count("*").alias("n_actions"), F.first("recommended_action").alias("action"), F.first("substitute_1").alias("offered"),
    )
    lines = predictions.withColumn("n_lines", F.count("*").over(Window.partitionBy("line"))).join(per_line, "line", "left").join(top3, "product_code", "left")
    urgent = F.col("risk_level").isin("🔴 CRITICAL", "🟡 HIGH")
    first = F.get("substitutes", F.lit(0))
    label = F.when(F.col("offered").isNotNull(), "📞 Contact customer - offer substitutes").otherwise("📞 Contact customer - notify potential delay")
    return lines.select(
        "order_number", "product_code", "order_qty", (F.col("risk_level") == band).alias("band_fits"),
        F.when(urgent, (F.col("n_actions") == F.col("n_lines")) & (F.col("action") == label)).otherwise(F.col("n_actions").isNull()).alias("action_fits"),
        (~urgent | F.col("offered").eqNullSafe(first)).alias("substitutes_fit"),
    )


# Importances that make the explanation independent of a model.
_IMPORTANCES = {
    "order_qty": 0.05, "lead_time_days": 0.3, "order_hour": 0.02, "order_month": 0.11,
    "order_day_of_month": 0.013, "order_day_of_week": 0.07, "picking_picked_qty": 0.015,
    "is_weekend": 0.4, "product_shortage_rate": 2.5, "product_order_count": 0.001,
    "customer_total_order_qty": 0.0005,
}

_UNPIVOTED = " UNION ALL ".join(
    f"SELECT rid, {i} AS i, '{n}' AS feature, CAST({n} AS DOUBLE) AS value, CAST({_IMPORTANCES.get(n, 0.0)} AS DOUBLE) AS importance FROM numbered"
    for i, n in enumerate(FEATURES)
)
_RANKED = """SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN value IS NULL THEN 1 ELSE 0 END,
    abs(value * importance) DESC, i) AS rank FROM unpivoted"""


@query(
    "f9_explain",
    f"""WITH numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM features),
    unpivoted AS ({_UNPIVOTED}), ranked AS ({_RANKED})
    SELECT n.order_number, n.product_code, n.customer_number, n.order_qty, CAST(r.rank AS INTEGER) AS rank, r.feature,
       round(r.value, 4) AS value, round(r.importance, 4) AS importance, round(r.value * r.importance, 4) AS contribution
    FROM ranked r JOIN numbered n ON n.rid = r.rid WHERE r.rank <= 10""",
)
def f9(spark, d):
    return rounded(explain(shared.features(spark, d), _IMPORTANCES), 4)


@query(
    "f9_explain_text",
    f"""WITH numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM features),
    unpivoted AS ({_UNPIVOTED}), ranked AS ({_RANKED})
    SELECT any_value(n.order_number) AS order_number, any_value(n.product_code) AS product_code, any_value(n.customer_number) AS customer_number,
       any_value(n.order_qty) AS order_qty, '📊 Top Risk Factors:' || chr(10) || string_agg(
         lpad(CAST(rank AS VARCHAR), 4, ' ') || '. ' || rpad(r.feature, 40, '.') || ' ' || coalesce(printf('%.4f', round(r.value, 4)), 'null'),
         chr(10) ORDER BY rank) AS explanation
    FROM ranked r JOIN numbered n ON n.rid = r.rid WHERE r.rank <= 10 GROUP BY r.rid""",
)
def f9_text(spark, d):
    return explain_text(shared.features(spark, d), _IMPORTANCES)


@query(
    "f10_dispatch",
    "SELECT * REPLACE (round(shortage_probability, 6) AS shortage_probability) FROM actions",
)
def f10(spark, d):
    _, todo = dispatch.dispatch(shared.scored(spark, d), shared.top3(spark, d))
    return rounded(todo)


@query("f10_dispatch_shuffled", like="f10_dispatch")
def f10_shuffled(spark, d):
    _, todo = dispatch.dispatch(shared.scored(spark, d), shared.top3(spark, d), **FORCED)
    return rounded(todo)


@query(
    "f10_dispatch_short",
    """SELECT p.order_number, p.risk_level, p.product_code, p.customer_number, p.order_qty,
       round(p.shortage_probability, 6) AS shortage_probability,
       CASE WHEN s.list IS NOT NULL THEN '📞 Offer substitutes' ELSE '📞 Notify of potential delay' END AS recommended_action,
       coalesce(s.list, 'None Found') AS substitutes
    FROM predictions p LEFT JOIN (SELECT product_code, string_agg(substitute, ', ' ORDER BY rank) AS list
      FROM substitute_list WHERE rank <= 3 GROUP BY 1) s ON p.product_code = s.product_code
    WHERE p.risk_level IN ('🔴 CRITICAL', '🟡 HIGH')""",
)
def f10_short(spark, d):
    return rounded(dispatch.short_actions(shared.predictions(spark, d), shared.top3(spark, d)))


@query(
    "f11_product_status",
    "SELECT DISTINCT salesUnitGtin AS product_code, TRUE AS in_range, TRUE AS verdict_fits FROM products",
)
def f11(spark, d):
    data = prepare_from_sales(view(spark, d, "sales"), view(spark, d, "replacements"), extra=("plant", "storage_location", "category", "temperatureCondition", "vendorName"))
    model = fit_logistic(data.train)
    stats = stored(serving_stats(data.features))
    status = product_status(view(spark, d, "products"), data.features, stats, model, as_of="2025-10-01")
    p = F.col("shortage_probability")
    fits = F.col("verdict") == verdict(p)
    return status.select("product_code", p.between(0, 1).alias("in_range"), fits.alias("verdict_fits"))


@query(
    "f13_check_requests",
    "SELECT * REPLACE (round(shortage_probability, 6) AS shortage_probability) FROM routed",
)
def f13(spark, d):
    todo = materialize(shared.actions(spark, d), "actions")
    return rounded(rq.check_requests(view(spark, d, "requests"), todo))


@query(
    "f14_route_errors",
    """SELECT order_number, product_code, customer_number, order_qty, customer_email, 'false' AS success,
       'Invalid order details: we couldn’t find a matching combination of orderNumber, productCode, customerNumber and orderQty in the shortage dataset. Please double-check your inputs.' AS error
    FROM routed WHERE status = 'not_found'""",
)
def f14(spark, d):
    todo = materialize(shared.actions(spark, d), "actions")
    failed = rq.error_rows(rq.check_requests(view(spark, d, "requests"), todo))
    return failed.drop("mail_subject", "mail_body")
