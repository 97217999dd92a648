"""Projections, predicates and cleaning (P1 – P22)."""

from pyspark.sql import functions as F

from shelfcast import config as c
from shelfcast.functions import labels
from shelfcast.operators import cleaning as cl
from shelfcast.operators.dispatch import high_priority
from shelfcast.operators.joins import attach
from shelfcast.operators.orders import high_risk, lookup_order, top_critical
from shelfcast.operators.serving import order_dates
from shelfcast.operators.stats import product_stats
from shelfcast.storage import materialize

from . import shared
from .registry import query, rounded
from .tables import view


@query("p1_select_existing", "SELECT order_number, product_code, order_qty, is_shortage FROM clean")
def p1(spark, d):
    wanted = ["order_number", "product_code", "no_such_column", "order_qty", "is_shortage"]
    return cl.select_existing(shared.clean(spark, d), wanted)


@query(
    "p2_derive_columns",
    """SELECT order_number, product_code AS product, order_qty * 2 AS order_qty,
       order_qty - delivered_qty AS open_qty FROM sales""",
)
def p2(spark, d):
    sales = view(spark, d, "sales")
    derived = sales.withColumns(
        {"open_qty": F.col("order_qty") - F.col("delivered_qty"), "order_qty": F.col("order_qty") * 2}
    )
    return derived.select("order_number", F.col("product_code").alias("product"), "order_qty", "open_qty")


@query(
    "p3_literal_columns",
    """SELECT order_number, product_code, 'UNKNOWN' AS vendorName, 'UNKNOWN' AS category,
       'UNKNOWN' AS temperatureCondition FROM sales""",
)
def p3(spark, d):
    return cl.add_unknown_master(view(spark, d, "sales").select("order_number", "product_code"))


@query(
    "p4_default_columns",
    """SELECT order_number, product_code, order_created_date, order_created_date + 1 AS requested_delivery_date,
       CAST(140000 AS BIGINT) AS order_created_time, CAST(14 AS BIGINT) AS order_hour,
       CAST(0 AS DOUBLE) AS picking_picked_qty,
       CASE WHEN order_created_date IS NOT NULL THEN CAST(1 AS INTEGER) END AS lead_time_days FROM clean""",
)
def p4(spark, d):
    orders = shared.clean(spark, d).select("order_number", "product_code", "order_created_date")
    columns = [
        "order_number", "product_code", "order_created_date", "requested_delivery_date",
        "order_created_time", "order_hour", "picking_picked_qty", "lead_time_days",
    ]
    return order_dates(cl.with_order_defaults(orders)).select(*columns)


@query(
    "p5_text_product_codes",
    """SELECT CAST(s.product_code AS VARCHAR) AS product_code, count(*) AS order_lines FROM sales s
    WHERE CAST(s.product_code AS VARCHAR) IN (SELECT salesUnitGtin FROM products) GROUP BY 1""",
)
def p5(spark, d):
    lines = cl.text_product_code(view(spark, d, "sales").select("product_code"))
    counts = lines.groupBy("product_code").agg(F.count("*").alias("order_lines"))
    master = cl.product_master(view(spark, d, "products"))
    return counts.join(master, "product_code", "left_semi")


@query(
    "p6_rename_product_key",
    "SELECT salesUnitGtin AS product_code, category, vendorName, temperatureCondition, salesUnit FROM products",
)
def p6(spark, d):
    return cl.product_master(view(spark, d, "products"))


@query(
    "p7_placeholder_dates",
    """SELECT order_number, NULLIF(TRY_CAST(order_created_date AS DATE), DATE '1970-01-01') AS order_created_date,
       NULLIF(TRY_CAST(requested_delivery_date AS DATE), DATE '1970-01-01') AS requested_delivery_date,
       NULLIF(TRY_CAST(picking_confirmed_date AS DATE), DATE '1970-01-01') AS picking_confirmed_date FROM sales""",
)
def p7(spark, d):
    parsed = cl.drop_placeholder_dates(cl.parse_dates(view(spark, d, "sales")))
    return parsed.select("order_number", *c.DATE_COLUMNS)


@query(
    "p8_fill_constants",
    """SELECT order_number, product_code, coalesce(delivered_qty, 0) AS delivered_qty,
       coalesce(picking_picked_qty, 0) AS picking_picked_qty,
       coalesce(CAST(plant AS VARCHAR), 'UNKNOWN') AS plant,
       coalesce(CAST(storage_location AS VARCHAR), 'UNKNOWN') AS storage_location FROM sales""",
)
def p8(spark, d):
    filled = cl.fill_unknown(cl.fill_quantities(view(spark, d, "sales")))
    return filled.select(
        "order_number", "product_code", "delivered_qty", "picking_picked_qty", "plant", "storage_location"
    )


@query(
    "p9_fill_from_column",
    """SELECT order_number, c.product_code, order_qty, round(coalesce(a, order_qty), 6) AS product_avg_order_qty
    FROM clean c LEFT JOIN (SELECT CAST(product_code AS VARCHAR) AS product_code, avg(order_qty) AS a
                            FROM replacements GROUP BY 1) r ON c.product_code = r.product_code""",
)
def p9(spark, d):
    rows = cl.text_product_code(view(spark, d, "replacements"))
    means = rows.groupBy("product_code").agg(F.avg("order_qty").alias("product_avg_order_qty"))
    joined = attach(shared.clean(spark, d), materialize(means, "means"), ["product_code"])
    return rounded(
        joined.select(
            "order_number", "product_code", "order_qty",
            F.coalesce("product_avg_order_qty", "order_qty").alias("product_avg_order_qty"),
        )
    )


@query(
    "p10_shortage_label",
    "SELECT order_number, product_code, order_qty, delivered_qty, is_shortage FROM clean",
)
def p10(spark, d):
    return shared.clean(spark, d).select(
        "order_number", "product_code", "order_qty", "delivered_qty", "is_shortage"
    )


@query(
    "p11_raw_flags",
    """SELECT order_number, product_code, order_qty > delivered_qty AS is_shortage,
       delivered_qty IS NULL AS is_null_delivery FROM sales""",
)
def p11(spark, d):
    flag = labels.raw_shortage_flag(F.col("order_qty"), F.col("delivered_qty"))
    return view(spark, d, "sales").select(
        "order_number", "product_code", flag.alias("is_shortage"),
        F.col("delivered_qty").isNull().alias("is_null_delivery"),
    )


@query(
    "p12_purchase_flag",
    "SELECT order_number, product_code, ordered_qty > received_qty AS is_shortage FROM purchases",
)
def p12(spark, d):
    flag = labels.purchase_shortage_flag(F.col("ordered_qty"), F.col("received_qty"))
    return view(spark, d, "purchases").select("order_number", "product_code", flag.alias("is_shortage"))


@query(
    "p13_drop_null_rows",
    """SELECT order_number, d.product_code, lead_time_days, round(product_order_qty_std, 4) AS product_order_qty_std
    FROM dated d LEFT JOIN product_stats p ON d.product_code = p.product_code
    WHERE lead_time_days IS NOT NULL AND product_order_qty_std IS NOT NULL""",
)
def p13(spark, d):
    lines = shared.stored_lines(spark, d)
    stats = materialize(product_stats(lines), "product")
    kept = cl.drop_null_rows(
        attach(lines, stats, ["product_code"]), ["lead_time_days", "product_order_qty_std"]
    )
    return rounded(
        kept.select("order_number", "product_code", "lead_time_days", "product_order_qty_std"), 4
    )


@query("p14_drop_duplicates", "SELECT DISTINCT * FROM sales")
def p14(spark, d):
    return view(spark, d, "sales").dropDuplicates()


@query(
    "p15_date_range",
    """SELECT order_number, product_code, order_created_date, order_qty FROM clean
    WHERE order_created_date >= DATE '1997-01-01' AND order_created_date <= DATE '1999-06-30'""",
)
def p15(spark, d):
    lines = shared.clean(spark, d).select("order_number", "product_code", "order_created_date", "order_qty")
    since, until = F.lit("1997-01-01").cast("date"), F.lit("1999-06-30").cast("date")
    return lines.where(F.col("order_created_date").between(since, until))


@query(
    "p16_high_risk",
    """SELECT order_number, product_code, round(shortage_probability, 6) AS shortage_probability
    FROM predictions WHERE shortage_probability >= 0.7 ORDER BY shortage_probability DESC""",
)
def p16(spark, d):
    risky = high_risk(shared.scored(spark, d))
    return rounded(risky.select("order_number", "product_code", "shortage_probability"))


@query(
    "p17_risk_membership",
    "SELECT order_number, product_code, risk_level FROM predictions WHERE risk_level IN ('🔴 CRITICAL', '🟡 HIGH')",
)
def p17(spark, d):
    return high_priority(shared.predictions(spark, d)).select("order_number", "product_code", "risk_level")


@query(
    "p18_point_lookup",
    """SELECT p.order_number, p.product_code, p.order_qty, round(p.shortage_probability, 6) AS shortage_probability
    FROM predictions p JOIN (SELECT order_number, product_code FROM predictions WHERE risk_level = '🔴 CRITICAL'
      ORDER BY shortage_probability DESC, order_number, product_code, customer_number, order_qty LIMIT 1) t
    ON p.order_number = t.order_number AND p.product_code = t.product_code""",
)
def p18(spark, d):
    scored = shared.scored(spark, d)
    ties = ["order_number", "product_code", "customer_number", "order_qty"]
    top = top_critical(scored, ties).first()
    found = lookup_order(scored, top["order_number"], top["product_code"])
    return rounded(found.select("order_number", "product_code", "order_qty", "shortage_probability"))


@query("p19_risk_level", "SELECT order_number, product_code, order_qty, risk_level FROM predictions")
def p19(spark, d):
    return shared.predictions(spark, d).select("order_number", "product_code", "order_qty", "risk_level")


@query(
    "p20_recommended_action",
    """SELECT product_code, CASE WHEN substitute_1 IS NOT NULL THEN '📞 Contact customer - offer substitutes'
         ELSE '📞 Contact customer - notify potential delay' END AS recommended_action,
       CASE WHEN substitute_1 IS NOT NULL THEN '📞 Offer substitutes'
         ELSE '📞 Notify of potential delay' END AS short_action FROM top_substitutes""",
)
def p20(spark, d):
    subs = F.col("substitutes")
    return shared.substitute_lists(spark, d, 3).select(
        "product_code",
        labels.recommended_action(subs).alias("recommended_action"),
        labels.recommended_action(subs, c.SHORT_ACTION_LABELS).alias("short_action"),
    )


@query("p21_spread_substitutes", "SELECT * FROM top_substitutes")
def p21(spark, d):
    lists = shared.substitute_lists(spark, d, 3)
    return lists.select(
        "product_code",
        *[F.get("substitutes", F.lit(i)).alias(f"substitute_{i + 1}") for i in range(3)],
    )


@query(
    "p22_verdict",
    """SELECT order_number, product_code, CASE WHEN shortage_probability >= 0.5 THEN 'high' ELSE 'low' END AS verdict
    FROM predictions""",
)
def p22(spark, d):
    return shared.scored(spark, d).select(
        "order_number", "product_code", labels.verdict(F.col("shortage_probability")).alias("verdict")
    )
