"""Reading and writing (S1 – S12)."""

from datetime import date

from pyspark.sql import functions as F

from shelfcast import schemas
from shelfcast.functions.text import request_number
from shelfcast.learners import fit_logistic, load_model, save_model, score
from shelfcast.operators.dispatch import actions, with_risk_level
from shelfcast.operators.cleaning import clean_orders_with_products
from shelfcast.operators.features import date_features
from shelfcast.operators.joins import attach
from shelfcast.operators.requests import check_requests, log_rows
from shelfcast.operators.stats import product_stats
from shelfcast.plans import prepare_from_sales
from shelfcast.sources import files
from shelfcast.storage import fresh_path, materialize
from shelfcast.streaming.order_check import append_to, read_checked, request_stream, run_order_checks

from . import shared
from .registry import query, rounded
from .tables import number_sql, view


def _csv(spark, df, name):
    path = fresh_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


@query("s1_read_sales_csv", "SELECT * FROM sales")
def s1(spark, d):
    return files.read_sales(spark, _csv(spark, view(spark, d, "sales"), "sales"))


@query(
    "s2_read_sales_csv_typed",
    """SELECT order_number, TRY_CAST(order_created_date AS DATE) AS order_created_date, order_created_time,
       TRY_CAST(requested_delivery_date AS DATE) AS requested_delivery_date,
       TRY_CAST(picking_confirmed_date AS DATE) AS picking_confirmed_date, customer_number,
       CAST(product_code AS VARCHAR) AS product_code, order_qty, delivered_qty, picking_picked_qty,
       plant, storage_location FROM sales""",
)
def s2(spark, d):
    return files.read_sales_typed(spark, _csv(spark, view(spark, d, "sales"), "sales"))


@query("s3_read_purchases_csv", "SELECT * FROM purchases")
def s3(spark, d):
    return files.read_purchases(spark, _csv(spark, view(spark, d, "purchases"), "purchases"))


@query(
    "s4_read_replacements_csv",
    "SELECT * REPLACE (CAST(product_code AS VARCHAR) AS product_code) FROM replacements",
)
def s4(spark, d):
    return files.read_replacements(spark, _csv(spark, view(spark, d, "replacements"), "replacements"))


@query("s5_read_products_json", "SELECT * FROM products")
def s5(spark, d):
    """Written as files of one JSON array each, of bounded length, and read back."""
    products = view(spark, d, "products")
    chunks = products.count() // 10_000 + 1
    objects = products.select(
        F.pmod(F.xxhash64("salesUnitGtin"), F.lit(chunks)).alias("chunk"),
        F.to_json(F.struct(*products.columns)).alias("object"),
    )
    arrays = objects.groupBy("chunk").agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list("object")), F.lit("]")).alias("value")
    )
    path = fresh_path(spark, "products")
    arrays.write.partitionBy("chunk").text(path)
    return files.read_products(spark, path)


@query(
    "s6_literal_orders",
    """SELECT o.*, round(product_shortage_rate, 6) AS product_shortage_rate, product_order_count
    FROM (VALUES (CAST(99999001 AS BIGINT), CAST(1 AS BIGINT), '29', CAST(10 AS DOUBLE)),
                 (99999002, 2, '58', 5), (99999003, 3, '-1', 20))
         AS o(order_number, customer_number, product_code, order_qty)
    LEFT JOIN product_stats p ON o.product_code = p.product_code""",
)
def s6(spark, d):
    orders = files.literal_table(
        spark,
        [(99999001, 1, "29", 10.0), (99999002, 2, "58", 5.0), (99999003, 3, "-1", 20.0)],
        "order_number BIGINT, customer_number BIGINT, product_code STRING, order_qty DOUBLE",
    )
    history = materialize(product_stats(shared.clean(spark, d)), "product")
    joined = attach(orders, history, ["product_code"])
    return rounded(joined.select(*orders.columns, "product_shortage_rate", "product_order_count"))


@query("s7_write_predictions_parquet", "SELECT * REPLACE (round(shortage_probability, 6) AS shortage_probability) FROM predictions")
def s7(spark, d):
    path = fresh_path(spark, "predictions")
    files.write_parquet(with_risk_level(shared.scored(spark, d)).drop("delivered_qty"), path)
    return rounded(files.read_parquet(spark, path))


@query("s8_write_actions_csv", "SELECT * REPLACE (round(shortage_probability, 6) AS shortage_probability) FROM actions")
def s8(spark, d):
    path = fresh_path(spark, "actions")
    predictions = with_risk_level(shared.scored(spark, d))
    files.write_actions(actions(predictions, shared.top3(spark, d)), path)
    return rounded(files.read_actions(spark, path))


@query(
    "s9_read_feature_table",
    """SELECT order_number, product_code, order_created_date, order_day_of_week, lead_time_days, order_hour,
       is_shortage FROM dated""",
)
def s9(spark, d):
    path = fresh_path(spark, "features")
    lines = clean_orders_with_products(view(spark, d, "sales"), view(spark, d, "products"))
    files.write_parquet(date_features(lines), path)
    return files.read_parquet(spark, path).select(
        "order_number", "product_code", "order_created_date", "order_day_of_week", "lead_time_days",
        "order_hour", "is_shortage",
    )


@query("s10_save_load_model", "SELECT TRUE AS scored, TRUE AS same")
def s10(spark, d):
    """Rows scored before saving and after loading have the same probabilities throughout."""
    data = prepare_from_sales(view(spark, d, "sales"), view(spark, d, "replacements"))
    model = fit_logistic(data.train)
    path = fresh_path(spark, "model")
    save_model(model, spark, path)
    before = score(data.test, model).withColumnRenamed("shortage_probability", "before")
    after = score(before.drop("predicted_shortage"), load_model(spark, path))
    return after.agg(
        (F.count("*") > 0).alias("scored"), F.min(F.col("before") == F.col("shortage_probability")).alias("same")
    )


def _request_files(spark, d):
    path = fresh_path(spark, "requests")
    view(spark, d, "requests").write.text(path)
    return path


@query(
    "s11_request_intake",
    f"SELECT payload, {number_sql('order_number')} AS order_number FROM fields",
)
def s11(spark, d):
    requests = files.read_requests(spark, _request_files(spark, d))
    number = request_number(F.col("payload"), "orderNumber")
    return requests.select("payload", number.alias("order_number"))


@query(
    "s12_append_log",
    """SELECT order_number, product_code, customer_number, order_qty, risk_level,
       round(shortage_probability, 6) AS shortage_probability, recommended_action, customer_email AS email
    FROM routed WHERE status = 'found'""",
)
def s12(spark, d):
    """A stream over request files appends to the log, which is read back."""
    todo = materialize(shared.actions(spark, d), "actions")
    routed = check_requests(request_stream(spark, _request_files(spark, d)), todo)
    log = fresh_path(spark, "log")
    stream = append_to(log_rows(routed), log, fresh_path(spark, "log-progress"))
    stream.awaitTermination()
    return rounded(spark.read.parquet(log).drop("timestamp"))


@query(
    "s12_log_and_errors",
    """SELECT status, order_number, product_code, customer_number, order_qty, customer_email AS email, risk_level,
       round(shortage_probability, 6) AS shortage_probability, recommended_action,
       CASE WHEN status = 'not_found' THEN 'false' END AS success
    FROM (SELECT * REPLACE (CASE WHEN status = 'found' THEN risk_level END AS risk_level,
       CASE WHEN status = 'found' THEN shortage_probability END AS shortage_probability,
       CASE WHEN status = 'found' THEN recommended_action END AS recommended_action) FROM routed)""",
)
def s12_both(spark, d):
    """One stream over request files writes both of its outputs, which are read back."""
    todo = materialize(shared.actions(spark, d), "actions")
    log, errors = fresh_path(spark, "log"), fresh_path(spark, "errors")
    requests = request_stream(spark, _request_files(spark, d))
    for stream in run_order_checks(requests, todo, log, errors, fresh_path(spark, "progress")):
        stream.awaitTermination()
    found = read_checked(spark, log).drop("timestamp").withColumn("status", F.lit("found"))
    failed = read_checked(spark, errors).drop("error", "mail_subject", "mail_body").withColumnRenamed("customer_email", "email")
    both = found.unionByName(failed.withColumn("status", F.lit("not_found")), allowMissingColumns=True)
    return rounded(both)


# Lines of a CSV file of which some are broken: a date as quantity, a missing or a surplus field, plain text.
_BROKEN_SQL = """
SELECT order_number, CASE order_number % 41 WHEN 1 THEN concat_ws(',', CAST(order_number AS {text}), CAST(product_code AS {text}), 'many', '1')
         WHEN 2 THEN concat_ws(',', CAST(order_number AS {text}), CAST(product_code AS {text}))
         WHEN 3 THEN concat_ws(',', CAST(order_number AS {text}), CAST(product_code AS {text}), '1', '2', '3')
         WHEN 4 THEN concat('no line of order ', CAST(order_number AS {text}))
         WHEN 5 THEN concat_ws(',', CAST(order_number AS {text}), '', '1', '')
         ELSE concat_ws(',', CAST(order_number AS {text}), CAST(product_code AS {text}), CAST(ordered_qty AS {text}), CAST(received_qty AS {text})) END AS line
FROM (SELECT order_number, product_code, coalesce(ordered_qty, 1) AS ordered_qty, coalesce(received_qty, 1) AS received_qty FROM purchases)
"""


@query(
    "s3_quarantine",
    f"""WITH lines AS ({_BROKEN_SQL.format(text='VARCHAR')}),
    split AS (SELECT line, order_number % 41 IN (1, 2, 3, 4) AS broken, string_split(line, ',') AS f FROM lines)
    SELECT CASE WHEN NOT broken THEN CAST(f[1] AS BIGINT) END AS order_number, CASE WHEN NOT broken THEN TRY_CAST(f[2] AS BIGINT) END AS product_code,
      CASE WHEN NOT broken THEN TRY_CAST(f[3] AS DOUBLE) END AS ordered_qty, CASE WHEN NOT broken THEN TRY_CAST(f[4] AS DOUBLE) END AS received_qty,
      CASE WHEN broken THEN line END AS line FROM split""",
)
def s3_quarantine(spark, d):
    """A file with broken lines, read back as clean rows and quarantined lines."""
    path = fresh_path(spark, "purchases")
    rows = spark.sql(_BROKEN_SQL.format(text="STRING").replace("FROM purchases", "FROM {purchases}"), purchases=view(spark, d, "purchases"))
    rows.select("line").write.text(path)
    clean, broken = files.read_csv_checked(spark, path, schemas.PURCHASES, header=False)
    return clean.unionByName(broken.select("line"), allowMissingColumns=True)


_FIRST_MONTH, _LAST_MONTH = date(1995, 3, 15), date(1996, 2, 10)


@query(
    "s7_lines_by_month",
    f"""SELECT order_number, product_code, order_created_date, CASE WHEN month(order_created_date) = 6 THEN order_qty + 1 ELSE order_qty END AS order_qty
    FROM dated WHERE order_created_date BETWEEN DATE '{_FIRST_MONTH}' AND DATE '{_LAST_MONTH}'""",
)
def s7_months(spark, d):
    """Lines stored by month; the Junes are written once more with other quantities; a range is read back."""
    path = fresh_path(spark, "months")
    lines = shared.stored_lines(spark, d).select("order_number", "product_code", "order_created_date", "order_qty")
    files.write_by_month(lines, path)
    files.write_by_month(lines.where(F.month("order_created_date") == 6).withColumn("order_qty", F.col("order_qty") + 1), path)
    return files.read_months(spark, path, _FIRST_MONTH, _LAST_MONTH)
