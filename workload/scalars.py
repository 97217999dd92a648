"""Date, number, text and JSON functions (D1 – D16)."""

from pyspark.sql import functions as F

from shelfcast.functions import dates as dt
from shelfcast.functions import text as tx
from shelfcast.operators import dispatch, messages
from shelfcast.operators.requests import check_requests, error_rows, found_messages, parse_requests
from shelfcast.plans import product_orders
from shelfcast.storage import materialize

from . import shared
from .registry import query, rounded
from .tables import view


def _lines(spark, d):
    return shared.clean(spark, d).select(
        "order_number", "product_code", "order_created_date", "requested_delivery_date",
        "order_created_time",
    )


@query(
    "d1_parse_date",
    "SELECT order_number, order_created_date AS text, TRY_CAST(order_created_date AS DATE) AS parsed FROM sales",
)
def d1(spark, d):
    text = F.col("order_created_date")
    return view(spark, d, "sales").select(
        "order_number", text.alias("text"), dt.parse_date(text).alias("parsed")
    )


@query(
    "d2_iso_weekday",
    "SELECT order_number, order_created_date, CAST(isodow(order_created_date) AS INTEGER) AS weekday FROM clean",
)
def d2(spark, d):
    day = F.col("order_created_date")
    return _lines(spark, d).select("order_number", day, dt.iso_weekday(day).alias("weekday"))


@query(
    "d3_date_parts",
    """SELECT order_number, CAST(day(order_created_date) AS INTEGER) AS day_of_month,
       CAST(month(order_created_date) AS INTEGER) AS month, CAST(quarter(order_created_date) AS INTEGER) AS quarter,
       CAST(year(order_created_date) AS INTEGER) AS year FROM clean""",
)
def d3(spark, d):
    day = F.col("order_created_date")
    return _lines(spark, d).select(
        "order_number", F.dayofmonth(day).alias("day_of_month"), F.month(day).alias("month"),
        F.quarter(day).alias("quarter"), F.year(day).alias("year"),
    )


@query(
    "d4_is_weekend",
    "SELECT order_number, order_created_date, CAST(isodow(order_created_date) >= 5 AS TINYINT) AS is_weekend FROM clean",
)
def d4(spark, d):
    day = F.col("order_created_date")
    return _lines(spark, d).select("order_number", day, dt.is_weekend(day).alias("is_weekend"))


@query(
    "d5_lead_time_days",
    """SELECT order_number, product_code, CAST(requested_delivery_date - order_created_date AS INTEGER) AS lead_time_days
    FROM clean""",
)
def d5(spark, d):
    lead = dt.lead_time_days(F.col("requested_delivery_date"), F.col("order_created_date"))
    return _lines(spark, d).select("order_number", "product_code", lead.alias("lead_time_days"))


@query("d6_next_day", "SELECT order_number, order_created_date + 1 AS next_day FROM clean")
def d6(spark, d):
    following = dt.next_day(F.col("order_created_date"))
    return _lines(spark, d).select("order_number", following.alias("next_day"))


@query(
    "d7_order_hour",
    """SELECT order_number, CAST(floor(order_created_time / 10000) AS BIGINT) AS order_hour,
       CAST(floor((-1 - order_created_time) / 10000) AS BIGINT) AS negative_hour FROM clean""",
)
def d7(spark, d):
    t = F.col("order_created_time")
    return _lines(spark, d).select(
        "order_number", dt.order_hour(t).alias("order_hour"), dt.order_hour(-1 - t).alias("negative_hour")
    )


@query(
    "d8_order_hour_from_text",
    """SELECT order_number, TRY_CAST(substr(CAST(order_created_time AS VARCHAR), 1, 2) AS INTEGER) AS order_hour,
       TRY_CAST(substr(order_created_date, 1, 2) AS INTEGER) AS century FROM sales""",
)
def d8(spark, d):
    return view(spark, d, "sales").select(
        "order_number",
        dt.order_hour_from_text(F.col("order_created_time").cast("string")).alias("order_hour"),
        dt.order_hour_from_text(F.col("order_created_date")).alias("century"),
    )


@query("d9_request_numbers", "SELECT order_number, product_code, customer_number, order_qty FROM parsed")
def d9(spark, d):
    return parse_requests(view(spark, d, "requests")).drop("customer_email")


@query("d10_request_email", "SELECT order_number, customer_email FROM parsed")
def d10(spark, d):
    return parse_requests(view(spark, d, "requests")).select("order_number", "customer_email")


@query(
    "d11_joined_substitutes",
    """SELECT k.product_code, coalesce(string_agg(substitute, ', ' ORDER BY rank), 'None Found') AS substitutes
    FROM known_products k LEFT JOIN substitute_list s ON k.product_code = s.product_code AND s.rank <= 3
    GROUP BY k.product_code""",
)
def d11(spark, d):
    return shared.substitute_lists(spark, d, 3).select(
        "product_code", tx.joined_substitutes(F.col("substitutes")).alias("substitutes")
    )


@query(
    "d12_percent_text",
    """SELECT order_number, product_code, printf('%.1f%%', shortage_probability * 100) AS one,
       printf('%.2f%%', shortage_probability * 100) AS two FROM predictions""",
)
def d12(spark, d):
    p = F.col("shortage_probability")
    return shared.scored(spark, d).select(
        "order_number", "product_code", tx.percent_one(p).alias("one"), tx.percent_two(p).alias("two")
    )


_SHORT = """(SELECT p.*, CASE WHEN s.list IS NOT NULL THEN '📞 Offer substitutes' ELSE '📞 Notify of potential delay' END
    AS recommended_action, coalesce(s.list, 'None Found') AS substitutes FROM predictions p LEFT JOIN (
    SELECT product_code, string_agg(substitute, ', ' ORDER BY rank) AS list FROM substitute_list WHERE rank <= 3
    GROUP BY 1) s ON p.product_code = s.product_code WHERE p.risk_level IN ('🔴 CRITICAL', '🟡 HIGH'))"""


@query(
    "d13_call_texts",
    f"""SELECT order_number, product_code,
    printf('This is a mock call script for customer %s about product %s. We suggest substitutes: %s.',
           CAST(customer_number AS VARCHAR), product_code, substitutes) AS script,
    'You are a friendly and proactive logistics assistant from Example Foods. Your goal is to inform a customer about a potential shortage and offer a solution. Generate a short, professional, and friendly script for a phone call based on the following details. Keep it under 60 words. - Customer Number: '
    || customer_number || ' - Product at Risk (Code): ' || product_code || ' - Quantity Ordered: ' || order_qty
    || ' - Recommended Action: ' || recommended_action || ' - Available Substitutes: '
    || CASE WHEN substitutes <> 'None Found'
            THEN 'We have identified these potential substitutes for you: ' || substitutes || '.'
            ELSE 'Unfortunately, we don''t have an immediate substitute recommendation.' END
    || '. Start the call with ''Hi, this is a proactive notification from Example Foods regarding your recent order.'''
       AS prompt
    FROM {_SHORT}""",
)
def d13_calls(spark, d):
    todo = dispatch.short_actions(shared.predictions(spark, d), shared.top3(spark, d))
    return todo.select(
        "order_number", "product_code", messages.mock_call_script().alias("script"),
        messages.call_prompt().alias("prompt"),
    )


def _plain(number: str) -> str:
    """A number as text: whole ones without a point, an unknown one as NaN."""
    return (
        f"CASE WHEN {number} IS NULL THEN 'NaN' WHEN isinf({number}) THEN CASE WHEN {number} > 0 THEN 'Infinity' ELSE '-Infinity' END "
        f"WHEN {number} = floor({number}) THEN CAST(CAST({number} AS BIGINT) AS VARCHAR) ELSE CAST({number} AS VARCHAR) END"
    )


_PLAIN = ", ".join(
    f"{_plain(c)} AS {name}" for name, c in {"o": "order_number", "p": "product_code", "c": "customer_number", "q": "order_qty"}.items()
)


@query(
    "d13_request_mails",
    f"""SELECT order_number, product_code, customer_number, order_qty,
    'Example Foods Order Stats: ' || risk_level || ' shortage risk for order ' || o AS mail_subject,
    'Dear customer,<br><br>' || chr(10) || 'Here is an update on your order:<br><br>' || chr(10)
    || '<b>Order number:</b> ' || o || '<br>' || chr(10) || '<b>Product code:</b> ' || p || '<br>' || chr(10)
    || '<b>Quantity:</b> ' || q || '<br><br>' || chr(10) || chr(10)
    || '<b>Shortage risk level:</b> ' || risk_level || '<br>' || chr(10)
    || '<b>Shortage probability:</b> ' || printf('%.2f%%', shortage_probability * 100) || '<br><br>'
    || chr(10) || chr(10) || '<b>Recommended action:</b><br>' || chr(10) || recommended_action || '<br><br>'
    || chr(10) || chr(10) || 'Best regards,<br>' || chr(10) || 'Example Foods Support<br>' || chr(10) AS mail_body
    FROM (SELECT *, {_PLAIN} FROM routed WHERE status = 'found')""",
)
def d13_mails(spark, d):
    todo = materialize(shared.actions(spark, d), "actions")
    found = found_messages(check_requests(view(spark, d, "requests"), todo))
    return found.select(
        "order_number", "product_code", "customer_number", "order_qty", "mail_subject", "mail_body"
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "d13_request_prompts",
    f"""SELECT order_number, product_code, customer_number, order_qty, {_sql_text(messages.REQUEST_ROLE % "Example Foods")} AS role,
    printf({_sql_text(messages.REQUEST_PROMPT)}, o, p, c, q, risk_level, CAST(shortage_probability AS VARCHAR)) AS prompt
    FROM (SELECT *, {_PLAIN} FROM routed WHERE status = 'found')""",
)
def d13_prompts(spark, d):
    todo = materialize(shared.actions(spark, d), "actions")
    found = found_messages(check_requests(view(spark, d, "requests"), todo))
    return found.select("order_number", "product_code", "customer_number", "order_qty", "role", "prompt")


@query(
    "d13_error_mails",
    f"""SELECT order_number, product_code, customer_number, order_qty,
    'Invalid shortage-check input received' AS mail_subject,
    'A user submitted shortage-risk data, but no matching row was found.' || chr(10) || chr(10)
    || 'orderNumber: ' || o || chr(10) || 'productCode: ' || p || chr(10) || 'customerNumber: ' || c || chr(10)
    || 'orderQty: ' || q || chr(10) || chr(10)
    || 'Please review the dataset or the frontend validation.' || chr(10) AS mail_body
    FROM (SELECT *, {_PLAIN} FROM routed WHERE status = 'not_found')""",
)
def d13_errors(spark, d):
    todo = materialize(shared.actions(spark, d), "actions")
    failed = error_rows(check_requests(view(spark, d, "requests"), todo))
    return failed.select(
        "order_number", "product_code", "customer_number", "order_qty", "mail_subject", "mail_body"
    )


@query(
    "d14_order_option",
    """SELECT 'Order: ' || order_number || ' | Product: ' || product_code AS label, order_number, product_code
    FROM actions""",
)
def d14(spark, d):
    label = tx.order_option(F.col("order_number"), F.col("product_code")).alias("label")
    labelled = shared.actions(spark, d).select(label)
    return labelled.select(
        "label",
        tx.option_order_number(F.col("label")).alias("order_number"),
        tx.option_product_code(F.col("label")).alias("product_code"),
    )


@query("d15_processed_at", "SELECT payload, TRUE AS is_iso FROM requests")
def d15(spark, d):
    """The time itself differs from run to run; its form does not."""
    now = dt.iso_timestamp(F.current_timestamp())
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
    return view(spark, d, "requests").select("payload", now.rlike(shape).alias("is_iso"))


@query(
    "d16_order_date_as_of",
    """SELECT CAST(999998 AS BIGINT) AS order_number, DATE '2025-10-01' AS order_created_date,
       product_code, CAST(1 AS DOUBLE) AS order_qty,
       (SELECT customer_number FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS customer_number,
       (SELECT plant FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS plant,
       (SELECT storage_location FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS storage_location
    FROM (SELECT DISTINCT salesUnitGtin AS product_code FROM products)""",
)
def d16(spark, d):
    return product_orders(view(spark, d, "products"), shared.clean(spark, d), as_of="2025-10-01")
