"""The input tables of the engine, shaped from the given ones.

``VIEWS`` is SQL that runs unchanged in Spark and in the checking database, except
that Spark takes the cheaper form in ``ONE_PASS``;
``CTES`` adds intermediate results in the checking database's dialect only, so
that the reference SQL is independent of the Spark code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("lineitem", "orders", "supplier", "part")

#: Order lines that a task of a scan or a shuffle is planned for at most; a hash table of that many rows is some 200 MB.
LINES_OF_A_TASK = 250_000

VIEWS = {
    "sales_base": """
SELECT l_orderkey AS order_number,
       CASE WHEN l_orderkey % 211 = 0 THEN '1970-01-01' WHEN l_orderkey % 307 = 0 THEN 'n/a'
            ELSE substr(CAST(o_orderdate AS string), 1, 10) END AS order_created_date,
       (l_orderkey % 24) * 10000 + (l_orderkey % 60) * 101 AS order_created_time,
       CAST(CAST(o_orderdate AS date) + (1 + l_linenumber % 5) AS string) AS requested_delivery_date,
       CASE WHEN l_linestatus = 'O' THEN '1970-01-01'
            ELSE CAST(CAST(o_orderdate AS date) + 1 AS string) END AS picking_confirmed_date,
       o_custkey AS customer_number,
       CASE WHEN l_orderkey % 499 = 0 AND l_linenumber = 1 THEN 9000000 + l_orderkey ELSE l_partkey END AS product_code,
       l_quantity AS order_qty,
       CASE WHEN l_partkey % 29 = 0 AND l_quantity > 10 AND l_linestatus = 'O' THEN NULL
            WHEN l_partkey % 29 = 0 AND l_quantity > 10 THEN l_quantity - 5
            WHEN l_returnflag = 'R' AND l_discount >= 0.095 THEN l_quantity - 1
            ELSE l_quantity END AS delivered_qty,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS picking_picked_qty,
       CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE s_nationkey END AS plant,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE 2000 + l_linenumber END AS storage_location
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "sales": """
SELECT * FROM sales_base UNION ALL SELECT * FROM sales_base WHERE order_number % 101 = 0""",
    "products": """
SELECT CAST(p_partkey AS string) AS salesUnitGtin,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS category,
       p_brand AS vendorName,
       CASE WHEN p_size < 17 THEN 'FROZEN' WHEN p_size < 34 THEN 'CHILLED' ELSE 'AMBIENT' END AS temperatureCondition,
       CASE WHEN p_partkey % 2 = 0 THEN 'KPL' ELSE 'LTK' END AS salesUnit
FROM part WHERE p_partkey % 10 <> 9""",
    "purchases": """
SELECT l_orderkey * 3 AS order_number, l_partkey AS product_code, l_quantity AS ordered_qty,
       CASE WHEN l_tax >= 0.075 THEN l_quantity - 1 ELSE l_quantity END AS received_qty
FROM lineitem WHERE l_linestatus = 'F'""",
    "replacements": """
SELECT * FROM sales WHERE order_number % 3 = 0 AND product_code % 5 = 0""",
    "scored": """
SELECT order_number, product_code, customer_number, order_qty, delivered_qty,
       CAST((order_number * 7919 + product_code * 104729 + CAST(order_qty AS bigint) * 31) % 10007 AS double) / 10007 AS shortage_probability
FROM (SELECT DISTINCT * FROM sales)""",
    # One request in 29 of each odd kind; the others are plain, half of them under ``body``.
    "requests": """
SELECT CASE order_number % 29
         WHEN 1 THEN concat('{"orderNumber":"0x', hex(order_number), '","productCode":" ', product_code, ' ","customerNumber":"+', customer_number, '","orderQty":"', order_qty, 'e0","customerEmail":"', chr(92), 'tx@example.com "}')
         WHEN 2 THEN concat('{"orderNumber":"', order_number, 'd","productCode":', product_code, ',"customerNumber":', customer_number, ',"orderQty":', order_qty, '}')
         WHEN 3 THEN concat('{"orderNumber":"","body":{"orderNumber":', order_number, '},"productCode":', product_code, ',"customerNumber":', customer_number, ',"orderQty":', order_qty, '}')
         WHEN 4 THEN concat('{"orderNumber":', order_number, ',"productCode":true,"customerNumber":false,"orderQty":', order_qty, '}')
         WHEN 5 THEN 'no json {'
         WHEN 6 THEN concat('{"orderNumber":null,"body":{"orderNumber":"', order_number, '"},"productCode":', product_code, ',"customerNumber":', customer_number, ',"orderQty":', order_qty, '}')
         WHEN 7 THEN concat('{"orderNumber":[', order_number, '],"productCode":["', product_code, '"],"customerNumber":[],"orderQty":[1,2]}')
         WHEN 8 THEN concat('{"orderNumber":{"value":', order_number, '},"productCode":', product_code, ',"customerNumber":', customer_number, ',"orderQty":', order_qty, '}')
         WHEN 9 THEN concat('{"orderNumber":"-Infinity","productCode":"', product_code, '_0","customerNumber":".5","orderQty":"5."}')
         WHEN 10 THEN '{}'
         WHEN 11 THEN concat('{"body":"', order_number, '","orderNumber":"0b101","productCode":"0o17","customerNumber":"0x","orderQty":"-0x1"}')
         WHEN 12 THEN concat('[', order_number, ']')
         ELSE CASE WHEN order_number % 2 = 0
            THEN concat('{"orderNumber":"', order_number, '","productCode":"', product_code, '","customerNumber":', customer_number, ',"orderQty":', order_qty + CASE WHEN order_number % 5 = 0 THEN 1000 ELSE 0 END, ',"customerEmail":" c', customer_number, '@example.com "}')
            ELSE concat('{"body":{"orderNumber":', order_number, ',"productCode":', product_code, ',"customerNumber":', customer_number, ',"orderQty":', order_qty + CASE WHEN order_number % 5 = 0 THEN 1000 ELSE 0 END, '}}') END
       END AS payload
FROM scored""",
}

# The same rows in one pass over the given tables: copies by repetition, not by a
# second scan and join.
ONE_PASS = {
    "sales": """
SELECT * EXCEPT (copy) FROM sales_base
LATERAL VIEW explode(sequence(1, CASE WHEN order_number % 101 = 0 THEN 2 ELSE 1 END)) AS copy""",
    # Product codes of all given lines, without the joins of ``sales``: hot codes are looked for in them.
    "sold_codes": """
SELECT CASE WHEN l_orderkey % 499 = 0 AND l_linenumber = 1 THEN 9000000 + l_orderkey ELSE l_partkey END AS product_code
FROM lineitem""",
}

# Columns of a request and the payload's fields for them.
_FIELDS = {"order_number": "orderNumber", "product_code": "productCode", "customer_number": "customerNumber", "order_qty": "orderQty"}


def number_of_text_sql(text: str) -> str:
    """SQL for the number a text stands for, null if none."""
    plain = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
    return (
        f"CASE WHEN {plain} = '' THEN 0.0e0 WHEN regexp_full_match({plain}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|[+-]?Infinity') THEN TRY_CAST({plain} AS DOUBLE) "
        f"WHEN regexp_full_match({plain}, '0[xX][0-9a-fA-F]{{1,15}}') THEN CAST(CAST({plain} AS BIGINT) AS DOUBLE) "
        f"WHEN regexp_full_match({plain}, '0[bB][01]{{1,60}}') THEN list_sum(list_transform(range(3, len({plain}) + 1), lambda i: CAST(substr({plain}, i, 1) AS DOUBLE) * 2 ** (len({plain}) - i))) "
        f"WHEN regexp_full_match({plain}, '0[oO][0-7]{{1,20}}') THEN list_sum(list_transform(range(3, len({plain}) + 1), lambda i: CAST(substr({plain}, i, 1) AS DOUBLE) * 8 ** (len({plain}) - i))) END"
    )


def number_sql(field: str) -> str:
    """SQL for the number of a JSON field: 0 if it is not given, null if it is none."""
    return (
        f"CASE coalesce(json_type({field}), 'NULL') WHEN 'NULL' THEN 0.0e0 WHEN 'BOOLEAN' THEN CASE WHEN {field}->>'$' = 'true' THEN 1.0e0 ELSE 0.0e0 END "
        f"WHEN 'VARCHAR' THEN {number_of_text_sql(f"({field}->>'$')")} WHEN 'OBJECT' THEN NULL "
        f"WHEN 'ARRAY' THEN CASE WHEN json_array_length({field}) < 2 THEN {number_of_text_sql(f"coalesce({field}->>'$[0]', '')")} END "
        f"ELSE TRY_CAST({field}->>'$' AS DOUBLE) END"
    )


# Reference results that several checks build on.
CTES = {
    **VIEWS,
    "clean": """
SELECT DISTINCT order_number,
       NULLIF(TRY_CAST(order_created_date AS DATE), DATE '1970-01-01') AS order_created_date,
       order_created_time,
       NULLIF(TRY_CAST(requested_delivery_date AS DATE), DATE '1970-01-01') AS requested_delivery_date,
       NULLIF(TRY_CAST(picking_confirmed_date AS DATE), DATE '1970-01-01') AS picking_confirmed_date,
       customer_number, CAST(product_code AS VARCHAR) AS product_code, order_qty,
       COALESCE(delivered_qty, 0) AS delivered_qty, COALESCE(picking_picked_qty, 0) AS picking_picked_qty,
       COALESCE(CAST(plant AS VARCHAR), 'UNKNOWN') AS plant,
       COALESCE(CAST(storage_location AS VARCHAR), 'UNKNOWN') AS storage_location,
       CAST(order_qty > COALESCE(delivered_qty, 0)
            OR (COALESCE(delivered_qty, 0) = 0 AND order_qty > 0) AS TINYINT) AS is_shortage,
       'UNKNOWN' AS vendorName, 'UNKNOWN' AS category, 'UNKNOWN' AS temperatureCondition
FROM sales""",
    "enriched": """
SELECT DISTINCT c.* EXCLUDE (vendorName, category, temperatureCondition),
       COALESCE(p.vendorName, 'UNKNOWN') AS vendorName, COALESCE(p.category, 'UNKNOWN') AS category,
       COALESCE(p.temperatureCondition, 'UNKNOWN') AS temperatureCondition, p.salesUnit
FROM clean c LEFT JOIN products p ON c.product_code = p.salesUnitGtin""",
    "dated": """
SELECT *, CAST(isodow(order_created_date) AS INTEGER) AS order_day_of_week,
       CAST(day(order_created_date) AS INTEGER) AS order_day_of_month,
       CAST(month(order_created_date) AS INTEGER) AS order_month,
       CAST(quarter(order_created_date) AS INTEGER) AS order_quarter,
       CAST(isodow(order_created_date) >= 5 AS TINYINT) AS is_weekend,
       CAST(requested_delivery_date - order_created_date AS INTEGER) AS lead_time_days,
       CAST(floor(order_created_time / 10000) AS BIGINT) AS order_hour
FROM enriched""",
    "product_stats": """
SELECT product_code, avg(is_shortage) AS product_shortage_rate, avg(order_qty) AS product_avg_order_qty,
       stddev_samp(order_qty) AS product_order_qty_std, avg(delivered_qty) AS product_avg_delivered_qty,
       CAST(count(DISTINCT order_number) AS BIGINT) AS product_order_count
FROM dated GROUP BY product_code""",
    "category_stats": """
SELECT category, avg(is_shortage) AS category_shortage_rate FROM dated GROUP BY category""",
    "temperature_stats": """
SELECT temperatureCondition, avg(is_shortage) AS temp_condition_shortage_rate
FROM dated GROUP BY temperatureCondition""",
    "customer_stats": """
SELECT customer_number, avg(is_shortage) AS customer_shortage_rate, sum(order_qty) AS customer_total_order_qty,
       CAST(count(DISTINCT order_number) AS BIGINT) AS customer_order_count,
       avg(lead_time_days) AS customer_avg_lead_time
FROM dated GROUP BY customer_number""",
    "customer_product_stats": """
SELECT customer_number, product_code, avg(is_shortage) AS customer_product_shortage_rate,
       CAST(count(DISTINCT order_number) AS BIGINT) AS customer_product_order_count
FROM dated GROUP BY customer_number, product_code""",
    "vendor_stats": """
SELECT vendorName, avg(is_shortage) AS vendor_shortage_rate,
       CAST(count(DISTINCT order_number) AS BIGINT) AS vendor_order_count
FROM dated GROUP BY vendorName""",
    "plant_stats": """
SELECT plant, avg(is_shortage) AS plant_shortage_rate,
       CAST(count(DISTINCT order_number) AS BIGINT) AS plant_order_count
FROM dated GROUP BY plant""",
    "storage_stats": """
SELECT storage_location, avg(is_shortage) AS storage_shortage_rate FROM dated GROUP BY storage_location""",
    "replacement_counts": """
SELECT CAST(product_code AS VARCHAR) AS product_code, CAST(count(*) AS BIGINT) AS replacement_frequency
FROM replacements GROUP BY 1""",
    "features": """
SELECT d.*, p.* EXCLUDE (product_code), cs.* EXCLUDE (category), t.* EXCLUDE (temperatureCondition),
       c.* EXCLUDE (customer_number), cp.customer_product_shortage_rate, cp.customer_product_order_count,
       v.* EXCLUDE (vendorName), pl.* EXCLUDE (plant), st.* EXCLUDE (storage_location),
       COALESCE(r.replacement_frequency, 0) AS replacement_frequency
FROM dated d
LEFT JOIN product_stats p ON d.product_code = p.product_code
LEFT JOIN category_stats cs ON d.category = cs.category
LEFT JOIN temperature_stats t ON d.temperatureCondition = t.temperatureCondition
LEFT JOIN customer_stats c ON d.customer_number = c.customer_number
LEFT JOIN customer_product_stats cp
       ON d.customer_number = cp.customer_number AND d.product_code = cp.product_code
LEFT JOIN vendor_stats v ON d.vendorName = v.vendorName
LEFT JOIN plant_stats pl ON d.plant = pl.plant
LEFT JOIN storage_stats st ON d.storage_location = st.storage_location
LEFT JOIN replacement_counts r ON d.product_code = r.product_code""",
    "members": """
SELECT DISTINCT category, salesUnitGtin AS product_code FROM products""",
    "heads": """
SELECT * FROM (SELECT category, product_code AS substitute,
                      row_number() OVER (PARTITION BY category ORDER BY product_code) AS place FROM members)
WHERE place <= 6""",
    "substitute_list": """
SELECT * FROM (
  SELECT m.product_code, h.substitute,
         row_number() OVER (PARTITION BY m.product_code ORDER BY coalesce(m.category, ''), h.place) AS rank
  FROM members m JOIN heads h ON m.category IS NOT DISTINCT FROM h.category AND h.substitute <> m.product_code)
WHERE rank <= 5""",
    "known_products": """
SELECT product_code FROM members UNION SELECT CAST(product_code AS VARCHAR) FROM replacements""",
    "top_substitutes": """
SELECT k.product_code, max(CASE WHEN rank = 1 THEN substitute END) AS substitute_1,
       max(CASE WHEN rank = 2 THEN substitute END) AS substitute_2,
       max(CASE WHEN rank = 3 THEN substitute END) AS substitute_3
FROM known_products k LEFT JOIN substitute_list s ON k.product_code = s.product_code
GROUP BY k.product_code""",
    "predictions": """
SELECT order_number, CAST(product_code AS VARCHAR) AS product_code, customer_number, order_qty,
       shortage_probability,
       CASE WHEN shortage_probability >= 0.8 THEN '🔴 CRITICAL'
            WHEN shortage_probability >= 0.5 THEN '🟡 HIGH'
            WHEN shortage_probability >= 0.3 THEN '🟠 MEDIUM' ELSE '🟢 LOW' END AS risk_level
FROM scored""",
    "actions": """
SELECT p.order_number, p.risk_level, p.product_code, p.customer_number, p.order_qty, p.shortage_probability,
       CASE WHEN substitute_1 IS NOT NULL THEN '📞 Contact customer - offer substitutes'
            ELSE '📞 Contact customer - notify potential delay' END AS recommended_action,
       substitute_1, substitute_2, substitute_3
FROM predictions p LEFT JOIN top_substitutes s ON p.product_code = s.product_code
WHERE p.risk_level IN ('🔴 CRITICAL', '🟡 HIGH')""",
    "fields": f"""
SELECT payload, {', '.join(
    f"CASE WHEN json_type(j->'$.{f}') <> 'NULL' THEN j->'$.{f}' ELSE j->'$.body.{f}' END AS {c}" for c, f in _FIELDS.items())},
       CASE WHEN json_type(j->'$.body.customerEmail') <> 'NULL' THEN j->>'$.body.customerEmail' ELSE j->>'$.customerEmail' END AS email
FROM (SELECT payload, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM requests)""",
    "parsed": f"""
SELECT {', '.join(f"{number_sql(c)} AS {c}" for c in _FIELDS)}, regexp_replace(coalesce(email, ''), '^\\s+|\\s+$', '', 'g') AS customer_email
FROM fields""",
    "routed": """
SELECT r.*, a.risk_level, a.shortage_probability, a.recommended_action,
       CASE WHEN a.order_number <> 0 THEN 'found' ELSE 'not_found' END AS status
FROM parsed r LEFT JOIN actions a
  ON CAST(TRY_CAST(r.customer_number AS BIGINT) AS VARCHAR) = CAST(a.customer_number AS VARCHAR)
 AND CAST(TRY_CAST(r.product_code AS BIGINT) AS VARCHAR) = a.product_code
 AND r.order_number = a.order_number AND r.order_qty = a.order_qty AND r.order_number <> 0""",
    "judged": """
SELECT order_number, product_code, order_qty,
       CAST(order_qty > coalesce(delivered_qty, 0) AS INTEGER) AS is_shortage, shortage_probability,
       CAST(shortage_probability >= 0.5 AS INTEGER) AS predicted_shortage
FROM scored""",
    "judged_models": """
SELECT 'Logistic Regression' AS model, is_shortage, shortage_probability, predicted_shortage FROM judged
UNION ALL
SELECT 'Random Forest', is_shortage, 1 - shortage_probability, CAST(1 - shortage_probability >= 0.5 AS INTEGER) FROM judged
UNION ALL
SELECT 'Gradient Boosting', is_shortage, shortage_probability * shortage_probability,
       CAST(shortage_probability * shortage_probability >= 0.5 AS INTEGER) FROM judged""",
    "model_scores": """
SELECT model, shortage_probability AS score, sum(CASE WHEN is_shortage = 1 THEN 1 ELSE 0 END) AS pos,
       sum(CASE WHEN is_shortage = 0 THEN 1 ELSE 0 END) AS neg
FROM judged_models GROUP BY 1, 2""",
    "model_auc": """
SELECT model, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM model_scores)
GROUP BY model""",
    "model_cells": """
SELECT model, sum(CASE WHEN is_shortage = 0 AND predicted_shortage = 0 THEN 1 ELSE 0 END) AS tn,
       sum(CASE WHEN is_shortage = 0 AND predicted_shortage = 1 THEN 1 ELSE 0 END) AS fp,
       sum(CASE WHEN is_shortage = 1 AND predicted_shortage = 0 THEN 1 ELSE 0 END) AS fn,
       sum(CASE WHEN is_shortage = 1 AND predicted_shortage = 1 THEN 1 ELSE 0 END) AS tp
FROM judged_models GROUP BY model""",
}


def _needed(sql: str, ctes: dict[str, str]) -> list[str]:
    """Names of the CTEs that ``sql`` uses, directly or not, in definition order."""
    used, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & ctes.keys() - used:
            used.add(name)
            todo.append(ctes[name])
    return [name for name in ctes if name in used]


def with_ctes(sql: str, ctes: dict[str, str]) -> str:
    """``sql``, which may start with CTEs of its own, behind the CTEs it needs."""
    sql = sql.strip()
    parts = [f"{name} AS ({ctes[name].strip()})" for name in _needed(sql, ctes)]
    if not parts:
        return sql
    rest = f", {sql[len('WITH '):]}" if sql.startswith("WITH ") else f" {sql}"
    return f"WITH {', '.join(parts)}{rest}"


def _plan_tasks(spark: SparkSession, sf_dir: str) -> None:
    """Let scans and shuffles start from as many partitions as the order lines need, counted from file footers.

    A session's fixed numbers would let tasks grow with the tables, also those of scans, which
    fold copies in memory. Partitions of a shuffle that turn out small are joined again when a
    query runs, and splits of files stay above the cost of opening one.
    """
    needed = -(-table(spark, sf_dir, "lineitem").count() // LINES_OF_A_TASK)
    given = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.files.minPartitionNum": spark.sparkContext.defaultParallelism,
    }
    for setting, default in given.items():
        if needed > int(spark.conf.get(setting, None) or default):
            spark.conf.set(setting, needed)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table of the engine, read from the parquet files in ``sf_dir``."""
    _plan_tasks(spark, sf_dir)
    given = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in GIVEN}
    return spark.sql(with_ctes(f"SELECT * FROM {name}", {**given, **VIEWS, **ONE_PASS}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
