"""Requests that meet a long list are parsed once, not once for their hot keys and once more for the join."""

import pytest

from shelfcast.operators import requests as rq


@pytest.mark.parametrize("rows, parses", [(0, False), (10, True)])
def test_parsing_is_no_part_of_a_shuffled_lookup(spark, rows, parses):
    payloads = spark.createDataFrame(
        [('{"orderNumber":7,"productCode":"5","customerNumber":3,"orderQty":2}',), ('{"orderNumber":8,"productCode":"5","customerNumber":3,"orderQty":2}',), ("no json",)],
        "payload string",
    )
    actions = spark.createDataFrame(
        [(7, "5", 3, 2.0, "HIGH", 0.6, "call")],
        "order_number long, product_code string, customer_number long, order_qty double, risk_level string, shortage_probability double, recommended_action string",
    )
    routed = rq.check_requests(payloads, actions, max_broadcast_rows=rows)
    plan = routed._jdf.queryExecution().optimizedPlan().toString().lower()
    assert ("parse_json" in plan or "parsejson" in plan) == parses
    assert sorted((r["order_number"], r["status"]) for r in routed.collect()) == [(0.0, "not_found"), (7.0, "found"), (8.0, "not_found")]
