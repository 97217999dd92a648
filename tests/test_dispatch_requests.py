import json

import pytest
from pyspark.sql import functions as F

from shelfcast import config as c
from shelfcast import schemas
from shelfcast.operators import dispatch as ds
from shelfcast.operators import orders as od
from shelfcast.operators import requests as rq
from shelfcast.operators.explain import explain, explain_text
from shelfcast.sources import read_actions, write_actions
from shelfcast.streaming import read_checked, request_stream, run_order_checks, store_checked

SCORED = "order_number BIGINT, product_code STRING, customer_number BIGINT, order_qty DOUBLE, shortage_probability DOUBLE"


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(
        [
            (1, "a", 10, 1.0, 0.95), (2, "b", 11, 2.0, 0.6), (3, "a", 10, 3.0, 0.4), (4, "c", 12, 1.35, 0.99),
            (5, "z", 12, 4.0, None), (6, "a", 10, 4.0, float("nan")), (7, "b", 13, 3.2, 0.5),
        ],
        SCORED,
    )


@pytest.fixture(scope="module")
def subs(spark):
    return spark.createDataFrame(
        [("a", ["b", "c", "d"]), ("b", ["a"]), ("c", [])], "product_code STRING, substitutes ARRAY<STRING>"
    )


@pytest.mark.parametrize("limit", [0, 1000])
def test_actions(scored, subs, limit):
    _, todo = ds.dispatch(scored, subs, max_broadcast_rows=limit)
    got = [tuple(r) for r in todo.collect()]
    assert [r[0] for r in got] == [4, 1, 2, 7]
    offer, notify = c.ACTION_LABELS
    assert got[0][6:] == (notify, None, None, None)
    assert got[1][6:] == (offer, "b", "c", "d")
    assert got[2][6:] == (offer, "a", None, None)
    assert {r[1] for r in got} == {c.CRITICAL, c.HIGH}


def test_actions_keep_the_published_shape(scored, subs, spark, tmp_path):
    """Header, order and consistency of the action list as it is handed out."""
    _, todo = ds.dispatch(scored, subs)
    path = str(tmp_path / "actions")
    write_actions(todo, path)
    back = read_actions(spark, path)
    assert back.columns == [
        "order_number", "risk_level", "product_code", "customer_number", "order_qty",
        "shortage_probability", "recommended_action", "substitute_1", "substitute_2", "substitute_3",
    ]
    rows = back.collect()
    probabilities = [r["shortage_probability"] for r in rows]
    assert probabilities == sorted(probabilities, reverse=True)
    assert all((p >= 0.8) == (r["risk_level"] == c.CRITICAL) for p, r in zip(probabilities, rows))
    assert all((r["substitute_1"] is None) == (r["recommended_action"] == c.ACTION_LABELS[1]) for r in rows)
    assert 1.35 in {r["order_qty"] for r in rows}


def test_no_high_risk_means_no_actions(scored, subs):
    _, todo = ds.dispatch(scored.where("shortage_probability < 0.45"), subs)
    assert todo.count() == 0 and "substitute_3" in todo.columns


def test_summary_shows_all_levels(scored):
    rows = ds.risk_summary(ds.with_risk_level(scored.where("order_number < 4"))).orderBy("level_order").collect()
    assert [(r["risk_level"], r["orders"]) for r in rows] == [(c.CRITICAL, 1), (c.HIGH, 1), (c.MEDIUM, 1), (c.LOW, 0)]
    assert sum(r["pct"] for r in rows) == pytest.approx(100)
    empty = ds.risk_summary(ds.with_risk_level(scored.limit(0))).collect()
    assert [r["orders"] for r in empty] == [0, 0, 0, 0]


def test_short_variant(scored, subs):
    rows = {r["order_number"]: r for r in ds.short_actions(ds.with_risk_level(scored), subs).collect()}
    assert rows[1]["substitutes"] == "b, c, d" and rows[4]["substitutes"] == "None Found"
    assert rows[4]["recommended_action"] == c.SHORT_ACTION_LABELS[1]


def test_descending_orders_put_the_unknown_first(scored, spark):
    assert od.top_predictions(scored, 1).first()["order_number"] in (5, 6)
    df = spark.createDataFrame([(1, "2025-01-02"), (2, None), (3, "2025-01-03")], "order_number INT, d STRING")
    df = df.select("order_number", F.col("d").cast("date").alias("order_created_date"))
    assert [r["order_number"] for r in od.newest(df, 3).collect()] == [2, 3, 1]


def test_key_overlap_counts_keys_once(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "a INT")
    right = spark.createDataFrame([("1",), ("1",), ("9",)], "b STRING")
    assert tuple(od.key_overlap(left, "a", right, "b").first()) == (1, 3)


def test_notified(scored, subs, spark):
    _, todo = ds.dispatch(scored, subs)
    done = spark.createDataFrame([(4,), (4,), (99,)], "order_number BIGINT")
    got = {r["order_number"]: r["status"] for r in od.notified_status(todo, done).collect()}
    assert got == {4: c.NOTIFIED, 1: c.PENDING, 2: c.PENDING, 7: c.PENDING}


def test_explain_ranks_by_size_of_contribution(spark):
    row = spark.createDataFrame(
        [(1, "p", 5.0, -9.0, None, float("nan"))],
        "order_number INT, product_code STRING, order_qty DOUBLE, lead_time_days DOUBLE, "
        "order_month DOUBLE, order_hour DOUBLE",
    )
    weights = {"order_qty": 1.0, "lead_time_days": 1.0, "order_month": 5.0, "order_hour": 5.0}
    got = [(r["rank"], r["feature"], r["contribution"]) for r in explain(row, weights).orderBy("rank").collect()]
    assert got == [
        (1, "lead_time_days", -9.0), (2, "order_qty", 5.0), (3, "order_month", None), (4, "order_hour", None),
    ]
    text = explain_text(row, weights, 2).first()["explanation"]
    assert text == (
        "📊 Top Risk Factors:\n   1. " + "lead_time_days".ljust(40, ".") + " -9.0000\n"
        "   2. " + "order_qty".ljust(40, ".") + " 5.0000"
    )


def test_explain_shuffles_nothing(scored):
    plan = explain(scored, {"order_qty": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


PAYLOADS = [
    {"orderNumber": 1, "productCode": "77", "customerNumber": 10, "orderQty": 1.0, "customerEmail": " a@b.fi "},
    {"body": {"orderNumber": "2", "productCode": 78, "customerNumber": "11", "orderQty": 2}},
    {"orderNumber": 1, "productCode": "77", "customerNumber": 10, "orderQty": 9},
    {"productCode": 77},
    {"orderNumber": "x", "productCode": "77", "customerNumber": 10, "orderQty": 1.0, "body": {"orderNumber": 1}},
]


@pytest.fixture(scope="module")
def action_list(spark):
    rows = [
        (1, c.CRITICAL, "77", 10, 1.0, 0.95, "call", None, None, None),
        (2, c.HIGH, "78", 11, 2.0, 0.55, "call", "77", None, None),
        (0, c.HIGH, "77", 0, 0.0, 0.55, "zero", None, None, None),
    ]
    return spark.createDataFrame(rows, schemas.ACTIONS)


def payloads(spark):
    return spark.createDataFrame([(json.dumps(p),) for p in PAYLOADS], schemas.REQUESTS)


def test_requests_are_routed(spark, action_list):
    got = rq.check_requests(payloads(spark), action_list).collect()
    assert [r["status"] for r in got].count(rq.FOUND) == 2
    found = {r["order_number"]: r for r in got if r["status"] == rq.FOUND}
    assert found[1.0]["risk_level"] == c.CRITICAL and found[1.0]["customer_email"] == "a@b.fi"
    assert found[2.0]["customer_email"] == ""
    assert len(got) == 5


def test_order_zero_is_not_found_even_when_listed(spark, action_list):
    df = spark.createDataFrame([(json.dumps({"productCode": 77}),)], schemas.REQUESTS)
    assert rq.check_requests(df, action_list).first()["status"] == rq.NOT_FOUND


def test_messages(spark, action_list):
    routed = rq.check_requests(payloads(spark), action_list)
    mail = rq.found_messages(routed, "Acme").where("order_number = 1").first()
    assert mail["mail_subject"] == f"Acme Order Stats: {c.CRITICAL} shortage risk for order 1"
    assert "<b>Shortage probability:</b> 95.00%<br>" in mail["mail_body"]
    assert "- Product code: 77\n" in mail["prompt"]
    signed = rq.found_messages(routed, "Acme", "help@acme.test").where("order_number = 1").first()
    assert signed["mail_body"] == mail["mail_body"] + "(help@acme.test)\n"
    assert mail["role"].startswith("You are a supply-chain assistant for Acme.")
    errors = rq.error_rows(routed).collect()
    assert len(errors) == 3 and {r["success"] for r in errors} == {"false"}
    assert any("orderQty: 9" in r["mail_body"] for r in errors)


def test_stream_equals_batch_and_resumes(spark, action_list, rows, tmp_path):
    inbox, log, errors, mark = (str(tmp_path / n) for n in ("in", "log", "err", "mark"))
    payloads(spark).limit(2).write.text(inbox)
    args = (action_list, log, errors, mark)
    for q in run_order_checks(request_stream(spark, inbox, 1), *args):
        q.awaitTermination()
    assert read_checked(spark, log).count() == 2
    payloads(spark).write.mode("append").text(inbox)
    for q in run_order_checks(request_stream(spark, inbox), *args):
        q.awaitTermination()
    everything = payloads(spark).limit(2).union(payloads(spark))
    routed = rq.check_requests(everything, action_list)
    batch = rq.log_rows(routed).drop("timestamp")
    assert rows(read_checked(spark, log).drop("timestamp")) == rows(batch)
    assert rows(read_checked(spark, errors)) == rows(rq.error_rows(routed))


def test_a_repeated_batch_adds_nothing(spark, action_list, rows, tmp_path):
    inbox, log, errors, mark = (str(tmp_path / n) for n in ("in", "log", "err", "mark"))
    payloads(spark).repartition(3).write.text(inbox)
    args = (action_list, log, errors, mark)
    for q in run_order_checks(request_stream(spark, inbox, 2), *args):
        q.awaitTermination()
    before = rows(read_checked(spark, log).drop("timestamp")), rows(read_checked(spark, errors))
    # as after a failure between the writes and the commit of the last batch
    last = max((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    queries = run_order_checks(request_stream(spark, inbox, 2), *args)
    for q in queries:
        q.awaitTermination()
    assert queries[0].lastProgress is not None and last.exists()
    assert (rows(read_checked(spark, log).drop("timestamp")), rows(read_checked(spark, errors))) == before
    # and the same batch handed over twice
    for _ in range(2):
        store_checked(payloads(spark), 77, action_list, log, errors)
    assert read_checked(spark, log).count() == len(before[0]) + 2
    assert read_checked(spark, errors).count() == len(before[1]) + 3


def test_payloads_are_parsed_once_for_both_outputs(spark, action_list):
    routed = rq.check_requests(payloads(spark), action_list)
    for rows in (routed, rq.found_messages(routed), rq.error_rows(routed), rq.log_rows(routed)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") + plan.count("parseJson") == 1


def test_requests_that_match_nothing_have_no_key(spark, action_list):
    looked = rq.look_up(rq.parse_requests(payloads(spark)), action_list, max_broadcast_rows=0, slice_rows=1)
    assert looked.count() == 5
    assert rq.route(looked).where("status = 'found'").count() == 2
