"""Factors are ranked by short entries, each row once, with the order of ties and unknown values kept."""

from shelfcast.operators.explain import explain, explain_text

NAN = float("nan")


def _rows(spark):
    rows = [(1, 2.0, None, 0.0, -3.0), (2, NAN, 1.0, 1.0, 0.5), (3, None, None, None, None), (4, -0.0, 0.0, 5.0, 1e300)]
    return spark.createDataFrame(rows, "order_number long, order_qty double, lead_time_days double, order_hour double, is_weekend double")


WEIGHTS = {"order_qty": 1.0, "lead_time_days": 1.0, "is_weekend": 0.5}


def test_order_of_factors(spark):
    got = {}
    for r in explain(_rows(spark), WEIGHTS, 3).orderBy("order_number", "rank").collect():
        got.setdefault(r["order_number"], []).append((r["rank"], r["feature"], r["value"], r["importance"], r["contribution"]))
    # order of features: order_qty, is_weekend, lead_time_days, order_hour
    assert got[1] == [(1, "order_qty", 2.0, 1.0, 2.0), (2, "is_weekend", -3.0, 0.5, -1.5), (3, "order_hour", 0.0, 0.0, 0.0)]
    assert got[2] == [(1, "lead_time_days", 1.0, 1.0, 1.0), (2, "is_weekend", 0.5, 0.5, 0.25), (3, "order_hour", 1.0, 0.0, 0.0)]
    assert [f[1:3] for f in got[3]] == [("order_qty", None), ("is_weekend", None), ("lead_time_days", None)]
    assert [f[1] for f in got[4]] == ["is_weekend", "order_qty", "lead_time_days"]
    text = {r["order_number"]: r["explanation"].split("\n")[1:] for r in explain_text(_rows(spark), WEIGHTS, 3).collect()}
    for number, factors in got.items():
        assert [line[6:46].rstrip(".") for line in text[number]] == [f[1] for f in factors]


def test_each_row_is_sorted_once_and_not_by_a_lambda(spark):
    plan = explain(_rows(spark), WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sort_array(") == 1 and "array_sort(" not in plan
    assert "size(slice(" not in plan
