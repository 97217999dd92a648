"""Statistics from stored states equal those of all lines, in whatever steps the lines came."""

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import states as sx
from shelfcast.operators import stats as st

LINES = "order_number BIGINT, day STRING, customer_number BIGINT, product_code STRING, order_qty DOUBLE, delivered_qty DOUBLE, lead_time_days INT, is_shortage TINYINT, category STRING, plant STRING"


@pytest.fixture(scope="module")
def lines(spark):
    rows = []
    for i in range(400):
        # far from zero, where sums of squares would lose the deviation
        qty = None if i % 37 == 0 else 1e8 + (i * i) % 11
        rows.append((i // 3, f"d{i % 5}", i % 7 if i % 13 else None, f"p{i % 4}", qty, qty and qty - i % 2, i % 9 if i % 8 else None, i % 2, "c" if i % 3 else None, "one"))
    rows.append((999, None, 50, "alone", 3.0, 3.0, 1, 0, None, "two"))
    return spark.createDataFrame(rows, LINES)


def same(got, want, keys):
    columns = [c for c in want.columns]
    a = {tuple(r[k] for k in keys): r for r in got.select(columns).collect()}
    b = {tuple(r[k] for k in keys): r for r in want.collect()}
    assert a.keys() == b.keys()
    for key, row in b.items():
        for c in columns:
            x, y = a[key][c], row[c]
            assert (x is None) == (y is None) and (x is None or x == y or abs(x - y) < 1e-6), (key, c, x, y)


def tables(lines):
    return {"product": st.product_stats(lines), "customer": st.customer_stats(lines), "customer_product": st.customer_product_stats(lines), "category": st.category_stats(lines), "plant": st.plant_stats(lines)}


def test_finished_states_equal_statistics(lines):
    got = sx.finished(sx.line_states(lines, F.col("day")))
    for name, want in tables(lines).items():
        same(got[name], want, sx.STATISTICS[name].keys)
    assert set(got) == set(tables(lines))


def test_days_are_added_and_replaced(spark, lines, tmp_path):
    path = str(tmp_path / "states")
    wrong = lines.where("day = 'd3'").withColumn("order_qty", F.lit(1.0))
    sx.store_states(sx.line_states(lines.where("day in ('d0', 'd1')").unionByName(wrong), F.col("day")), path)
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "states").glob("product/part=d0/*.parquet")}
    sx.store_states(sx.line_states(lines.where("day in ('d2', 'd4') or day is null"), F.col("day")), path)
    for _ in range(2):
        got = sx.continued_stats(path, lines.where("day = 'd3'"), F.col("day"))
    for name, want in tables(lines).items():
        same(got[name], want, sx.STATISTICS[name].keys)
    assert untouched and untouched == {p: p.stat().st_mtime_ns for p in (tmp_path / "states").glob("product/part=d0/*.parquet")}


def test_sketched_orders_are_near(lines):
    parts = [sx.line_states(lines.where(c), F.col("day"), sketch=True) for c in ("day < 'd2'", "day >= 'd2' or day is null")]
    got = sx.finished(sx.merge_states(*parts))
    assert not any(name.endswith("_orders") for p in parts for name in p)
    exact = {r["product_code"]: r["product_order_count"] for r in st.product_stats(lines).collect()}
    for r in got["product"].collect():
        assert abs(r["product_order_count"] - exact[r["product_code"]]) <= 0.06 * exact[r["product_code"]] + 0.5


def test_no_lines_give_no_statistics(lines):
    got = sx.finished(sx.line_states(lines.limit(0), F.col("day")))
    assert all(t.count() == 0 for t in got.values())
