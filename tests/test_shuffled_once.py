"""Lines are not shuffled more often than the results need, and hot products still spread."""

import re

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import cleaning, features
from shelfcast.operators import states as sx
from shelfcast.operators import stats as st

LINES = "order_number BIGINT, day STRING, customer_number BIGINT, product_code STRING, order_qty DOUBLE, delivered_qty DOUBLE, lead_time_days INT, is_shortage TINYINT, vendorName STRING, plant STRING"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i // 3 if i % 17 else None, f"d{i % 4}", i % 7 if i % 13 else None, f"p{i % 5}" if i % 11 else None, float(i % 9), 1.0, i % 6, i % 2, "v", None) for i in range(300)]
    return spark.createDataFrame(rows + rows[:20], LINES)



def by_key(df, keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_distinct_orders_of_products_take_one_shuffle(lines, monkeypatch):
    wanted = {"product": (["product_code"], st.product_stats(lines)), "customer_product": (["customer_number", "product_code"], st.customer_product_stats(lines))}
    for limit, most in ((10**6, 1), (1, 2)):
        monkeypatch.setattr(st, "SLICE_ROWS", limit)
        tables = st.training_stats(lines)
        for name, (keys, want) in wanted.items():
            assert len(re.findall("Exchange hashpartitioning", tables[name]._jdf.queryExecution().executedPlan().toString())) == most
            got, want = by_key(tables[name], keys), by_key(want, keys)
            assert got.keys() == want.keys()
            for key, row in want.items():
                for c in row.asDict():
                    assert got[key][c] == row[c] or abs(got[key][c] - row[c]) < 1e-9, (key, c)


def test_orders_of_all_statistics_are_one_table(spark, lines, tmp_path, monkeypatch):
    states = sx.line_states(lines, F.col("day"))
    assert "order_rows" in states and not any(name.endswith("_orders") for name in states) and "customer_product" not in states
    for limit in (10**6, 1):
        monkeypatch.setattr(sx, "SLICE_ROWS", limit)
        # the last days come twice, and an order has lines on several days
        path = str(tmp_path / str(limit))
        sx.store_states(sx.line_states(lines.where("day < 'd2'"), F.col("day")), path)
        got = [sx.continued_stats(path, lines.where("day >= 'd2'"), F.col("day")) for _ in range(2)][-1]
        for name, build in {"product": st.product_stats, "customer": st.customer_stats, "customer_product": st.customer_product_stats, "vendor": st.vendor_stats, "plant": st.plant_stats}.items():
            keys = sx.STATISTICS[name].keys
            want = by_key(build(lines), keys)
            have = by_key(got[name], keys)
            assert have.keys() == want.keys()
            for key, row in want.items():
                for c in row.asDict():
                    assert have[key][c] == row[c] or abs(have[key][c] - row[c]) < 1e-9, (name, key, c)


def test_many_parts_get_a_file_each(lines, tmp_path, monkeypatch):
    for most, folder in ((32, "few"), (1, "many")):
        monkeypatch.setattr(sx, "FEW_PARTS", most)
        sx.store_states(sx.line_states(lines, F.col("day")), str(tmp_path / folder))
        days = list((tmp_path / folder / "product").glob("part=*"))
        assert len(days) == 4
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in days)


def test_hot_codes_are_looked_for_in_the_given_table(spark, monkeypatch):
    sales = spark.createDataFrame(
        [(1, "2024-01-01", "2024-01-02", "2024-01-02", 7, p, 2.0, 1.0, 1.0, 3, 4) for p in (1, 2)],
        "order_number long, order_created_date string, requested_delivery_date string, picking_confirmed_date string, customer_number long, product_code long, order_qty double, delivered_qty double, picking_picked_qty double, plant int, storage_location int",
    )
    products = spark.createDataFrame([(1, "c", "v", "t")], "salesUnitGtin long, category string, vendorName string, temperatureCondition string")
    codes = spark.createDataFrame([(1,), (2,), (3,)], "product_code long")
    counted = []
    monkeypatch.setattr(cleaning, "attach", lambda df, master, keys, count_from, **bounds: counted.append(sorted(r[0] for r in count_from.collect())) or df.join(master, keys, "left"))
    got = cleaning.clean_orders_with_products(sales, products, codes=codes)
    assert counted == [["1", "2", "3"]] and {(r["product_code"], r["vendorName"]) for r in got.collect()} == {("1", "v"), ("2", "UNKNOWN")}


def test_calendar_columns_are_added_after_the_join(spark, monkeypatch):
    rows = [(o, p, o % 2, "UNKNOWN", 5.0, 5.0, 5.0, 120000, 0) for o in range(6) for p in ("a", "b")]
    clean = spark.createDataFrame(rows, "order_number long, product_code string, customer_number long, plant string, order_qty double, delivered_qty double, picking_picked_qty double, order_created_time long, is_shortage int").withColumns(
        {"order_created_date": F.lit("2024-05-03").cast("date"), "requested_delivery_date": F.lit("2024-05-05").cast("date"), **{c: F.lit("UNKNOWN") for c in ("vendorName", "category", "temperatureCondition", "storage_location")}}
    )
    joined = []
    attach = features.attach_training_stats
    monkeypatch.setattr(features, "attach_training_stats", lambda lines, *rest: joined.append(lines.columns) or attach(lines, *rest))
    got = features.engineer_features(clean, clean.limit(0), max_broadcast_rows=0)
    assert "order_month" not in joined[0] and got.columns[: len(clean.columns) + 7] == features.date_features(clean).columns
    assert {(r["order_month"], r["lead_time_days"], r["is_weekend"]) for r in got.collect()} == {(5, 2, 1)}
