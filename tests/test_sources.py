import json

import pytest

from shelfcast import schemas
from shelfcast import sources as so
from shelfcast.storage import checkpoint, materialize, shared_folder


def test_product_json_array(spark, tmp_path):
    path = tmp_path / "products.json"
    path.write_text(json.dumps([
        {"salesUnitGtin": "1", "category": "c", "vendorName": "v", "units": [{"unit": "KPL", "gtin": "9"}]},
        {"salesUnitGtin": "2", "category": None, "extra": 1},
    ]))
    got = {r["salesUnitGtin"]: r for r in so.read_products(spark, str(path)).collect()}
    assert got["1"]["vendorName"] == "v" and got["2"]["category"] is None
    nested = so.read_products(spark, str(path), schemas.PRODUCTS_NESTED).where("salesUnitGtin = '1'").first()
    assert nested["units"][0]["gtin"] == "9"


def test_product_lines_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("1", "c", "v", "t", "KPL"), ("2", None, "v", "t", "LTK")], schemas.PRODUCTS)
    so.write_products(df, str(tmp_path / "p"))
    assert rows(so.read_product_lines(spark, str(tmp_path / "p"))) == rows(df)


def test_typed_sales_keep_a_line_with_a_bad_date(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "order_number,order_created_date,order_created_time,requested_delivery_date,picking_confirmed_date,"
        "customer_number,product_code,order_qty,delivered_qty,picking_picked_qty,plant,storage_location\n"
        "1,n/a,93000,2025-01-04,1970-01-01,10,00500,5.5,,,7,\n"
    )
    row = so.read_sales_typed(spark, str(tmp_path)).first()
    assert row["order_created_date"] is None and str(row["requested_delivery_date"]) == "2025-01-04"
    assert row["product_code"] == "00500" and row["order_qty"] == 5.5 and row["storage_location"] is None
    text = so.read_sales(spark, str(tmp_path)).first()
    assert text["order_created_date"] == "n/a" and text["product_code"] == 500


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_materialize_and_checkpoint_keep_rows(spark, rows):
    df = spark.range(10).selectExpr("id", "cast(null as string) s")
    assert rows(materialize(df)) == rows(df) == rows(checkpoint(df))
    assert materialize(df.limit(0)).count() == 0


def test_one_order_defaults_to_today(spark):
    import datetime as dt

    day = so.one_order(spark, 1, 2, 3, 4, 5).first()["order_created_date"]
    assert abs((day - dt.date.today()).days) <= 1


@pytest.mark.parametrize("bad", [[], None])
def test_empty_request_folder(spark, tmp_path, bad):
    (tmp_path / "r.txt").write_text("")
    assert so.read_requests(spark, str(tmp_path)).count() == 0
