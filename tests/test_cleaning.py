import datetime as dt

from pyspark.sql import functions as F

from shelfcast import schemas
from shelfcast.operators import cleaning as cl
from shelfcast.operators.features import date_features, model_rows

LINE = (1, "2025-01-03", 93000, "2025-01-04", "1970-01-01", 10, 500, 5.0, None, None, None, 2001)


def sales(spark, *lines):
    return spark.createDataFrame(list(lines), schemas.SALES)


def test_clean_orders(spark):
    other = (2, "n/a", 93000, "2025-01-04", "2025-01-05", 10, 500, 5.0, 5.0, 5.0, 7, None)
    df = cl.clean_orders(sales(spark, LINE, LINE, other))
    got = {r["order_number"]: r.asDict() for r in df.collect()}
    assert df.count() == 2
    first, second = got[1], got[2]
    assert first["order_created_date"] == dt.date(2025, 1, 3)
    assert first["picking_confirmed_date"] is None
    assert (first["delivered_qty"], first["picking_picked_qty"], first["is_shortage"]) == (0.0, 0.0, 1)
    assert (first["plant"], first["storage_location"], first["product_code"]) == ("UNKNOWN", "2001", "500")
    assert {first[c] for c in cl.MASTER_COLUMNS} == {"UNKNOWN"}
    assert second["order_created_date"] is None and second["is_shortage"] == 0


def test_lines_that_become_equal_are_folded(spark):
    filled = LINE[:8] + (0.0, 0.0) + LINE[10:]
    assert cl.clean_orders(sales(spark, LINE, filled)).count() == 1


def test_enriched_equals_removing_duplicates_after_the_join(spark, rows):
    products = spark.createDataFrame(
        [("500", None, "v", "t", "KPL"), ("500", "UNKNOWN", "v", "t", "KPL"), ("500", "c", "v", "t", "KPL"),
         ("500", "c", "v", "t", "KPL"), ("9", "c", "v", "t", "KPL")],
        schemas.PRODUCTS,
    )
    second = (2, *LINE[1:6], 777, *LINE[7:])
    lines = sales(spark, LINE, LINE, second)
    plain = cl.clean_orders(lines).drop(*cl.MASTER_COLUMNS)
    joined = cl.fill_unknown(plain.join(cl.product_master(products), "product_code", "left"), cl.MASTER_COLUMNS)
    columns = ["order_number", "product_code", "category", "vendorName", "salesUnit", "is_shortage"]
    assert rows(cl.clean_orders_with_products(lines, products), *columns) == rows(joined.dropDuplicates(), *columns)


def test_null_rows_go_and_nan_stays(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x DOUBLE")
    assert cl.drop_null_rows(df, ["x"]).count() == 2


def test_select_existing_keeps_list_order(spark):
    df = spark.createDataFrame([(1, 2)], "b INT, a INT")
    assert cl.select_existing(df, ["a", "z", "b"]).columns == ["a", "b"]


def test_defaults_only_for_absent_columns(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 31),)], "order_created_date DATE")
    row = cl.with_order_defaults(df).first()
    assert row["order_created_time"] == 140000 and row["requested_delivery_date"] == dt.date(2025, 2, 1)
    given = df.withColumn("order_created_time", F.lit(5)).withColumn("requested_delivery_date", F.lit(None).cast("date"))
    row = cl.with_order_defaults(given).first()
    assert row["order_created_time"] == 5 and row["requested_delivery_date"] is None


def test_app_variant_keeps_duplicates_and_missing_picks(spark):
    typed = sales(spark, LINE, LINE).withColumns(
        {c: F.col(c).cast("date") for c in ("order_created_date", "requested_delivery_date", "picking_confirmed_date")}
    )
    got = cl.app_clean(typed)
    assert got.count() == 2
    row = got.first()
    assert row["picking_picked_qty"] is None and row["is_shortage"] == 1 and row["lead_time_days"] == 1
    assert row["picking_confirmed_date"] == dt.date(1970, 1, 1)


def test_date_features_may_be_negative_or_null(spark):
    late = LINE[:3] + ("2025-01-01",) + LINE[4:]
    row = date_features(cl.clean_orders(sales(spark, late)), year=True).first()
    assert (row["lead_time_days"], row["order_hour"], row["order_year"], row["is_weekend"]) == (-2, 9, 2025, 1)


def test_single_row_product_has_no_model_row(spark):
    from shelfcast.operators.features import engineer_features

    lines = sales(spark, LINE, (2, *LINE[1:]), (3, *LINE[1:6], 600, *LINE[7:]))
    features = engineer_features(cl.clean_orders(lines), lines.limit(0))
    assert features.count() == 3
    assert {r["product_code"] for r in model_rows(features).collect()} == {"500"}
