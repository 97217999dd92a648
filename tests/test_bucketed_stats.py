"""Statistics for serving: bucketed tables, one shuffle of the orders, and what cleaning counts on the way."""

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import stats as st
from shelfcast.operators.cleaning import CleaningReport, clean_orders_with_products
from shelfcast.operators.features import date_features
from shelfcast.operators.joins import attach
from shelfcast.operators.serving import serve_features
from shelfcast.storage import materialize
from workload.tables import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return materialize(date_features(clean_orders_with_products(view(spark, SF, "sales"), view(spark, SF, "products"))), "lines")


@pytest.fixture(scope="module")
def bundle(spark, lines, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bundle"))
    st.save_bucketed_stats(st.serving_stats(lines), path, "tested", buckets=4)
    return st.load_bucketed_stats(spark, "tested")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["product", "customer_product"])
def test_a_bucketed_table_is_not_shuffled(spark, lines, bundle, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plain = spark.read.schema(bundle[name].schema).parquet(bundle[name].inputFiles()[0].rsplit("/", 1)[0])
        keys = st.BUNDLE_KEYS[name]
        assert exchanges(attach(lines, bundle[name], keys, small=False)) == 1
        assert exchanges(attach(lines, plain, keys, small=False)) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orders_are_shuffled_once(spark, lines, bundle, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        orders = lines.select("order_number", "order_created_date", "customer_number", "product_code", "order_qty", "plant", "storage_location")
        tables = {**bundle, **{n: bundle[n].limit(0) for n in ("plant", "storage")}}
        served = serve_features(orders, tables, max_broadcast_rows=0)
        plan = served._jdf.queryExecution().executedPlan().toString()
        # the orders, and the stored pairs that they meet
        assert plan.count("Exchange hashpartitioning(customer_number") + plan.count("Exchange hashpartitioning(_right_customer_number") <= 2
        assert served.count() == orders.count()
        small = serve_features(orders, tables)
        columns = ["order_number", "product_code", "order_qty", "product_order_count", "customer_order_count", "customer_product_order_count"]
        assert rows(served, *columns) == rows(small, *columns)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cleaning_counts_rows_on_the_way(spark):
    sales, products = view(spark, SF, "sales"), view(spark, SF, "products")
    twice = products.unionByName(products.limit(1).withColumn("vendorName", F.lit("another")))
    report = CleaningReport()
    cleaned = materialize(clean_orders_with_products(sales, twice, report), "clean")
    n = {r["metric"]: r["value"] for r in report.table(spark).collect()}
    assert n["rows"] == sales.count() and n["joined_rows"] == cleaned.count()
    assert n["distinct_rows"] == sales.distinct().count() and n["duplicates"] == n["rows"] - n["distinct_rows"]
    assert n["added_by_master"] >= 0 and n["matched_rows"] <= n["joined_rows"]
    empty = CleaningReport()
    materialize(clean_orders_with_products(sales.limit(0), products, empty), "none")
    assert set(empty.counts().values()) == {0}
