"""The measured join equals the plain one, whatever strategy it takes."""

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import joins as j
from shelfcast.operators import stats as st
from shelfcast.operators.cleaning import clean_orders
from shelfcast.operators.features import date_features, engineer_features
from workload.tables import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fact(spark):
    """A third of all rows share one key, another part has no key."""
    key = (
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 10 == 1, None)
        .otherwise(F.col("id") % 40)
    )
    return spark.range(6000).select("id", key.cast("bigint").alias("k"), (F.col("id") % 5).alias("v"))


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [(k, f"name{k}") for k in range(35)] + [(7, "again"), (None, "nothing")]
    return spark.createDataFrame(rows, "k BIGINT, name STRING")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_plain_join(spark, fact, lookup, rows, how, null_safe):
    broadcast = j.attach(fact, lookup, ["k"], how=how, null_safe=null_safe)
    salted = j.attach(fact, lookup, ["k"], how=how, null_safe=null_safe, max_broadcast_rows=0, share=0.01)
    assert salted.columns == broadcast.columns
    assert rows(salted) == rows(broadcast)


def test_hot_keys_are_bounded_and_get_enough_salts(fact):
    weights = fact.groupBy("k").agg(F.count("*").alias(j.ROWS))
    hot = {r["k"]: r["_salts"] for r in j.hot_keys(weights, ["k"], 0.05).collect()}
    assert set(hot) == {7, None} and len(hot) < 1 / 0.05
    assert hot[7] >= 7


def test_rows_of_a_hot_key_are_spread(spark, fact, lookup):
    weights = fact.groupBy("k").agg(F.count("*").alias(j.ROWS))
    joined = j.salted_join(fact, lookup, ["k"], weights, share=0.01)
    text = joined._jdf.queryExecution().toString()
    assert "_salt" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_summaries_of_parts_merge_to_that_of_all(spark, fact):
    parts = [fact.where(F.col("id") % 3 == i).transform(j.key_summary, ["k"]) for i in range(3)] + [j.key_summary(fact.limit(0), ["k"])]
    merged = j.merged_summary(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]))
    counted = {r["_key"]: r[j.ROWS] for r in fact.groupBy(F.xxhash64("k").alias("_key")).agg(F.count("*").alias(j.ROWS)).collect()}
    assert {r["_key"]: r[j.ROWS] for r in j.heavy_keys(merged).collect()} == counted
    assert merged.first()[j.ROWS] == fact.count()
    assert j.heavy_keys(j.key_summary(fact.limit(0), ["k"])).count() == 0


def test_a_summary_of_few_keys_finds_the_hot_ones(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 1, 9).otherwise(F.col("id") + 100).alias("k"))
    hot = j.heavy_keys(j.key_summary(rows, ["k"], tracked=256), most=2).collect()
    wanted = {r["h"] for r in spark.sql("SELECT xxhash64(k) AS h FROM VALUES (7L), (9L) AS t(k)").collect()}
    assert {r["_key"] for r in hot} == wanted


@pytest.mark.parametrize("copies", [1, 8])
def test_slices_do_not_grow_with_the_rows(spark, fact, lookup, copies):
    rows = fact.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    weights = rows.groupBy("k").agg(F.count("*").alias(j.ROWS))
    for known in (weights, None):
        joined = j.salted_join(rows, lookup.dropDuplicates(["k"]), ["k"], known, slice_rows=100)
        assert joined.count() == rows.count()
    salts = {r["k"]: r["_salts"] for r in j.hot_keys(weights, ["k"], slice_rows=100).collect()}
    spread = rows.withColumn("s", F.pmod(F.xxhash64(*rows.columns), F.lit(salts[7])))
    largest = spread.where("k = 7").groupBy("s").count().agg(F.max("count")).first()[0]
    assert largest < 2 * 100


def test_broadcasts_are_bounded_by_bytes(spark):
    table = spark.createDataFrame([(1, "x" * 1000), (2, None)], "k INT, name STRING")
    assert j.fits_broadcast(table, max_broadcast_bytes=1100)
    assert not j.fits_broadcast(table, max_broadcast_bytes=1000)
    assert not j.fits_broadcast(table, max_broadcast_rows=1)
    nested = spark.createDataFrame([(1, ["y" * 50] * 10)], "k INT, names ARRAY<STRING>")
    assert j.which_fit({"a": nested, "b": table}, 10, 510) == {"a": False, "b": False}
    assert j.which_fit({"a": nested.limit(0)}, 0, 0) == {"a": True}


def test_keys_of_other_types_meet(spark, fact, rows):
    lookup = spark.createDataFrame([(k, f"name{k}") for k in range(35)], "k INT, name STRING")
    salted = j.attach(fact, lookup, ["k"], max_broadcast_rows=0, slice_rows=10, spread_by=["id"])
    assert rows(salted) == rows(j.attach(fact, lookup, ["k"]))


def test_small_lookup_leaves_the_fact_unshuffled(fact, lookup):
    joined = j.attach(fact.select("id", "k"), lookup, ["k"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_features_do_not_depend_on_the_strategy(spark, rows):
    clean = clean_orders(view(spark, SF, "sales"))
    replacements = view(spark, SF, "replacements")
    small = engineer_features(clean, replacements)
    large = engineer_features(clean, replacements, max_broadcast_rows=5)
    columns = [
        "order_number", "product_code", "order_qty", "storage_location", "product_order_count",
        "customer_order_count", "customer_product_order_count", "plant_order_count", "replacement_frequency",
        F.round("product_shortage_rate", 9), F.round("customer_shortage_rate", 9),
        F.round("vendor_shortage_rate", 9), F.round("storage_shortage_rate", 9),
    ]
    assert small.count() == clean.count()
    assert rows(small, *columns) == rows(large, *columns)


def test_rates_are_shares(spark):
    lines = date_features(clean_orders(view(spark, SF, "sales")))
    for name, table in st.serving_stats(lines).items():
        rate = next(c for c in table.columns if c.endswith("_rate"))
        low, high = table.agg(F.min(rate), F.max(rate)).first()
        assert 0 <= low <= high <= 1, name


def test_distinct_counts_spread_before_they_meet(spark):
    lines = clean_orders(view(spark, SF, "sales"))
    plan = st.vendor_stats(lines)._jdf.queryExecution().executedPlan().toString()
    # The first exchange is on (key, order); one value of the key is no bottleneck.
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("order_number" in line for line in exchanges)


def test_stats_survive_storing(spark, rows, tmp_path):
    lines = date_features(clean_orders(view(spark, SF, "sales")))
    tables = st.serving_stats(lines)
    st.save_stats(tables, str(tmp_path))
    loaded = st.load_stats(spark, str(tmp_path))
    assert set(loaded) == set(tables)
    assert rows(loaded["plant"]) == rows(tables["plant"])
