import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfcast import config as c
from shelfcast.learners import training as t
from shelfcast.operators.cleaning import product_master
from shelfcast.operators.explain import explain
from shelfcast.operators.stats import serving_stats, stored
from shelfcast.operators.substitutes import substitutes
from shelfcast.plans import best_model, compare, prepare_from_sales, product_status, run_dispatch, sample_orders, train_models
from shelfcast.sources import one_order, product_stub
from workload.tables import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return prepare_from_sales(view(spark, SF, "sales"), view(spark, SF, "replacements"))


@pytest.fixture(scope="module")
def models(data):
    return train_models(data.train, trees=10, rounds=5, max_iter=50)


@pytest.fixture(scope="module")
def stats(data):
    return stored(serving_stats(data.features))


def test_split_is_by_date(data):
    last, first = (
        data.train.agg(F.max("order_created_date")).first()[0],
        data.test.agg(F.min("order_created_date")).first()[0],
    )
    assert last <= first
    n, m = data.train.count(), data.test.count()
    assert n == int((n + m) * 0.8)


def test_models_learn(models, data, spark):
    # observing any table before must not tie the models to the session
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    rows = {r["model"]: r for r in compare(models, data.test).collect()}
    assert set(rows) == {t.LOGISTIC, t.FOREST, t.BOOSTED}
    assert all(r["roc_auc"] > 0.9 for r in rows.values())
    assert best_model(models) is models[t.BOOSTED]


def test_importances_cover_the_features(models, spark):
    table = models[t.FOREST].importance_table(spark).collect()
    assert {r["feature"] for r in table} == set(c.FEATURES) and len(table) == 26
    values = [r["importance"] for r in table]
    assert values == sorted(values, reverse=True) and sum(values) == pytest.approx(1)


@pytest.mark.parametrize("name", [t.LOGISTIC, t.FOREST, t.BOOSTED])
def test_saved_model_scores_alike(models, data, spark, tmp_path, name):
    model = models[name]
    t.save_model(model, spark, str(tmp_path))
    loaded = t.load_model(spark, str(tmp_path))
    assert loaded.features == model.features and loaded.threshold == 0.5
    assert loaded.trained_at == model.trained_at
    keys = ["order_number", "product_code", "order_qty", "order_hour"]
    a = t.score(data.test, model).select(*keys, "shortage_probability").collect()
    b = t.score(data.test, loaded).select(*keys, "shortage_probability").collect()
    assert sorted(a) == sorted(b)


def test_missing_feature_is_still_scored(models, data):
    rows = data.test.limit(5).withColumn("lead_time_days", F.lit(None).cast("int"))
    got = t.score(rows, models[t.BOOSTED]).collect()
    assert len(got) == 5 and all(0 <= r["shortage_probability"] <= 1 for r in got)


def test_dispatch_of_new_orders(spark, data, models, stats, tmp_path):
    products, replacements = view(spark, SF, "products"), view(spark, SF, "replacements")
    orders = sample_orders(data.features, data.test, 500)
    subs = substitutes(product_master(products), replacements, 3)
    predictions, todo = run_dispatch(
        orders, stats, best_model(models), subs, str(tmp_path / "p"), str(tmp_path / "a")
    )
    assert predictions.count() == orders.count() == 500
    assert todo.count() == predictions.where("shortage_probability >= 0.5").count() > 0
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == todo.count()
    top = explain(predictions, best_model(models).importances)
    assert top.count() == 10 * predictions.count()


def test_single_order_and_unknown_keys(spark, models, stats):
    order = one_order(spark, -1, "no such", 3, "none", "none", as_of="2025-10-01")
    from shelfcast.plans import predict

    row = predict(order, stats, best_model(models)).first()
    assert row["product_shortage_rate"] == 0.04 and row["customer_order_count"] == 0
    assert row["product_avg_order_qty"] == 3.0 and row["order_hour"] == 14 and row["lead_time_days"] == 1
    assert row["product_order_qty_std"] == 0 and row["replacement_frequency"] == 0
    assert 0 <= row["shortage_probability"] <= 1


def test_product_status(spark, data, models, stats):
    products = view(spark, SF, "products")
    got = product_status(products, data.features, stats, best_model(models), as_of="2025-10-01")
    assert got.count() == products.select("salesUnitGtin").distinct().count()
    assert {r["verdict"] for r in got.select("verdict").distinct().collect()} <= {"high", "low"}


def test_stub_master_gives_no_substitutes(spark):
    stub = product_stub(spark)
    replacements = spark.createDataFrame([(5,), (6,)], "product_code INT")
    got = {r["product_code"]: r["substitutes"] for r in substitutes(stub, replacements).collect()}
    assert got == {"STUB": [], "5": [], "6": []}
