"""Training features are stored once, and no wider than what is read from them."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.config import FEATURES, KEYS, LABEL
from shelfcast.operators import features as fe
from shelfcast.plans import training
from workload import QUERIES, joins, shared


@pytest.fixture
def stored_names(monkeypatch):
    """Names and columns of the tables that ``module`` stores."""

    def watch(module):
        seen = []
        run = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name="table", *rest: seen.append((name, df.columns)) or run(df, name, *rest))
        return seen

    return watch


@pytest.fixture(scope="module")
def feature_rows(spark):
    columns = {c: (F.col("id") % (i + 3)).cast("double") for i, c in enumerate(FEATURES)}
    columns["order_qty"] = F.when(F.col("id") % 10 != 3, F.col("id").cast("double"))
    day = F.when(F.col("id") > 4, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 20).cast("int")))
    keys = {"order_created_date": day, "order_number": F.col("id"), "product_code": F.lit("p"), "customer_number": F.col("id") % 3}
    return spark.range(100).withColumns({**columns, LABEL: (F.col("id") % 2).cast("tinyint"), **keys, "plant": F.lit("x")}).drop("id")


@pytest.mark.parametrize("extra, kept", [((), []), (("plant",), ["plant"]), (None, ["plant"])])
def test_model_rows_are_read_from_the_stored_features(feature_rows, stored_names, extra, kept):
    seen = stored_names(training)
    data = training.prepare(feature_rows, extra=extra)
    (name, columns), = seen
    wanted = {*FEATURES, LABEL, *KEYS, *kept}
    assert name == "features" and set(columns) - {training._COMPLETE} == wanted == set(data.features.columns)
    assert data.features.count() == 100
    train, test = data.train.collect(), data.test.collect()
    assert data.train.columns == data.test.columns == [*FEATURES, LABEL, *KEYS]
    assert (len(train), len(test)) == (72, 18)
    assert sorted(r["order_number"] for r in train + test) == [i for i in range(100) if i % 10 != 3]
    assert max(r["order_created_date"] or date.min for r in train) <= min(r["order_created_date"] for r in test)
    assert {r["order_number"] for r in train if r["order_created_date"] is None} == {0, 1, 2, 4}


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    day = date(1995, 1, 1)
    orders = [(i, i % 4, day + timedelta(days=i % 9)) for i in range(1, 41)]
    lines = [(i, (i * n) % 7, i % 3, n, float(5 + n * i % 40), 0.1 if n == 2 else 0.0, 0.01, "R" if i % 2 else "N", "O" if i % 3 else "F") for i in range(1, 41) for n in (1, 2, 3)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate date"), "lineitem": (lines, names),
        "supplier": ([(i, i + 10) for i in range(3)], "s_suppkey long, s_nationkey int"),
        "part": ([(i, f"type {i % 2}", f"brand {i % 3}", i * 9) for i in range(6)], "p_partkey long, p_type string, p_brand string, p_size int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_single_key_statistics_store_no_pairs(spark, small_tables, stored_names, monkeypatch):
    seen, tables = stored_names(shared), []
    keep = joins.st.stored
    monkeypatch.setattr(joins.st, "stored", lambda given: tables.extend(given) or keep(given))
    got = QUERIES["j1_single_key_stats"](spark, small_tables)
    assert sorted(tables) == sorted(name for name, _ in joins._SINGLE)
    (_, columns), = seen
    assert not {"salesUnit", "picking_picked_qty", "picking_confirmed_date"} & set(columns)
    assert got.count() == shared.enriched(spark, small_tables).count() > 100
    rates = {r["product_code"]: r["product_shortage_rate"] for r in joins.st.product_stats(shared.dated(spark, small_tables)).collect()}
    assert all(r["product_shortage_rate"] == pytest.approx(rates[r["product_code"]], abs=1e-6) for r in got.collect())


def test_small_tables_are_joined_before_lines_are_shuffled(spark, small_tables, monkeypatch):
    order = []
    keep = fe.attach
    monkeypatch.setattr(fe, "attach", lambda fact, lookup, keys, **how: order.append((tuple(keys), how["small"])) or keep(fact, lookup, keys, **how))
    lines = shared.dated(spark, small_tables)
    stats = {**fe.training_stats(lines), "replacements": fe.replacement_counts(lines)}
    want = fe.attach_training_stats(lines, stats)
    order.clear()
    got = fe.attach_training_stats(lines, stats, max_broadcast_rows=6)
    pair = order.index((("customer_number", "product_code"), False))
    assert all(small == (at < pair) for at, (_, small) in enumerate(order) if at > 2) and pair > 4
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
