"""Every query with reference SQL gives the same rows."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from workload import ORACLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), ORACLES
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "part"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


#: Queries that train models: tests/test_models.py covers the parts, tools/check_queries.py the rows.
TRAINING = {
    "m3_logistic_regression", "m4_random_forest", "m5_boosted_trees", "m6_predict", "m7_feature_importance", "m7_boosted_importance", "f8_score", "f10_run_dispatch",
    "f11_product_status", "s10_save_load_model",
}


@pytest.mark.parametrize("name", sorted(SQL.keys() - TRAINING))
def test_query_matches_sql(spark, database, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = database.sql(SQL[name])
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    want = Counter(relation.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert TRAINING <= set(SQL)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
