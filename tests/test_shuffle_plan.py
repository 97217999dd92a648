"""Scans and shuffles start from partitions in proportion to the order lines."""

import pytest

from workload import tables

SETTINGS = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.minPartitionNum")


@pytest.fixture
def lines(spark, tmp_path):
    spark.range(1000).selectExpr("id as l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    before = [(s, spark.conf.get(s, None)) for s in SETTINGS]
    for s in SETTINGS:
        spark.conf.unset(s)
    yield str(tmp_path)
    for s, value in before:
        spark.conf.unset(s) if value is None else spark.conf.set(s, value)


def test_partitions_grow_with_the_lines(spark, lines, monkeypatch):
    monkeypatch.setattr(tables, "LINES_OF_A_TASK", 50)
    tables._plan_tasks(spark, lines)
    assert [spark.conf.get(s) for s in SETTINGS] == ["20", "20"]
    # a number that is high enough is kept
    monkeypatch.setattr(tables, "LINES_OF_A_TASK", 500)
    tables._plan_tasks(spark, lines)
    assert [spark.conf.get(s) for s in SETTINGS] == ["20", "20"]


def test_small_tables_leave_the_session_alone(spark, lines):
    tables._plan_tasks(spark, lines)
    assert [spark.conf.get(s, None) for s in SETTINGS] == [None, None]
