import math

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import metrics as m
from shelfcast.operators.ordering import first_rows, run_offsets, sorted_runs
from shelfcast.operators.split import time_split


def dated(spark, days):
    rows = [(i, f"2025-01-{d:02}" if d else None) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "order_number BIGINT, day STRING").select(
        "order_number", F.col("day").cast("date").alias("order_created_date"), F.lit(0).alias("is_shortage")
    )


def expected_train(days, share=0.8):
    order = sorted(range(len(days)), key=lambda i: (days[i] or 0, i))
    return set(order[: int(len(days) * share)])


@pytest.mark.parametrize(
    "days",
    [
        [1], [1] * 9, [1] * 10, [3, 2, 1, 4, 5, 6, 7, 8, 9, 10], [5] * 40 + [6] * 7, [1] * 2 + [9] * 58,
        [None] * 9 + [4], [None] * 3 + [1, 2, 3, 4, 5, 6, 7], list(range(1, 29)) * 5,
    ],
)
def test_split_takes_the_first_rows_by_date(spark, days):
    got = time_split(dated(spark, days)).collect()
    assert len(got) == len(days)
    train = {r["order_number"] for r in got if r["split"] == "train"}
    assert len(train) == math.floor(len(days) * 0.8)
    assert train == expected_train(days)


def test_split_of_nothing(spark):
    assert time_split(dated(spark, [1]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 2000])
def test_first_rows_over_many_partitions(spark, n):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(6)
    first = first_rows(df, n, [F.col("x")]).where("_first")
    assert sorted(r["x"] for r in first.collect()) == list(range(min(n, 1000)))


def test_runs_follow_each_other(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = sorted_runs(spark.range(500).select((499 - F.col("id")).alias("x")), [F.col("x")])
        offsets = run_offsets(runs, {"before": F.count("*")})
        placed = runs.join(offsets, "_run").select("x", (F.col("before") + F.col("_at")).alias("at"))
        assert runs.select("_run").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["x"] == r["at"] for r in placed.collect())


def scores(spark, pairs, threshold=0.5):
    rows = [(y, p, int(p >= threshold)) for y, p in pairs]
    return spark.createDataFrame(rows, "is_shortage INT, shortage_probability DOUBLE, predicted_shortage INT")


def pair_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize(
    "pairs",
    [
        [(0, 0.1), (1, 0.9)], [(1, 0.1), (0, 0.9)], [(0, 0.5), (1, 0.5), (1, 0.5)],
        [(i % 3 == 0, (i * 37 % 11) / 11) for i in range(60)],
    ],
)
def test_auc_equals_counting_pairs(spark, pairs):
    pairs = [(int(y), p) for y, p in pairs]
    assert m.roc_auc(scores(spark, pairs)).first()[0] == pytest.approx(pair_auc(pairs), abs=1e-12)


def test_auc_over_many_runs(spark):
    df = spark.range(4000).select(
        (F.col("id") * 31 % 7 < 2).cast("int").alias("is_shortage"),
        ((F.col("id") * 7919) % 997 / 997).alias("shortage_probability"),
    )
    pairs = [(r[0], r[1]) for r in df.collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = m.roc_auc(df).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == pytest.approx(pair_auc(pairs), abs=1e-12)


def test_auc_needs_both_classes(spark):
    assert m.roc_auc(scores(spark, [(1, 0.2), (1, 0.3)])).first()[0] is None
    assert m.roc_auc(scores(spark, [(0, 0.2)])).first()[0] is None


def test_ratios_without_a_basis_are_zero(spark):
    none = m.classification_metrics(scores(spark, [(0, 0.1), (0, 0.2)])).first()
    assert (none["accuracy"], none["precision"], none["recall"], none["f1"]) == (1.0, 0.0, 0.0, 0.0)
    missed = m.classification_metrics(scores(spark, [(1, 0.1), (0, 0.2)])).first()
    assert (missed["precision"], missed["recall"], missed["f1"]) == (0.0, 0.0, 0.0)


def test_metrics_by_hand(spark):
    rows = scores(spark, [(1, 0.9), (1, 0.8), (1, 0.1), (0, 0.7), (0, 0.2), (0, 0.3)])
    got = m.evaluate(rows).first()
    assert (got["tn"], got["fp"], got["fn"], got["tp"]) == (2, 1, 1, 2)
    assert got["accuracy"] == pytest.approx(4 / 6)
    assert got["precision"] == pytest.approx(2 / 3) and got["recall"] == pytest.approx(2 / 3)
    assert got["caught_pct"] == pytest.approx(200 / 3) and got["false_alarms"] == 1


def test_class_weights_and_positive_weight(spark):
    rows = scores(spark, [(1, 0.9), (0, 0.1), (0, 0.1), (0, 0.1)])
    weights = {r["is_shortage"]: r["weight"] for r in m.class_weights(rows).collect()}
    assert weights == {1: 2.0, 0: pytest.approx(4 / 6)}
    assert m.positive_weight(rows).first()["pos_weight"] == 3.0
    assert m.positive_weight(scores(spark, [(0, 0.1)])).first()["pos_weight"] is None
