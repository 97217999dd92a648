"""Hard negatives against brute force over all rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from shelfcast.llm import hard_negatives, queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, least=80):
    """``rows`` of id, integer vector and label."""
    made = []
    for anchor, vector, label in rows:
        if not is_anchor(anchor):
            continue
        score = lambda other: sum(a * b for a, b in zip(vector, other))
        scored = sorted((-score(v), i, lab) for i, v, lab in rows if len(v) == len(vector))
        positives = [(-s, i) for s, i, lab in scored if lab == label and i != anchor][:5]
        for p, positive in positives:
            below = [(i, -s) for s, i, lab in scored if lab != label and least * p <= -100 * s <= 100 * p][:5]
            made += [(anchor, positive, rank, i, p, s) for rank, (i, s) in enumerate(below, 1)]
    return sorted(made)


def test_query_brute_force(spark):
    for sf in ("sf0.001", "sf0.1"):
        rows = queries.table(spark, f"/root/testdata/{sf}", "embeddings").collect()
        whole = [
            (r["vec_id"], [math.floor(256 * x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in rows if r["embedding"] is not None and r["label"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])
        ]
        found = queries.QUERIES["op11_hard_negatives"](spark, f"/root/testdata/{sf}")
        assert sorted(tuple(r) for r in found.select(COLUMNS).collect()) == brute(whole, lambda i: i % 100 == 0)


def test_ties_hot_vectors_and_clusters(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (9, 6))
    rows = [(i, (centres[i % 9] + rng.integers(-6, 7, 6)).tolist(), int(rng.integers(0, 3))) for i in range(1200)]
    rows += [(2000 + i, centres[0].tolist(), i % 2) for i in range(600)]  # one vector with a third of all rows
    rows += [(3000 + i, [0] * 6, i % 3) for i in range(8)] + [(4000, [1, 2, 3], 1), (4100, [3, 2, 1], 1), (4001, [1, 2, 3], 2)]
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "PART_ANCHORS", 10)
    monkeypatch.setattr(hard_negatives, "FIRST_CELLS", 2)
    frame = spark.createDataFrame([(i, [x / 256 for x in v], lab) for i, v, lab in rows], "vec_id long, embedding array<double>, label int")
    found = hard_negatives.hard_negatives(frame.repartition(5), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.select(COLUMNS).collect()) == brute(rows, lambda i: i % 50 == 0)


def test_searches_stop_early():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(2, 12, 4)) * 100
    index = hard_negatives.Index(8, list(centres), [np.full(12, 1.0)] * 2, set(range(0, 144, 2)), {})
    anchor = np.concatenate([centres[0, 3], centres[1, 6]])
    cells = list(index.cells(anchor))
    assert sorted(c for _, _, c in cells) == list(range(0, 144, 2))
    bounds = [b for b, _, _ in cells]
    assert bounds == sorted(bounds, reverse=True)
    (one, two), (low_one, low_two) = index.bounds(anchor)
    assert {(round(b, 6), round(low, 6), c) for b, low, c in cells} == {
        (round(one[i] + two[j], 6), round(low_one[i] + low_two[j], 6), i * 12 + j) for i in range(12) for j in range(12) if (i * 12 + j) % 2 == 0
    }


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (1, [1.0, 0.4], 1), (2, [0.9, 0.5], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 2),
        (6, [inf, 1.0], 2), (7, [1.0, 0.4], None), (None, [1.0, 0.4], 2), (8, [1.0], 1), (9, [], 1), (50, [], 1), (10, [], 2), (100, [1e200, 1e200], 3), (11, [1e200, 1e200], 3),
        (12, [-1e-20, 1.0], 2),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("h1", F.lit("x")).withColumn("cell", F.lit(1))
    found = [tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0).select(COLUMNS).collect()]
    p = 256 * 256 + 128 * 102
    assert sorted(found) == [(0, 1, 1, 2, p, 230 * 256 + 128 * 128), (50, 9, 1, 10, 0, 0)]
    assert hard_negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.products(np.array([[2.0**60, 1.0]]), np.array([[3.0, 1.0], [2.0**10, 0.0]])).tolist() == [[3 * 2**60 + 1, 2**63 - 1]]
