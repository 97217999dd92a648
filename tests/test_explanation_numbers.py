"""Numbers of explanations are printed as ``%.4f`` prints them."""

import random

from pyspark.sql import functions as F

from shelfcast.operators.explain import _four_decimals


def test_numbers_print_as_before(spark):
    odd = [0.0, -0.0, None, float("nan"), float("inf"), float("-inf"), 1e14, 1e14 - 0.5, 1e300, -1e15, 5e-5, -4e-5, 1e-4, 0.00015, 0.00025]
    odd += [2.00005, 1.00015, -1.00025, 123456789.00005, 0.1 + 0.2, 99999.99995, 99999999999999.9]
    random.seed(3)
    odd += [random.uniform(-1, 1) * 10 ** random.randint(-6, 13) for _ in range(3000)] + [i / 20000 for i in range(-2000, 2000)]
    values = spark.createDataFrame([(x,) for x in odd], "value double")
    both = values.select("value", _four_decimals(F.col("value")).alias("text"), F.format_string("%.4f", "value").alias("printed"))
    assert [tuple(r) for r in both.where(~F.col("text").eqNullSafe(F.col("printed"))).collect()] == []
