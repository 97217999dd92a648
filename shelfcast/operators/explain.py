"""Why an order was scored as it was."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FEATURES
from ..functions.labels import known
from .joins import attach

EXPLAINED = ("order_number", "product_code", "customer_number", "order_qty", "shortage_probability")


def feature_importance(importances: DataFrame, features: DataFrame) -> DataFrame:
    """Importance of each named feature, 0 where the model has none."""
    return attach(features, importances, ["feature"]).withColumn(
        "importance", F.coalesce("importance", F.lit(0.0))
    )


class _Factors:
    """The k strongest factors of each row, as ``top`` beside ``values``.

    The importances are a fixed short list, so they enter as literals. All the
    work stays inside the row: an array of 26 short entries is sorted and cut, nothing
    is shuffled. Entries hold only the sort key and the feature's place, from which the
    rest is looked up for the k that remain. Unknown contributions come last, ties
    follow the feature order.
    """

    def __init__(self, scored: DataFrame, importances: Mapping[str, float], k: int, features, keys):
        names = [f for f in features if f in scored.columns]
        self.names = F.array(*[F.lit(n) for n in names])
        self.weights = F.array(*[F.lit(float(importances.get(n, 0.0))) for n in names])
        present = [c for c in keys if c in scored.columns]
        values = scored.select(*present, F.array(*[known(F.col(n)) for n in names]).cast("array<double>").alias("_values"))
        entries = F.transform(
            "_values",
            lambda v, i: F.struct(F.coalesce(-F.abs(v * F.get(self.weights, i)), F.lit(1.0)).alias("order"), i.alias("i")),
        )
        self.rows = values.withColumn("_top", F.slice(F.sort_array(entries), 1, k))

    def feature(self, entry: Column) -> Column:
        return F.get(self.names, entry["i"])

    def value(self, entry: Column) -> Column:
        return F.get(F.col("_values"), entry["i"])

    def importance(self, entry: Column) -> Column:
        return F.get(self.weights, entry["i"])


def _four_decimals(value: Column) -> Column:
    """A double as ``%.4f`` prints it; a decimal does it several times faster for ordinary numbers."""
    size = F.abs(value)
    return (
        F.when(value.isNull(), F.lit("null"))
        .when(value.cast("string") == "0.0", F.lit("0.0000"))
        .when((size >= 0.0001) & (size < 1e14), value.cast("decimal(20,4)").cast("string"))
        .otherwise(F.format_string("%.4f", value))
    )


def explain(
    scored: DataFrame,
    importances: Mapping[str, float],
    k: int = 10,
    features=FEATURES,
    keys=EXPLAINED,
) -> DataFrame:
    """The k features of each row with the largest |value · importance|, one per row."""
    present = [c for c in keys if c in scored.columns]
    factors = _Factors(scored, importances, k, features, keys)
    # an outer one, since for a plain one Spark filters on the array's size, which sorts every row twice
    exploded = factors.rows.select(*present, "_values", F.posexplode_outer("_top").alias("_at", "_e"))
    entry = F.col("_e")
    value, importance = factors.value(entry), factors.importance(entry)
    return exploded.where(F.col("_at").isNotNull()).select(
        *present,
        (F.col("_at") + 1).alias("rank"),
        factors.feature(entry).alias("feature"), value.alias("value"), importance.alias("importance"),
        (value * importance).alias("contribution"),
    )


def explain_text(
    scored: DataFrame,
    importances: Mapping[str, float],
    k: int = 10,
    features=FEATURES,
    keys=EXPLAINED,
) -> DataFrame:
    """The same as one text per scored row: a heading and a numbered line per factor."""
    present = [c for c in keys if c in scored.columns]
    factors = _Factors(scored, importances, k, features, keys)
    lines = F.transform(
        "_top",
        lambda e, i: F.concat(
            F.lpad((i + 1).cast("string"), 4, " "), F.lit(". "), F.rpad(factors.feature(e), 40, "."), F.lit(" "),
            _four_decimals(factors.value(e)),
        ),
    )
    return factors.rows.select(
        *present, F.concat_ws("\n", F.lit("📊 Top Risk Factors:"), lines).alias("explanation")
    )
