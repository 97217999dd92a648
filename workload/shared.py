"""Derived tables that several queries start from."""

from pyspark.sql import functions as F

from shelfcast.operators import dispatch
from shelfcast.operators.cleaning import (
    clean_orders,
    clean_orders_with_products,
    product_master,
)
from shelfcast.operators.features import date_features, engineer_features
from shelfcast.operators.substitutes import substitutes
from shelfcast.storage import DENSE, materialize

from .tables import view


def clean(spark, d):
    return clean_orders(view(spark, d, "sales"))


def enriched(spark, d):
    return clean_orders_with_products(view(spark, d, "sales"), view(spark, d, "products"), codes=view(spark, d, "sold_codes"))


def dated(spark, d):
    return date_features(enriched(spark, d))


def stored_lines(spark, d, without=()):
    """Enriched lines with dates, stored once for queries that read them repeatedly; columns in ``without`` are left out."""
    return date_features(materialize(enriched(spark, d).drop(*without), "lines", DENSE))


def features(spark, d):
    return engineer_features(enriched(spark, d), view(spark, d, "replacements"))


def scored(spark, d):
    rows = view(spark, d, "scored")
    return rows.withColumn("product_code", F.col("product_code").cast("string"))


def judged(spark, d):
    """Scored lines with their label and the prediction at 0.5."""
    short = F.col("order_qty") > F.coalesce("delivered_qty", F.lit(0.0))
    return view(spark, d, "scored").select(
        "order_number", "product_code", "order_qty",
        short.cast("int").alias("is_shortage"),
        "shortage_probability",
        (F.col("shortage_probability") >= 0.5).cast("int").alias("predicted_shortage"),
    )


def judged_models(spark, d):
    """The same labels under three models' scores, in one pass."""
    p = F.col("shortage_probability")
    scores = {"Logistic Regression": p, "Random Forest": 1 - p, "Gradient Boosting": p * p}
    entries = F.array(*[F.struct(F.lit(n).alias("model"), s.alias("score")) for n, s in scores.items()])
    return judged(spark, d).select("is_shortage", F.inline(entries)).select(
        "model", "is_shortage",
        F.col("score").alias("shortage_probability"),
        (F.col("score") >= 0.5).cast("int").alias("predicted_shortage"),
    )


def substitute_lists(spark, d, n=5):
    return substitutes(
        product_master(view(spark, d, "products")), view(spark, d, "replacements"), n
    )


def top3(spark, d):
    return materialize(substitute_lists(spark, d, 3), "substitutes")


def predictions(spark, d):
    return dispatch.with_risk_level(scored(spark, d))


def actions(spark, d):
    return dispatch.actions(predictions(spark, d), top3(spark, d))
