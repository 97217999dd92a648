"""Evaluation of scores against labels, for any number of models at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LABEL
from .ordering import RUN, run_offsets, sorted_runs

PREDICTION = "predicted_shortage"
SCORE = "shortage_probability"


def _ratio(part: Column, whole: Column, empty: Column) -> Column:
    return F.when(whole == 0, empty).otherwise(part / whole)


def _cell(label: int, predicted: int) -> Column:
    hit = (F.col(LABEL) == label) & (F.col(PREDICTION) == predicted)
    return F.coalesce(F.sum(hit.cast("bigint")), F.lit(0).cast("bigint"))


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp in one aggregation."""
    return scored.groupBy(*by).agg(
        _cell(0, 0).alias("tn"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"), _cell(1, 1).alias("tp")
    )


def classification_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1; a ratio without a basis is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero = F.lit(0.0)
    return confusion(scored, by).select(
        *by,
        _ratio(tp + tn, tp + tn + fp + fn, F.lit(None).cast("double")).alias("accuracy"),
        _ratio(tp, tp + fp, zero).alias("precision"),
        _ratio(tp, tp + fn, zero).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn, zero).alias("f1"),
    )


def business_impact(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shortages that occurred, were predicted, caught and missed, and false alarms."""
    fp, fn, tp = (F.col(c) for c in ("fp", "fn", "tp"))
    none = F.lit(None).cast("double")
    return confusion(scored, by).select(
        *by,
        (tp + fn).alias("actual_shortages"),
        (tp + fp).alias("predicted_shortages"),
        tp.alias("caught"),
        _ratio(tp * 100.0, tp + fn, none).alias("caught_pct"),
        fn.alias("missed"),
        _ratio(fn * 100.0, tp + fn, none).alias("missed_pct"),
        fp.alias("false_alarms"),
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null with one class only.

    Rows are folded to one per (model, score). The negatives below a score need a
    running total over all distinct scores: these are sorted by ranges, summed
    inside each range and offset by the totals of the ranges before, so no task
    sees more than its range. The offsets have one row per partition and model.
    """
    score = F.col(SCORE)
    counts = (
        scored.where(F.col(LABEL).isNotNull() & score.isNotNull())
        .groupBy(*by, score.alias("_score"))
        .agg(
            F.sum((F.col(LABEL) == 1).cast("bigint")).alias("_pos"),
            F.sum((F.col(LABEL) == 0).cast("bigint")).alias("_neg"),
        )
    )
    runs = sorted_runs(counts, [*[F.col(c) for c in by], F.col("_score")])
    offsets = run_offsets(runs, {"_neg_before": F.sum("_neg")}, by)
    earlier = (
        Window.partitionBy(*by, RUN).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    below = F.coalesce(F.sum("_neg").over(earlier), F.lit(0))
    area = F.col("_pos").cast("double") * (F.col("_inside") + F.col("_neg") / 2)
    # One row per run: its area as if nothing came before, and its positives.
    per_run = (
        runs.withColumn("_inside", below)
        .groupBy(*by, RUN)
        .agg(F.sum(area).alias("_area"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    )
    placed = per_run.join(offsets, [*by, RUN])
    # counts are cast before they are multiplied: their products exceed 64 bits
    total = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    value = F.sum(F.col("_area") + F.col("_pos").cast("double") * F.col("_neg_before")) / total
    return placed.groupBy(*by).agg(F.when(total > 0, value).alias("roc_auc"))


def evaluate(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics, AUC, confusion matrix and impact side by side."""
    parts = [
        classification_metrics(scored, by), roc_auc(scored, by), confusion(scored, by),
        business_impact(scored, by),
    ]
    if not by:
        parts = [p.withColumn("_one", F.lit(1)) for p in parts]
    keys = list(by) or ["_one"]
    result = parts[0]
    for part in parts[1:]:
        result = result.join(part, keys, "left")
    return result.drop("_one")


def compare_models(scored: DataFrame) -> DataFrame:
    """One row per value of ``model``: accuracy, precision, recall, F1 and ROC AUC."""
    return classification_metrics(scored, ["model"]).join(roc_auc(scored, ["model"]), "model", "left")


def class_balance(rows: DataFrame) -> DataFrame:
    rate = F.avg(LABEL)
    return rows.agg(
        rate.alias("shortage_rate"),
        (1 - rate).alias("non_shortage_rate"),
        F.when(rate > 0, (1 - rate) / rate).alias("imbalance_ratio"),
    )


def shortage_totals(clean: DataFrame) -> DataFrame:
    """Shortages, lines and shortage percentage."""
    return clean.agg(
        F.sum(F.col(LABEL).cast("bigint")).alias("shortages"),
        F.count("*").alias("order_lines"),
        (F.sum(LABEL) * 100.0 / F.count("*")).alias("shortage_pct"),
    )


def class_weights(rows: DataFrame) -> DataFrame:
    """Balanced weight of each class: N / (2 · N_class). Two rows."""
    counts = rows.where(F.col(LABEL).isNotNull()).groupBy(LABEL).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(LABEL, "n", (total / (2.0 * F.col("n"))).alias("weight"))


def positive_weight(rows: DataFrame) -> DataFrame:
    """Negatives per positive."""
    pos = F.sum((F.col(LABEL) == 1).cast("bigint"))
    neg = F.sum((F.col(LABEL) == 0).cast("bigint"))
    return rows.agg(
        neg.alias("negatives"), pos.alias("positives"), F.when(pos > 0, neg / pos).alias("pos_weight")
    )
