"""Exact positions and running totals over a total order, without a global window.

A global window would pull all rows into one task. Here the rows are sorted by
range partitioning on the full order, stored by a reliable checkpoint, and then
numbered as (run, position): the run is the partition, runs follow each other in
order, and one small row per run carries what came before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpoint

RUN = "_run"
_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def sorted_runs(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` globally sorted, with run number ``_run`` and position ``_at`` in the run.

    The checkpoint fixes which row is in which partition: recomputing a lost one
    re-reads the stored partition instead of sorting again.
    """
    stored = checkpoint(df.orderBy(*order))
    return stored.select(
        "*",
        F.spark_partition_id().alias(RUN),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("_at"),
    )


def run_offsets(runs: DataFrame, totals: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Per run, the totals of all earlier runs. One row per partition (and ``by``)."""
    per_run = runs.groupBy(*by, RUN).agg(*[v.alias(k) for k, v in totals.items()])
    before = Window.partitionBy(*by).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    return per_run.select(
        *by, RUN, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in totals]
    )


def first_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """``df`` with a boolean ``_first``: whether the row is among the first n.

    The cut falls into one run; its number and the rows needed from it are two
    scalars, so no row is shuffled after the sort.
    """
    if n <= 0:
        return df.withColumn("_first", F.lit(False))
    runs = sorted_runs(df, order)
    offsets = run_offsets(runs, {"_before": F.count("*")})
    last = offsets.where(F.col("_before") < n).orderBy(F.desc(RUN)).first()
    if last is None:
        return df.withColumn("_first", F.lit(False))
    inside = (F.col(RUN) < last[RUN]) | (
        (F.col(RUN) == last[RUN]) & (F.col("_at") < n - last["_before"])
    )
    return runs.withColumn("_first", inside).drop(RUN, "_at")
