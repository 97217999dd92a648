"""Training features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FEATURES, KEYS, LABEL, MAX_BROADCAST_ROWS, SLICE_ROWS
from ..functions import dates as d
from ..storage import DENSE, materialize, materialize_all
from .cleaning import drop_null_rows, select_existing
from .joins import ROWS, attach, which_fit
from .stats import replacement_counts, training_stats


def date_features(lines: DataFrame, year: bool = False) -> DataFrame:
    created = F.col("order_created_date")
    columns = {
        "order_day_of_week": d.iso_weekday(created),
        "order_day_of_month": F.dayofmonth(created),
        "order_month": F.month(created),
        "order_quarter": F.quarter(created),
        "is_weekend": d.is_weekend(created),
        "lead_time_days": d.lead_time_days(F.col("requested_delivery_date"), created),
        "order_hour": d.order_hour(F.col("order_created_time")),
    }
    if year:
        columns["order_year"] = F.year(created)
    return lines.withColumns(columns)


def replacement_feature(
    lines: DataFrame, counts: DataFrame, small: bool | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Replacement frequency per line, 0 for products never replaced."""
    joined = attach(lines, counts, ["product_code"], small=small, slice_rows=slice_rows)
    return joined.withColumn(
        "replacement_frequency", F.coalesce("replacement_frequency", F.lit(0).cast("bigint"))
    )


def _pair_table(stats: dict[str, DataFrame], small: dict[str, bool], slice_rows: int) -> DataFrame:
    """Customer, product and replacement statistics at (customer, product) grain.

    There are far fewer such pairs than order lines. Joining the single-key tables
    here means that the order lines themselves are shuffled once, not once per
    key. A pair with an empty key has no pair statistics of its own.
    """
    pairs = stats["customer_product"].drop(ROWS)
    complete = F.col("customer_number").isNotNull() & F.col("product_code").isNotNull()
    names = ("customer_product_shortage_rate", "customer_product_order_count")
    pairs = pairs.withColumns({n: F.when(complete, F.col(n)) for n in names})
    keyed = stats["customer_product"]
    # both are by product, and there are far fewer products than pairs, which then are shuffled once for both
    products = attach(
        stats["product"].drop(ROWS), stats["replacements"], ["product_code"], small=small["replacements"], slice_rows=slice_rows
    )
    pairs = attach(
        pairs, products, ["product_code"], count_from=keyed, small=small["product"] and small["replacements"], slice_rows=slice_rows
    )
    pairs = attach(
        pairs, stats["customer"], ["customer_number"], count_from=keyed, small=small["customer"], slice_rows=slice_rows
    )
    return pairs.withColumn("replacement_frequency", F.coalesce("replacement_frequency", F.lit(0).cast("bigint")))


_PLACES = (
    ("category", "category"),
    ("temperature", "temperatureCondition"),
    ("vendor", "vendorName"),
    ("plant", "plant"),
    ("storage", "storage_location"),
)


def attach_training_stats(
    lines: DataFrame, stats: dict[str, DataFrame], max_broadcast_rows: int = MAX_BROADCAST_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    small = which_fit(stats, max_broadcast_rows)
    # an order's lines differ in these, so the other columns need not be hashed
    spread = ["order_number", "product_code"]
    pairs = _pair_table(stats, small, slice_rows)
    keyed = {name: key for name, key in _PLACES if name in stats}

    def with_place(df: DataFrame, name: str) -> DataFrame:
        key, table = keyed[name], stats[name]
        return attach(df, table, [key], weights=table.select(key, ROWS), small=small[name], slice_rows=slice_rows, spread_by=spread)

    # rates that are broadcast are joined before the lines are shuffled: they are shorter than the texts they are looked up by
    df = reduce(with_place, [name for name in keyed if small[name]], lines)
    df = attach(
        df,
        pairs,
        ["customer_number", "product_code"],
        weights=stats["customer_product"].select("customer_number", "product_code", ROWS),
        null_safe=True,
        small=small["customer_product"],
        slice_rows=slice_rows,
        spread_by=spread,
    )
    df = reduce(with_place, [name for name in keyed if not small[name]], df)
    places = [c for name, key in keyed.items() for c in stats[name].columns if c not in (key, ROWS)]
    return df.select(*lines.columns, *[c for c in pairs.columns if c not in lines.columns], *places)


def engineer_features(
    clean: DataFrame,
    replacements: DataFrame,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """All features of clean order lines.

    The lines are stored once, since eight aggregations and the final join read
    different columns of them. Statistics use every line, also later ones and the
    line's own label.
    """
    stored = materialize(clean, "clean", DENSE)
    lines = date_features(stored)
    tables = training_stats(lines)
    tables["replacements"] = replacement_counts(replacements)
    joined = attach_training_stats(stored, materialize_all(tables), max_broadcast_rows, slice_rows)
    # calendar columns follow from others, so they are added after the lines were shuffled
    return date_features(joined).select(*lines.columns, *[c for c in joined.columns if c not in lines.columns])


def model_rows(features: DataFrame, columns=FEATURES) -> DataFrame:
    """Feature, label and key columns of the rows without a missing feature."""
    used = [c for c in columns if c in features.columns]
    return drop_null_rows(select_existing(features, [*used, LABEL, *KEYS]), used)
