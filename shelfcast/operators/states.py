"""Statistics of order lines that can be continued.

A state holds, per part of the lines (a day, a month) and key, what later parts can be
merged with: row counts, counts and sums of the measures, their squared deviations from
the part's own mean, and the part's distinct orders, either as rows of one more table that
all statistics share or as a sketch. That table has a row for each order and combination of
keys, so (customer, product) pairs, of which there are nearly as many, have their sums there. New lines give a state of their own parts, and statistics are an aggregation
of states: history is not read again. A part that is stored again replaces what the part
held, so a repeated run changes nothing and late lines only cost their part.

Squared deviations are merged by the parts' distances from the common mean, not from sums
of squares, which would lose digits.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LABEL, SLICE_ROWS
from ..storage import materialize, materialize_all, side_by_side
from .joins import ROWS

PART = "part"
ORDER = "order_number"
#: Registers of an order sketch, as a power of two: 1.6 % standard error.
LOG_REGISTERS = 12


@dataclass(frozen=True)
class Statistic:
    """A table of statistics: its keys, and which columns come from which measure."""

    keys: tuple[str, ...]
    means: dict[str, str]
    sums: dict[str, str]
    deviations: dict[str, str]
    orders: str | None

    def measures(self) -> list[str]:
        return sorted({*self.means.values(), *self.sums.values(), *self.deviations.values()})


STATISTICS = {
    "product": Statistic(
        ("product_code",),
        {"product_shortage_rate": LABEL, "product_avg_order_qty": "order_qty", "product_avg_delivered_qty": "delivered_qty"},
        {}, {"product_order_qty_std": "order_qty"}, "product_order_count",
    ),
    "customer": Statistic(
        ("customer_number",), {"customer_shortage_rate": LABEL, "customer_avg_lead_time": "lead_time_days"},
        {"customer_total_order_qty": "order_qty"}, {}, "customer_order_count",
    ),
    "customer_product": Statistic(
        ("customer_number", "product_code"), {"customer_product_shortage_rate": LABEL}, {}, {}, "customer_product_order_count"
    ),
    "category": Statistic(("category",), {"category_shortage_rate": LABEL}, {}, {}, None),
    "temperature": Statistic(("temperatureCondition",), {"temp_condition_shortage_rate": LABEL}, {}, {}, None),
    "vendor": Statistic(("vendorName",), {"vendor_shortage_rate": LABEL}, {}, {}, "vendor_order_count"),
    "plant": Statistic(("plant",), {"plant_shortage_rate": LABEL}, {}, {}, "plant_order_count"),
    "storage": Statistic(("storage_location",), {"storage_shortage_rate": LABEL}, {}, {}, None),
}
_ORDERS_OF = "_orders"
#: The table of distinct orders, and the statistic that is kept in it.
ORDER_ROWS, _IN_ORDERS = "order_rows", "customer_product"
#: Rows of a stored file of order rows that a part of average size is planned for.
ROWS_OF_A_FILE = 500_000
#: With at most so many parts every task that aggregates states writes a file of each, and they are not shuffled once more.
FEW_PARTS = 32


def line_states(lines: DataFrame, part: Column, sketch: bool = False, names: Iterable[str] = tuple(STATISTICS)) -> dict[str, DataFrame]:
    """States of lines by part: a table per statistic, and one of the distinct orders of all unless these are sketched."""
    parted = lines.withColumn(PART, part.cast("string"))
    own = {name: STATISTICS[name] for name in names if set(STATISTICS[name].keys) <= set(lines.columns)}
    made = {}
    for name, s in own.items():
        if name == _IN_ORDERS and not sketch:
            continue
        columns = _sums(s)
        if s.orders and sketch:
            columns.append(F.hll_sketch_agg(ORDER, LOG_REGISTERS).alias(_ORDERS_OF))
        made[name] = parted.groupBy(PART, *s.keys).agg(*columns)
    counted = {name: s for name, s in own.items() if s.orders}
    if counted and not sketch:
        made[ORDER_ROWS] = _order_rows(parted, counted)
    return made


def _sums(s: Statistic) -> list[Column]:
    columns = [F.count("*").alias(ROWS)]
    for m in s.measures():
        columns += [F.count(m).alias(f"{m}_n"), F.sum(F.col(m).cast("double")).alias(f"{m}_sum")]
        if m in s.deviations.values():
            columns.append((F.var_pop(m) * F.count(m)).alias(f"{m}_dev"))
    return columns


def _order_rows(parted: DataFrame, counted: dict[str, Statistic]) -> DataFrame:
    """A row for each part, order and combination of the statistics' keys.

    Few lines share one, so nothing is folded before the shuffle. It brings the rows of a part to as
    many tasks as it gets files, and they are stored from there without another one.
    """
    keys = sorted({k for s in counted.values() for k in s.keys})
    sums = _sums(counted[_IN_ORDERS]) if _IN_ORDERS in counted else []
    used = counted[_IN_ORDERS].measures() if sums else []
    size = parted.groupBy(PART).agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0] or 0
    # a line without an order is spread by its keys
    own = F.when(F.col(ORDER).isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(ORDER))
    spread = F.pmod(own, F.lit(max(1, -(-int(size) // ROWS_OF_A_FILE)))).alias("_spread")
    rows = parted.select(PART, ORDER, *keys, *used, spread)
    return rows.repartition(PART, "_spread").groupBy(PART, "_spread", ORDER, *keys).agg(*(sums or [F.count("*").alias(ROWS)])).drop("_spread")


def _few_parts(states: dict[str, DataFrame]) -> bool:
    """Whether the states have at most ``FEW_PARTS`` parts; all tables have the same ones, give or take lines without an order."""
    if not states:
        return True
    return next(iter(states.values())).select(PART).distinct().limit(FEW_PARTS + 1).count() <= FEW_PARTS


def store_states(states: dict[str, DataFrame], path: str) -> None:
    """Write states; a part that is there already is replaced, other parts stay as they are."""

    few = _few_parts(states)

    def store(name: str, df: DataFrame) -> None:
        # order rows come in as many tasks as a part gets files; of many parts, states get one file each
        rows = df if few or name == ORDER_ROWS else df.repartition(PART)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{path}/{name}")

    side_by_side(store, states)


def load_states(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """What ``store_states`` has written, by default for every statistic with exact distinct orders."""
    if names is None:
        names = [*[name for name in STATISTICS if name != _IN_ORDERS], ORDER_ROWS]
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def merge_states(*states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """States of several sets of lines side by side, as one; parts should not overlap."""
    names = sorted({name for s in states for name in s})
    return {name: reduce(DataFrame.unionByName, [s[name] for s in states if name in s]) for name in names}


def _same(keys) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


def finished(states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Statistics of all lines that the states stand for, with row counts as join weights."""
    made = {}
    order_rows = states.get(ORDER_ROWS)
    # an order's lines differ in their products, so its rows are not folded before a shuffle: with
    # products that are known not to be hot one shuffle, by key, does for distinct orders and their count
    by_product = False
    for name, s in STATISTICS.items():
        # order rows hold no sums of pairs unless these were asked for
        inside = name == _IN_ORDERS and name not in states and order_rows is not None and f"{s.measures()[0]}_n" in order_rows.columns
        if name not in states and not inside:
            continue
        rows, all_parts = order_rows if inside else states[name], Window.partitionBy(*s.keys)
        if inside and by_product:
            rows = rows.repartition(*s.keys)
        merged = [F.sum(ROWS).alias(ROWS)]
        for m in s.measures():
            merged += [F.sum(f"{m}_n").alias(f"{m}_n"), F.sum(f"{m}_sum").alias(f"{m}_sum")]
            if m in s.deviations.values():
                mean = F.sum(f"{m}_sum").over(all_parts) / F.nullif(F.sum(f"{m}_n").over(all_parts), F.lit(0))
                rows = rows.withColumn(f"{m}_mean", mean)
                apart = F.col(f"{m}_sum") / F.nullif(F.col(f"{m}_n"), F.lit(0)) - F.col(f"{m}_mean")
                merged.append(F.sum(F.col(f"{m}_dev") + F.col(f"{m}_n") * apart * apart).alias(f"{m}_dev"))
        if _ORDERS_OF in rows.columns:
            merged.append(F.hll_sketch_estimate(F.hll_union_agg(_ORDERS_OF)).alias(s.orders))
        elif inside:
            # an order may have lines in several parts; it counts once
            merged.append(F.count_distinct(ORDER).alias(s.orders))
        whole = rows.groupBy(*s.keys).agg(*merged)
        columns = {c: F.col(f"{m}_sum") / F.nullif(F.col(f"{m}_n"), F.lit(0)) for c, m in s.means.items()}
        columns |= {c: F.col(f"{m}_sum") for c, m in s.sums.items()}
        for c, m in s.deviations.items():
            columns[c] = F.when(F.col(f"{m}_n") > 1, F.sqrt(F.greatest(F.col(f"{m}_dev"), F.lit(0.0)) / (F.col(f"{m}_n") - 1)))
        if s.orders and s.orders in whole.columns:
            columns[s.orders] = F.col(s.orders)
        table = whole.select(*s.keys, *[v.alias(c) for c, v in columns.items()], ROWS)
        if s.orders and s.orders not in whole.columns and order_rows is not None:
            orders = order_rows.where(F.col(ORDER).isNotNull()).select(*s.keys, ORDER)
            if name == "product":
                table = materialize(table, name)
                by_product = (table.agg(F.max(ROWS)).first()[0] or 0) <= SLICE_ROWS
                if by_product:
                    orders = orders.repartition(*s.keys)
            orders = orders.distinct().groupBy(*s.keys).agg(F.count("*").alias(s.orders))
            joined = table.alias("a").join(orders.alias("b"), _same(s.keys), "left")
            count = F.coalesce(F.col(f"b.{s.orders}"), F.lit(0).cast("long")).alias(s.orders)
            table = joined.select(*[F.col(f"a.{c}") for c in table.columns if c != ROWS], count, F.col(f"a.{ROWS}"))
        made[name] = table
    return made


def continued_stats(
    path: str, lines: DataFrame, part: Column, sketch: bool = False, names: Iterable[str] = tuple(STATISTICS)
) -> dict[str, DataFrame]:
    """Stored statistics of all lines seen so far, after the parts of ``lines`` were added or replaced under ``path``."""
    states = line_states(lines, part, sketch, names)
    store_states(states, path)
    return materialize_all(finished(load_states(lines.sparkSession, path, states)))
