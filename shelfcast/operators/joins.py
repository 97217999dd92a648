"""Lookup joins whose physical strategy is chosen from measured sizes.

``attach`` is the one way a lookup table is joined to a larger one:

* a lookup that is measured to have at most ``max_broadcast_rows`` rows and
  ``max_broadcast_bytes`` bytes is broadcast, and the large side is not shuffled at all;
* otherwise both sides are shuffled on the keys plus a salt. Only hot keys, those
  with more than ``slice_rows`` rows, get more than one salt, so a key's rows reach a
  task in slices of that size however large the data are. Every row keeps exactly one
  salt and the lookup side holds every salt of its key, so the result is that of the
  plain join. Rows with an empty key match nothing and are spread freely. Where no key is
  hot it is the plain join.

Hot keys come from exact row counts where a statistics table has them, else from a
summary of heavy hitters: a sketch of fixed size per task, merged by aggregation,
instead of a count of every key. Summaries of parts of the data can be stored and merged.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, MOST_HOT_KEYS, SLICE_ROWS, TRACKED_KEYS
from ..storage import materialize

ROWS = "n_rows"  # rows per key, carried by statistics tables as join weights
# Tasks over which rows with an empty key are spread.
_EMPTY_SPREAD = 4096


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 8 for a column of fixed width, its text's length for another."""
    fixed, varying = 0, []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            varying.append(F.octet_length(column))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            varying.append(F.octet_length(F.to_json(F.struct(column))))
        fixed += 8
    return reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), varying, F.lit(fixed)).cast("long")


def _measured(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("bytes"))


def fits_broadcast(
    lookup: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Whether ``lookup`` is measured to stay within both bounds.

    Tables of fixed-width columns are counted from file footers. A limit would not make
    it cheaper: every task would send its rows up to the limit to a single one.
    """
    return which_fit({"": lookup}, max_broadcast_rows, max_broadcast_bytes)[""]


def which_fit(
    lookups: dict[str, DataFrame], max_broadcast_rows: int = MAX_BROADCAST_ROWS, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> dict[str, bool]:
    """``fits_broadcast`` for several tables with one job."""
    sizes = [_measured(df).select(F.lit(name).alias("name"), "n", "bytes") for name, df in lookups.items()]
    return {
        r["name"]: r["n"] <= max_broadcast_rows and r["bytes"] <= max_broadcast_bytes
        for r in reduce(DataFrame.unionAll, sizes).collect()
    }


def _equi_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool
) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    pairs = [
        F.col(k).eqNullSafe(F.col(f"_right_{k}")) if null_safe else F.col(k) == F.col(f"_right_{k}")
        for k in keys
    ]
    joined = left.join(renamed, reduce(lambda a, b: a & b, pairs), how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def key_summary(rows: DataFrame, keys: Sequence[str], tracked: int = TRACKED_KEYS) -> DataFrame:
    """One row: a mergeable summary (``summary``) of how often keys occur, and the number of rows (``n_rows``)."""
    sketch = F.expr(f"approx_top_k_accumulate(_key, {tracked})")
    return rows.select(F.xxhash64(*keys).alias("_key")).agg(sketch.alias("summary"), F.count("*").alias(ROWS))


def merged_summary(summaries: DataFrame) -> DataFrame:
    """One summary of the rows that several summaries stand for."""
    return summaries.agg(F.expr("approx_top_k_combine(summary)").alias("summary"), F.sum(ROWS).alias(ROWS))


def heavy_keys(summary: DataFrame, most: int = MOST_HOT_KEYS) -> DataFrame:
    """``_key`` (hash of the keys) and ``n_rows`` of the most frequent keys of a summary; empty for no rows."""
    top = summary.where(F.col(ROWS) > 0).select(F.explode(F.expr(f"approx_top_k_estimate(summary, {most})")).alias("e"))
    return top.select(F.col("e.item").alias("_key"), F.col("e.count").alias(ROWS))


def hot_keys(
    weights: DataFrame, keys: Sequence[str], share: float | None = None, slice_rows: int = SLICE_ROWS, most: int = MOST_HOT_KEYS
) -> DataFrame:
    """Keys with more than ``slice_rows`` rows, or above ``share`` of all, with the number of salts each one needs.

    ``weights`` has one row per key and its row count. At most ``most`` rows come back:
    each stands for more than one part in ``most`` of the total.
    """
    total = weights.agg(F.sum(ROWS)).first()[0] or 0
    limit = max(slice_rows, total / most) if share is None else max(total * share, 1.0)
    return weights.where(F.col(ROWS) > limit).select(
        *keys, F.ceil(F.col(ROWS) / F.lit(limit)).cast("int").alias("_salts")
    )


def salted_join(
    fact: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weights: DataFrame | None = None,
    how: str = "left",
    null_safe: bool = False,
    share: float | None = None,
    slice_rows: int = SLICE_ROWS,
    spread_by: Sequence[str] | None = None,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Shuffled join with the rows of hot keys spread over salted partitions.

    Without ``weights`` hot keys come from a summary of ``fact``, or of ``count_from`` if that
    has the same keys. Rows of a hot key are told apart by ``spread_by``, by default all
    columns; naming a few lets the others be pruned.
    """
    if weights is not None:
        hot = hot_keys(weights, keys, share, slice_rows).select(F.xxhash64(*keys).alias("_key"), "_salts")
    else:
        summary = materialize(key_summary(count_from if count_from is not None else fact, keys), "summary")
        rows = summary.first()[ROWS]
        limit = max(slice_rows, rows / MOST_HOT_KEYS) if share is None else max(rows * share, 1.0)
        hot = heavy_keys(summary).where(F.col(ROWS) > limit).select("_key", F.ceil(F.col(ROWS) / F.lit(limit)).cast("int").alias("_salts"))
    # at most MOST_HOT_KEYS rows, and one per key's hash
    hot = hot.groupBy("_key").agg(F.max("_salts").alias("_salts"))
    if hot.isEmpty():
        # a plain join on the keys, for which a lookup bucketed by them is not shuffled
        return _equi_join(fact, lookup, keys, how, null_safe)
    hot = F.broadcast(hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    # A hash of the row, not a random number: a retried task repeats its choice.
    own = F.xxhash64(*(spread_by or fact.columns))
    salt = F.pmod(own, salts)
    if not null_safe:
        empty = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        salt = F.when(empty, F.pmod(own, F.lit(_EMPTY_SPREAD))).otherwise(salt)
    spread = fact.withColumn("_key", F.xxhash64(*keys)).join(hot, "_key", "left")
    spread = spread.withColumn("_salt", salt.cast("int")).drop("_salts", "_key")
    # the hash of a key depends on its type, so both sides take the fact's
    typed = [F.col(k).cast(fact.schema[k].dataType) for k in keys]
    copies = lookup.withColumn("_key", F.xxhash64(*typed)).join(hot, "_key", "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts", "_key")
    return _equi_join(spread, copies, [*keys, "_salt"], how, null_safe).drop("_salt")


def attach(
    fact: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    *,
    weights: DataFrame | None = None,
    count_from: DataFrame | None = None,
    how: str = "left",
    null_safe: bool = False,
    small: bool | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    share: float | None = None,
    slice_rows: int = SLICE_ROWS,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``lookup`` to ``fact`` on equally named ``keys``; see the module text.

    ``lookup`` is measured first, so pass a stored table when it is costly, or say
    in ``small`` whether a measurement of what it derives from proved it to fit.
    ``weights`` (keys, ``n_rows``) may give the rows per key of ``fact``; where they
    are needed and absent, heavy keys are looked for in ``count_from``, if that is a
    cheaper table with the same keys, or in ``fact``. A lookup column ``n_rows`` is not
    carried over.
    """
    lookup = lookup.drop(ROWS)
    if small is None:
        small = fits_broadcast(lookup, max_broadcast_rows, max_broadcast_bytes)
    if small:
        return _equi_join(fact, F.broadcast(lookup), keys, how, null_safe)
    return salted_join(fact, lookup, keys, weights, how, null_safe, share, slice_rows, spread_by, count_from)
