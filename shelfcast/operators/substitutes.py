"""Substitute products: other products of the same category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_BROADCAST_ROWS
from .joins import attach


def _category_heads(members: DataFrame, n: int) -> DataFrame:
    """The first ``n + 1`` products of every category, as one short list each.

    One more than asked for is enough, since at most one of them is the product
    itself. The row-number filter is a top-n per group, which Spark also applies
    before the shuffle: a category with a third of all products sends at most
    ``n + 1`` rows per map task.
    """
    order = Window.partitionBy("category").orderBy("_position", "product_code")
    heads = members.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n + 1)
    entry = F.struct("_rank", "product_code", "_copies")
    return heads.groupBy("category").agg(F.array_sort(F.collect_list(entry)).alias("_heads"))


def substitute_rows(
    products: DataFrame,
    n: int = 5,
    distinct: bool = True,
    position: str | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """(product_code, rank, substitute) with ranks 1 … n.

    ``products`` holds ``product_code`` and ``category``. Products of a category
    are taken in the order of the ``position`` column, by default by code; a
    product listed under several categories goes through them in order, the empty
    category first. With ``distinct=False`` repeated master rows repeat a substitute.
    """
    if position is None:
        place = F.lit(0)
    else:
        place = F.col(position)
    base = products.select(
        "category", F.col("product_code").cast("string").alias("product_code"),
        place.alias("_position"),
    )
    members = base.groupBy("category", "product_code").agg(
        F.count("*").alias("_copies"), F.min("_position").alias("_position")
    )
    listed = attach(
        members,
        _category_heads(members, n),
        ["category"],
        null_safe=True,
        max_broadcast_rows=max_broadcast_rows,
    )
    others = F.filter("_heads", lambda e: ~e.product_code.eqNullSafe(F.col("product_code")))
    if distinct:
        picks = F.transform(others, lambda e: e.product_code)
    else:
        times = F.least(F.col("_copies"), F.lit(n)).cast("int")
        once = F.flatten(
            F.transform(
                others,
                lambda e: F.array_repeat(e.product_code, F.least(e["_copies"], F.lit(n)).cast("int")),
            )
        )
        # only the first n of a round can be picked, and no more than n rounds are needed
        picks = F.flatten(F.array_repeat(F.slice(once, 1, n), times))
    candidates = listed.select(
        "product_code", "category", F.posexplode(F.slice(picks, 1, n)).alias("_at", "substitute")
    )
    first = F.struct(F.coalesce(F.col("category"), F.lit("")).alias("c"), F.col("_at").alias("i"))
    if distinct:
        candidates = candidates.groupBy("product_code", "substitute").agg(F.min(first).alias("_first"))
    else:
        candidates = candidates.withColumn("_first", first)
    order = Window.partitionBy("product_code").orderBy("_first", "substitute")
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("product_code", "rank", "substitute")
    )


def substitutes(
    products: DataFrame,
    replacements: DataFrame | None = None,
    n: int = 5,
    distinct: bool = True,
    position: str | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """(product_code, substitutes) for every known product.

    Products alone in their category, and products known from replacement orders
    only, have an empty list.
    """
    code = F.col("product_code").cast("string").alias("product_code")
    known = products.select(code)
    if replacements is not None:
        known = known.union(replacements.select(code))
    known = known.dropDuplicates()
    empty = F.array().cast("array<string>")
    if n <= 0:
        return known.withColumn("substitutes", empty)
    rows = substitute_rows(products, n, distinct, position, max_broadcast_rows)
    lists = rows.groupBy("product_code").agg(
        F.array_sort(F.collect_list(F.struct("rank", "substitute"))).alias("_picks")
    )
    # Both sides are already partitioned by product and unique in it.
    return known.join(lists, "product_code", "left").select(
        "product_code",
        F.coalesce(F.transform("_picks", lambda e: e.substitute), empty).alias("substitutes"),
    )


def substitute_details(
    rows: DataFrame, products: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Master rows of the substitutes of each target product.

    The first products of a category are substitutes of all the others, so the
    substitute side is heavily repeated; ``attach`` broadcasts the master when its
    count allows and otherwise salts those keys.
    """
    wanted = rows.select(
        F.col("product_code").alias("target_product"), F.col("substitute").alias("product_code")
    ).dropDuplicates()
    master = products.select(
        F.col("product_code").cast("string").alias("product_code"),
        "category", "vendorName", "salesUnit",
    )
    return attach(
        wanted, master, ["product_code"], how="inner", max_broadcast_rows=max_broadcast_rows
    )
