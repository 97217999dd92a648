"""Mixing sources to target weights by hash-threshold histograms; no rows are sorted.

Every document has a fixed 60-bit hash. A source that must give ``r`` times its size
takes all its documents ``floor(r)`` times, and once more those whose hash lies below a
threshold. The threshold comes from histograms: words per source and bucket of hashes,
the bucket in which the budget ends, then a histogram of that bucket alone, and so on
until it holds one hash. Each round reads a thousandth of the last one's rows, and
thresholds are nested: a larger budget takes a superset.

Cases: a null text has size 0; a null source is a source of its own, the last; a null
id hashes as an empty string; repeated rows share a hash and are taken together; an
empty table gives no rows; sources without words take none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import WORD

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Bits of the hash that each histogram resolves; six of them end at single hashes.
BITS, ROUNDS = 10, 6
#: Sources up to this number are broadcast (some 50 bytes each).
MOST_BROADCAST = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(id_col: str = "doc_id") -> Column:
    """60 bits of the id's MD5."""
    digits = F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """``target`` for each row of ``source``, ``source_size`` (one row per source).

    Sources get the weights in turn, in code point order with null last. Shares above
    ``MOST_REPEATS`` times the size stop there and the rest goes to the others by
    weight: ``target = min(limit, level * weight)`` with one level for all. Sources in
    order of limit per weight stop first, so the level is the largest of what each
    source and those after it would get if all before it had stopped.
    """
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    limit = F.col("source_size") * float(MOST_REPEATS)
    weighed = sources.withColumn("weight", F.get(weights, (number - 1) % len(WEIGHTS))).withColumn("limit", limit)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    return (
        weighed.withColumn("level", left / F.sum("weight").over(onward))
        .withColumn("level", F.max("level").over(whole))
        .select("source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))
    )


def _boundaries(sums: DataFrame, width: int) -> DataFrame:
    """Per source, the bucket in which the budget ends, if it ends within them.

    ``sums`` has ``source``, ``room``, ``bucket``, ``words``, ``low``, ``high``. A bucket of one
    hash settles the threshold: it is taken if that comes nearer to the budget.
    """
    reached = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    first = reached.where("upto > room").groupBy("source").agg(
        F.min(F.struct("bucket", "words", (F.col("room") - F.col("upto") + F.col("words")).alias("room"), "low", "high")).alias("e")
    )
    return first.select(
        "source", (F.col("e.bucket") * width).alias("bound"), "e.room", (F.col("e.low") < F.col("e.high")).alias("open"),
        F.when(2 * F.col("e.room") >= F.col("e.words"), F.col("e.high") + 1).otherwise(F.col("e.low")).alias("threshold"),
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Stored tables: ``doc_id``, ``source``, ``size``, ``hash`` of every row, and per source ``target``, ``base``, ``threshold``."""
    sized = materialize(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
            n_words(text_col).alias("size"), doc_hash(id_col).alias("hash"),
        ),
        "sized",
    )
    base = F.least(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(MOST_REPEATS))
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("base", base.cast("long"))
    per_source = materialize(per_source.withColumn("extra", F.col("target") - F.col("base") * F.col("source_size")), "targets")

    settled: list[DataFrame] = []
    edge = per_source.where("extra > 0").select("source", F.col("extra").alias("room"))
    for level in range(1, ROUNDS + 1):
        width = 1 << (BITS * (ROUNDS - level))
        bounds = edge.withColumnRenamed("source", "own")
        same = F.col("source").eqNullSafe(F.col("own"))
        rows = sized
        if level > 1:
            inside = (F.col("hash") >= F.col("bound")) & (F.col("hash") < F.col("bound") + (width << BITS))
            rows = sized.join(bounds, same & inside, "left_semi")
        sums = rows.groupBy("source", F.expr(f"hash div {width}").alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        found = materialize(_boundaries(sums.join(bounds, same).drop("own"), width), "edge")
        settled.append(found.where("not open").select(F.col("source").alias("own"), "threshold"))
        edge = found.where("open").select("source", "bound", "room")
        if edge.isEmpty():
            break
    thresholds = settled[0]
    for more in settled[1:]:
        thresholds = thresholds.unionByName(more)
    known = per_source.join(thresholds, F.col("source").eqNullSafe(F.col("own")), "left")
    return sized, materialize(
        known.select(
            "source", "source_size", "target", "base",
            F.when(F.col("extra") > 0, F.coalesce("threshold", F.lit(1 << 60))).otherwise(0).cast("long").alias("threshold"),
        ),
        "plan",
    )


def _with_copies(rows: DataFrame, per_source: DataFrame, source: Column, hashed: Column) -> DataFrame:
    """Adds ``copies``; the table of sources is broadcast only after its rows are counted."""
    own = per_source.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "base", "threshold")])
    if per_source.count() <= MOST_BROADCAST:
        own = F.broadcast(own)
    return rows.join(own, source.eqNullSafe(F.col("_source"))).withColumn(
        "_copies", F.col("_base") + (hashed < F.col("_threshold")).cast("long")
    )


def taken(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted) of every row."""
    sized, per_source = plan(docs, **columns)
    return _with_copies(sized, per_source, F.col("source"), F.col("hash")).select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("size") * F.col("_copies")).alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; documents without words stay once."""
    sized, per_source = plan(docs, id_col, text_col, source_col)
    # the row's own columns stay inside a struct, so no name of theirs can clash
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source_col}`").cast("string").alias("source"),
        n_words(text_col).alias("size"), doc_hash(id_col).alias("hash"),
    )
    counted = _with_copies(keyed, per_source, F.col("source"), F.col("hash"))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_copies")).cast("int")
    return counted.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("each")).select("row.*")
