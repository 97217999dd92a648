"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space and words as every operator on words sees them.
WORD = r"[^\x20\x09-\x0D]+"
FIRST_KEY = -(2**63)


def shuffle_partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose strings hold about ``limit`` bytes; a longer row comes alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).tolist()
        begin, held = 0, 0
        for at, size in enumerate(sizes):
            if at > begin and held + size > limit:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, which gives its memory back when a task's batches end: workers live on beside later, JVM-only stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Smallest key of each non-empty range of a split into ``parts`` ranges.

    Only keys are shuffled, and at most ``parts`` numbers reach the driver. A null
    key counts as the smallest number.
    """
    keys = df.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST_KEY)).alias("k"))
    firsts = keys.repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    return sorted({r["k"] for r in firsts.collect()})


def hash128(*columns) -> tuple:
    """Two independent 64-bit hashes; together they tell texts apart at any size."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
