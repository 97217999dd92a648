"""Where intermediate tables live, and how lineage is cut.

A cluster names a shared folder in ``spark.checkpoint.dir``. Tables that several
steps read are written there once, so that later steps read pruned columns and a
lost executor costs a re-read, not a recomputation. Only a local session, where
the setting is absent, gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Codec of tables that hold all order lines, or statistics of as many pairs: a quarter smaller than Spark's default.
DENSE = "zstd"

_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's shared scratch folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folder:
        _local_folder[context.applicationId] = tempfile.mkdtemp(prefix="shelfcast-")
    return _local_folder[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody has used yet."""
    return f"{shared_folder(spark)}/shelfcast/{uuid.uuid4().hex}/{name}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the shared folder where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; keeps rows in their partitions and in order."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table; ``codec`` is the session's if none is given."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(run, tables: dict[str, DataFrame]) -> dict:
    """``run(name, table)`` for independent tables, their jobs running side by side."""
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        return dict(zip(tables, pool.map(inheritable_thread_target(spark)(lambda item: run(*item)), tables.items())))


def materialize_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Materialize independent tables."""
    return side_by_side(lambda name, df: materialize(df, name, DENSE), tables)
