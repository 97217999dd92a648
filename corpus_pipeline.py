"""Documents to packed training sequences: five stages, each a Parquet table that the next one reads.

language ID -> line dedup -> near-duplicate removal -> mixing -> packing. All but the last
keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import language_id, line_dedup, mixing, near_dedup, packing, queries
from shelfcast.storage import materialize


#: Rows of a batch that goes to a Python worker. Documents are long, so that the default of 10,000 rows would hold
#: tens of megabytes several times over, in the JVM and in the worker.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects; all labelled rows train it."""
    _small_batches(spark)
    return language_id.with_known_language(docs, F.lit(True))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without boilerplate lines, and without documents of which nothing else is left."""
    cut = line_dedup.without_boilerplate(docs)
    emptied = (F.col("lines_removed") > 0) & (F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]")) == 0)
    return cut.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    _small_batches(spark)
    return near_dedup.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    _small_batches(spark)
    return packing.packed_documents(docs, queries.tokenizer(), end_id=0, size=2048, with_ids=False)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages train models, hash and tokenize, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
