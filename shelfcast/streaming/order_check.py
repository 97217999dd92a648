"""Order checks as a Structured Streaming job.

Stateless: every request is parsed, joined to the static action list and written to the
log or to the error answers. There is no watermark, because nothing waits for later events;
the checkpoint makes a restarted job continue where it stopped. Each batch has folders of
its own, so that a repeated one leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.requests import check_requests, error_rows, log_rows

#: Partition column of both outputs.
BATCH = "batch_id"


def request_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Payloads from the text files that arrive in a folder."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).withColumnRenamed("value", "payload")


def append_to(
    rows: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append a stream to parquet; ``once`` handles what is there and stops."""
    writer = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def store_checked(batch: DataFrame, batch_id: int, actions: DataFrame, log_path: str, error_path: str) -> None:
    """Check one batch and write both outputs, each to the folder of this batch.

    Payloads are parsed and looked up once for both. A batch that comes again, after a
    failure between the writes and the commit, replaces its own folders and adds nothing.
    """
    routed = check_requests(batch, actions).persist()
    try:
        log_rows(routed).write.mode("overwrite").parquet(f"{log_path}/{BATCH}={batch_id}")
        error_rows(routed).write.mode("overwrite").parquet(f"{error_path}/{BATCH}={batch_id}")
    finally:
        routed.unpersist()


def run_order_checks(
    requests: DataFrame,
    actions: DataFrame,
    log_path: str,
    error_path: str,
    checkpoint: str,
    once: bool = True,
) -> list[StreamingQuery]:
    """One stream with two outputs: the shortage log and the error answers, by batch."""

    def store(batch: DataFrame, batch_id: int) -> None:
        store_checked(batch, batch_id, actions, log_path, error_path)

    writer = requests.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return [(writer.trigger(availableNow=True) if once else writer).start()]


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """What the stream has written to one of its outputs."""
    return spark.read.parquet(path).drop(BATCH)
