"""Continuous Add: a stream of requests into the memory table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from turnstore.plans.add import AddJob
from turnstore.schemas import ADD_REQUEST
from turnstore.sources.requests import with_corrupt


def request_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Add requests as files arrive below *path*; unreadable JSON lines keep their text."""
    reader = spark.readStream.schema(with_corrupt(ADD_REQUEST) if fmt == "json" else ADD_REQUEST).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_ingest(requests: DataFrame, job: AddJob, checkpoint: str, first_batch: int = 0,
                 available_now: bool = False) -> StreamingQuery:
    """Write every micro-batch with *job*; a batch is searchable once it is committed.

    Spark may deliver a micro-batch again after a failure. Only a committed attempt
    is visible, and the ledger makes a request that comes back a no-op, however
    late it is and whatever the stream. *first_batch* only labels the batches. One
    stream writes a table at a time, which is what makes ``seq`` monotone per user.
    Rejected and unreadable requests are kept in the quarantine of the store.
    """

    def write(batch: DataFrame, number: int) -> None:
        job.run(batch, first_batch + number)

    writer = (requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
              .outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
