"""Requests answered once, with dimensions that grow while the stream runs (T-01 with state).

Requests land as files; clients repeat a request when they don't hear back, and
files are delivered again.  The state store remembers the request keys seen
within ``delay`` of their first landing, across micro-batches and restarts, so a
repeat is not scored again.  Each micro-batch reads the title and user tables
anew: rows that landed after the stream was started are known to the next batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelsight.schemas import REQUEST_SCHEMA
from reelsight.streaming.requests import score_request_stream

DELAY = "1 day"
LANDED = "landed_at"


def landed_requests(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Requests from JSON-lines files, with the time their file landed.

    That time is never null and the files are taken in its order, so no
    request comes too late for the watermark.
    """
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(source_dir).select("*", F.col("_metadata.file_modification_time").alias(LANDED))


def request_key() -> Column:
    """What makes two requests the same: the id; without one, all fields."""
    fields = [F.col(f.name).cast("string") for f in REQUEST_SCHEMA.fields]
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.coalesce(F.concat(F.lit("id:"), F.col("RequestID").cast("string")), F.concat(F.lit("row:"), F.sha2(whole, 256)))


def answered_once(requests: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first request of each key; its repeats go for at least ``delay`` after it landed.

    The state holds one key per request of the last ``delay``, hashed over the
    shuffle partitions, and expires by the watermark: it doesn't grow with the stream.
    """
    return requests.withColumn("_key", request_key()).withWatermark(LANDED, delay) \
        .dropDuplicatesWithinWatermark(["_key"]).drop("_key", LANDED)


def score_once(spark: SparkSession, source_dir: str, score: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
               users: Callable[[], DataFrame], items: Callable[[], DataFrame], sink_dir: str, checkpoint: str,
               delay: str = DELAY, max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """T-01: ``score(batch, users(), items())`` on the requests of each micro-batch that were not answered before.

    ``users`` and ``items`` read their tables when called, once per batch.  A
    batch that failed is scored again under its number and overwrites its
    folder, with the same requests: its state is committed with the batch.
    """
    stream = answered_once(landed_requests(spark, source_dir, max_files_per_trigger), delay)
    return score_request_stream(stream, lambda batch: score(batch, users(), items()), sink_dir, checkpoint, available_now)
