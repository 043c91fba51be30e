"""Any write path as a Structured Streaming query over its request feed.

Requests arrive as JSON files (or any streaming source with the feed's
schema). Each micro-batch runs one job from :mod:`cobbler.plans.jobs` against
the latest published tables and publishes the result as the shop's next batch
(:mod:`cobbler.plans.snapshots`). The batch's manifest names the feed and its micro-batch:
a restarted query finds its own published micro-batches by that name and skips
them, whatever other feeds or jobs published in between, so each micro-batch takes
effect exactly once.

JSON bodies are read as text, and those that are no request of the feed's schema are set apart in the shop's
``malformed_requests`` (:func:`cobbler.plans.jobs.quarantined`) instead of failing the feed or turning into nulls.

Order: micro-batches apply in arrival order, as the reference's handlers apply
requests as they come; within one micro-batch the job's own feed order holds
(``(ts, request_id)``). A late request is therefore applied after those already
published, never re-sequenced before them, and no watermark is needed: no state
is kept between micro-batches except the published tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import MERGE, quarantined
from ..plans.snapshots import ConcurrentPublish, compact, run_batch
from ..sources.tables import BODY

Job = Callable[[dict[str, DataFrame], DataFrame], tuple[dict[str, DataFrame], dict[str, DataFrame]]]

#: Attempts of a micro-batch when other writers publish at the same time.
ATTEMPTS = 5
#: A feed compacts appended parts after so many of its micro-batches.
COMPACT_EVERY = 32


def apply_micro_batch(spark: SparkSession, root: str, job: Job, batch: DataFrame, feed: str, number: int) -> None:
    """Publish micro-batch ``number`` of ``feed``, unless it is published already."""
    for attempt in range(ATTEMPTS):
        try:
            run_batch(spark, root, None, lambda t: job(t, batch), source=f"{feed}:{number}")
            break
        except ConcurrentPublish:           # the tables changed: run the job again on the new ones
            if attempt + 1 == ATTEMPTS:
                raise
    if number % COMPACT_EVERY == COMPACT_EVERY - 1:
        try:
            compact(spark, root, COMPACT_EVERY, MERGE)
        except ConcurrentPublish:           # left to the next time
            pass


def start_feed(spark: SparkSession, root: str, source_dir: str, schema: T.StructType, job: Job,
               checkpoint_location: str, feed: str, available_now: bool = True,
               max_files_per_trigger: int | None = None, fmt: str = "json") -> StreamingQuery:
    """Run ``job`` on every micro-batch of the feed under ``source_dir``.

    ``feed`` names this feed in the manifests; it belongs to its ``checkpoint_location`` and must be
    another for every feed of a shop, and the same across restarts. ``available_now``
    drains what is there and stops; otherwise the query triggers every 30 seconds.
    """
    if fmt == "json":
        reader, job = spark.readStream.format("text"), quarantined(job, schema, feed)
    else:
        reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    if fmt == "json":
        stream = stream.withColumnRenamed("value", BODY)
    writer = (stream.writeStream
              .foreachBatch(lambda df, number: apply_micro_batch(spark, root, job, df, feed, number))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
