"""Serve a stream of recommendation requests in micro-batches.

The reference answers requests one HTTP call at a time; here a request
stream (files, a message bus, anything ``readStream`` can read) is routed
per micro-batch by the same batch operators (``route_requests`` or the
cold-start cascade). Each batch writes its own output folder with
overwrite, so a batch retried after a failure replaces its partial output
(exactly-once together with the streaming checkpoint).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def serve_requests(requests: DataFrame, route: Callable[[DataFrame], DataFrame], out_dir: str,
                   checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the serving query; ``route(batch)`` returns the ranked responses of a batch."""
    if not requests.isStreaming:
        raise ValueError("requests must be a streaming DataFrame")

    def each(batch: DataFrame, batch_id: int) -> None:
        route(batch).withColumn("batch_id", F.lit(batch_id)) \
            .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    w = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
