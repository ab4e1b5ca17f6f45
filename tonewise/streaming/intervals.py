"""Messages of topics that open and close while the stream runs: a stream joined with a stream of intervals.

An interval says from when and until when a topic is followed. A message passes if its time lies in an interval of
its topic: the start is included, the end is not. Both streams carry a watermark, and an interval lasts ``longest``
at most, so Spark knows when neither side can match any more and drops it: the state holds the messages of the
last ``longest`` plus the delays, and the intervals that have not run out. An interval may come after messages it
covers, as long as these are still held. Intervals of a topic that overlap would pass a message once each;
``distinct_intervals`` cuts them apart before they are sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tonewise.streaming.live import _start, _store_batch

INTERVAL = T.StructType(
    [T.StructField("topic", T.StringType()), T.StructField("opens", T.TimestampType()), T.StructField("closes", T.TimestampType())]
)
DELAY = "10 seconds"
LONGEST = "1 day"


def distinct_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals of a topic that overlap or touch, as one; empty ones are left out. A topic's intervals meet in one task."""
    some = intervals.where("closes > opens").select("topic", "opens", "closes")
    order = Window.partitionBy("topic").orderBy("opens", "closes")
    reached = F.max("closes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    started = some.withColumn("_new", F.when(F.col("opens") <= reached, 0).otherwise(1))
    numbered = started.withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy("topic", "_run").agg(F.min("opens").alias("opens"), F.max("closes").alias("closes")).drop("_run")


def in_interval(messages: DataFrame, intervals: DataFrame, delay: str = DELAY, longest: str = LONGEST) -> DataFrame:
    """The messages (key, value, timestamp) within an interval of their topic; the same for tables and for streams."""
    limit = F.expr(f"INTERVAL {longest}")
    spans = intervals.where((F.col("closes") > F.col("opens")) & (F.col("closes") <= F.col("opens") + limit))
    if messages.isStreaming:
        messages = messages.withWatermark("timestamp", delay)
        spans = spans.withWatermark("opens", delay)
    held = (
        (F.col("key") == F.col("topic"))
        & (F.col("timestamp") >= F.col("opens"))
        & (F.col("timestamp") < F.col("closes"))
        & (F.col("timestamp") <= F.col("opens") + limit)
    )
    return messages.join(spans, held).select("key", "value", "timestamp")


def stream_followed(
    messages: DataFrame, intervals: DataFrame, path: str, checkpoint: str, once: bool = False, delay: str = DELAY, longest: str = LONGEST
) -> StreamingQuery:
    """The messages of followed topics into a folder, a batch at a time."""
    passed = in_interval(messages, intervals, delay, longest)
    return _start(passed, lambda batch, batch_id: _store_batch(batch, path, batch_id), checkpoint, "append", once)
