"""Event-time windows over out-of-order messages: closed once, open ones carried on, late rows kept aside.

The watermark of a batch is the latest event time of the batches before it, less the delay. A row whose window
ended by then is late and goes to the late rows; so does a row without a time. The others are counted into the
open windows. After the batch the watermark moves on, and the windows that ended by the new one are closed: they
are written once, never change and leave the state. The state is the open windows, one row per topic and window,
bounded by topics times delay, whatever the length of the stream.

Each batch writes one folder with its closed and open windows, its late rows and its latest time, committed by
one rename. A batch that runs again reads the same state and finds its folder, so nothing is counted twice.
Counts combine on the map side before the shuffle, so a topic with a third of all rows is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonewise.streaming.batches import batch_ids, commit_folder
from tonewise.streaming.live import WINDOW, _start, window_tally

DELAY = "10 seconds"
COUNTS = ("positive", "negative", "neutral")
STORED = (
    "topic_id string, window_start timestamp, window_end timestamp, positive long, negative long, neutral long, "
    "key string, timestamp timestamp, code int, latest timestamp, kind string"
)
CLOSED, OPEN, LATE, MARK = "closed", "open", "late", "mark"


def _folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def advance(batch: DataFrame, before: DataFrame | None, delay: str, window: str) -> DataFrame:
    """The stored rows of a batch (key, timestamp, code), given those of the batch before."""
    spark = batch.sparkSession
    lag = F.expr(f"INTERVAL {delay}")
    last = before.where(F.col("kind") == MARK).select("latest").first() if before is not None else None
    last = last["latest"] if last is not None else None
    newest = batch.agg(F.max("timestamp").alias("latest")).first()["latest"]
    latest = max([t for t in (last, newest) if t is not None], default=None)

    span = F.window("timestamp", window)
    mark = F.lit(last).cast("timestamp") - lag
    is_late = F.col("timestamp").isNull() | F.coalesce(span["end"] <= mark, F.lit(False)) if last is not None else F.col("timestamp").isNull()
    # window() leaves rows without a time out, so these are told apart before it is asked
    timed = batch.where("timestamp IS NOT NULL").withColumn("_late", is_late)
    late = timed.where("_late").select("key", "timestamp", "code").unionByName(batch.where("timestamp IS NULL").select("key", "timestamp", "code"))
    counted = window_tally(timed.where("NOT _late"), window)
    if before is not None:
        counted = counted.unionByName(before.where(F.col("kind") == OPEN).select(*counted.columns))
        counted = counted.groupBy("topic_id", "window_start", "window_end").agg(*[F.sum(c).alias(c) for c in COUNTS])
    done = F.coalesce(F.col("window_end") <= F.lit(latest).cast("timestamp") - lag, F.lit(False))
    parts = [
        counted.withColumn("kind", F.when(done, CLOSED).otherwise(OPEN)),
        late.withColumn("kind", F.lit(LATE)),
        spark.range(1).select(F.lit(latest).cast("timestamp").alias("latest"), F.lit(MARK).alias("kind")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in STORED.split(", ")])


def store_windows(batch: DataFrame, batch_id: int, path: str, delay: str = DELAY, window: str = WINDOW) -> None:
    """Take a batch in; one that is stored already is left alone."""
    spark = batch.sparkSession
    earlier = batch_ids(spark, path)
    if batch_id in earlier:
        return
    earlier = [i for i in earlier if i < batch_id]
    before = spark.read.schema(STORED).parquet(_folder(path, earlier[-1])) if earlier else None
    staged = f"{path}/_staged-{batch_id}"
    batch.persist()
    try:
        advance(batch.select("key", "timestamp", F.col("code").cast("int").alias("code")), before, delay, window).write.mode("overwrite").partitionBy("kind").parquet(staged)
    finally:
        batch.unpersist()
    commit_folder(spark, staged, path, batch_id)


def stream_windows(scored: DataFrame, path: str, checkpoint: str, once: bool = False, delay: str = DELAY, window: str = WINDOW) -> StreamingQuery:
    """Tallies by event time of a stream of scored messages."""
    return _start(scored, lambda batch, batch_id: store_windows(batch, batch_id, path, delay, window), checkpoint, "append", once)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{STORED}, batch_id long").parquet(path)


_TALLY = ("topic_id", "window_start", "window_end", *COUNTS)


def closed_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows that are final, each once; only their files are read."""
    return _stored(spark, path).where(F.col("kind") == CLOSED).select(*_TALLY, "batch_id")


def open_windows(spark: SparkSession, path: str) -> DataFrame:
    """The state: windows that may still change."""
    last = max(batch_ids(spark, path))
    return _stored(spark, path).where((F.col("kind") == OPEN) & (F.col("batch_id") == last)).select(*_TALLY)


def current_windows(spark: SparkSession, path: str) -> DataFrame:
    """All windows as they stand: the view that a stream in update mode would show."""
    return closed_windows(spark, path).drop("batch_id").unionByName(open_windows(spark, path))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).where(F.col("kind") == LATE).select("key", "timestamp", "code", "batch_id")
