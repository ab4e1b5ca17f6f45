"""Streaming jobs: ingest, publish, consume, score and live tallies.

Sources and sinks take their format as a parameter: "kafka" on a cluster that has the connector,
files elsewhere. A foreachBatch sink writes a batch beside the table and then renames it to a folder
named by the batch id. A batch that is run again after a failure finds its folder there and leaves it
alone, so a stream that reads the folder sees every file once. The rename is atomic on HDFS and
local disks; an object store needs a table format that commits in one step instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tonewise.functions import labels
from tonewise.functions.emoji import EmojiAliases
from tonewise.functions.text import longest_sentence
from tonewise.operators.joins import lookup, measure
from tonewise.operators.rows import flatten_statuses, language_fanout, realtime_topics, skip_bad_rows, track_topics
from tonewise.operators.scoring import vader_scores
from tonewise.operators.tagging import Lexicons
from tonewise.session import scratch_dir
from tonewise.sources.sinks import messages
from tonewise.streaming.seen import SeenIds

WINDOW = "5 seconds"
REPEAT_HORIZON = "1 hour"
#: What makes a stored row a repeat.
REPEAT_KEYS = ("tweet_id", "topic", "lenguage")
#: What names a status as it was delivered; the digest is that of all its columns.
STATUS_KEYS = ("tweet_id", "lenguage", "_digest")


def open_stream(
    spark: SparkSession,
    fmt: str,
    path: str | None = None,
    schema: T.StructType | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A message stream; Kafka's binary key and value are read as text."""
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        return reader.load().selectExpr(
            "CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value", "timestamp"
        )
    return reader.schema(schema).load(path)


def _start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str, once: bool
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.foreachBatch(sink).start()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def _store_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store a batch once, whole or not at all."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(batch_folder(path, batch_id))
    files = target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    if files.exists(target):
        df.write.format("noop").mode("overwrite").save()  # the state of a stateful stream still has to be committed
        return
    staged = batch_folder(f"{path}/_staged", batch_id)
    df.write.mode("overwrite").option("compression", "zstd").parquet(staged)
    if not files.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
        raise OSError(f"batch {batch_id} could not be moved to {target}")


def ingest_rows(
    statuses: DataFrame,
    pickups: DataFrame,
    aliases: EmojiAliases,
    languages: Sequence[str],
    language: str = "lang",
    fanout: bool = False,
) -> DataFrame:
    """Status lines to tweet rows: flatten, flag emoji, keep languages, one row per followed topic."""
    return track_topics(_flat(statuses, aliases, languages, language, fanout), pickups)


def _flat(statuses: DataFrame, aliases: EmojiAliases, languages: Sequence[str], language: str = "lang", fanout: bool = False) -> DataFrame:
    return language_fanout(flatten_statuses(statuses, aliases, language=language), languages, fanout)


def stream_ingest(
    statuses: DataFrame,
    pickups: DataFrame,
    aliases: EmojiAliases,
    languages: Sequence[str],
    tweets_path: str,
    messages_path: str,
    checkpoint: str,
    once: bool = False,
    horizon: str = REPEAT_HORIZON,
    seen: SeenIds | None = None,
) -> StreamingQuery:
    """Statuses to the tweet table and the message topic.

    A status delivered again within the horizon is dropped: the state holds only recent ids. The
    horizon counts from arrival, so a status is never too late, however old it is; a replay in any
    order keeps all rows. With a store of seen ids there is no horizon: a repeat is dropped at any
    distance, and the stream keeps no state of its own. Repeats are judged on keys without text; a text is
    shuffled once a delivery, and the messages are made from the stored tweets.
    """
    flat = _flat(statuses, aliases, languages)
    flat = flat.withColumn("_digest", F.md5(F.to_json(F.struct(*flat.columns))))
    sent = flat if seen is not None else _first_keys(flat, pickups, horizon).unionByName(flat, allowMissingColumns=True)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, tweets = batch.sparkSession, batch_folder(tweets_path, batch_id)
        narrow = seen.admit(_followed(batch, pickups), batch_id).persist() if seen is not None else None
        try:
            rows = batch if narrow is None else _keys_and_texts(narrow, batch)
            _store_batch(_with_text(rows, flat), tweets_path, batch_id)
        finally:
            if narrow is not None:
                narrow.unpersist()
        fresh = spark.read.schema(_with_text(rows, flat).schema).parquet(tweets)
        _store_batch(messages(fresh, stamped=True), messages_path, batch_id)
        if seen is not None:
            seen.remember(fresh, batch_id)

    return _start(sent, sink, checkpoint, "append", once)


def _followed(flat: DataFrame, pickups: DataFrame) -> DataFrame:
    """(tweet_id, lenguage, _digest, topic, _key) of each status and topic it is followed by; no text."""
    return track_topics(flat, pickups).select(*STATUS_KEYS, "topic", F.lit(True).alias("_key"))


def _first_keys(flat: DataFrame, pickups: DataFrame, horizon: str) -> DataFrame:
    """The keys that the state has not met within the horizon."""
    keys = _followed(flat, pickups).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
    return keys.dropDuplicatesWithinWatermark(list(REPEAT_KEYS)).drop("_arrived")


def _keys_and_texts(keys: DataFrame, flat: DataFrame) -> DataFrame:
    """Admitted keys and the statuses they may come from; where few are admitted, only theirs."""
    wanted = measure(keys.select(F.col("_digest").alias("_wanted")).distinct(), "_wanted")
    texts = lookup(flat, "_digest", wanted, "left_semi") if wanted.small else flat
    return keys.unionByName(texts, allowMissingColumns=True)


def _with_text(rows: DataFrame, flat: DataFrame) -> DataFrame:
    """Tweet rows of the admitted keys.

    A status travels once, however many topics follow it, and meets its keys there. Its rows lie side by side
    when they are stored, so repeated texts pack well. A status has a key a topic at most.
    """
    columns = [c for c in flat.columns if c not in ("topic", "_digest")]
    rest = [c for c in columns if c not in STATUS_KEYS]
    is_key = F.col("_key").isNotNull()
    met = rows.groupBy(*STATUS_KEYS).agg(
        F.first(F.when(~is_key, F.struct(*rest)), ignorenulls=True).alias("_status"),
        F.collect_list(F.when(is_key, F.struct("topic"))).alias("_topics"),
    )
    met = met.select(*STATUS_KEYS, "_status", F.explode("_topics").alias("_topic"))
    return met.select(*[F.col(c if c in STATUS_KEYS else f"_status.{c}").alias(c) for c in columns], F.col("_topic.topic").alias("topic"))


def publish_stream(
    tweets: DataFrame, fmt: str, checkpoint: str, path: str | None = None, options: Mapping[str, str] | None = None, once: bool = False
) -> StreamingQuery:
    """Send (topic id, text) of every tweet row to a message topic or folder."""
    writer = messages(tweets).writeStream.format(fmt).options(**(options or {}))
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(path) if path else writer.start()


def consume_stream(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Hand every batch of messages on."""
    return _start(stream, handle, checkpoint, "append", once)


def realtime_only(stream: DataFrame, pickups: DataFrame) -> DataFrame:
    """Messages whose key is a real-time topic."""
    return lookup(stream, "key", measure(realtime_topics(pickups), "id"), "left_semi")


def _with_digest(batch: DataFrame) -> DataFrame:
    """Messages with their longest sentence and its digest; those without text are left out."""
    rows = skip_bad_rows(batch, "value").select("key", "value", "timestamp", longest_sentence(F.col("value")).alias("sentence"))
    return rows.withColumn("digest", F.sha2("sentence", 256))


def _texts_repeat(batch: DataFrame) -> bool:
    """Whether a text comes more than once on the whole, as it does once for each topic that follows it."""
    met = batch.agg(F.count("value").alias("rows"), F.approx_count_distinct(F.xxhash64("value")).alias("texts")).first()
    return met["rows"] > 1.5 * met["texts"]


def _with_text_digest(batch: DataFrame) -> DataFrame:
    """Messages and the digest of their whole text."""
    return skip_bad_rows(batch, "value").select("key", "value", "timestamp", F.sha2("value", 256).alias("digest"))


def _distinct_texts(batch: DataFrame) -> DataFrame:
    """(digest, sentence) of each distinct text, which is cut once.

    The count is asked for, as Catalyst leaves a plain distinct out where its rows become distinct again.
    """
    texts = skip_bad_rows(batch, "value").groupBy("value").agg(F.count("*").alias("n")).where("n > 0")
    return texts.select(F.sha2("value", 256).alias("digest"), longest_sentence(F.col("value")).alias("sentence"))


def _distinct_scores(rows: DataFrame, lexicons: Lexicons) -> DataFrame:
    """(scored_digest, code) of each distinct sentence; only sentences are shuffled."""
    sentences = rows.select("digest", "sentence").distinct()
    return vader_scores(sentences, ["digest"], "sentence", lexicons.vader).select(
        F.col("digest").alias("scored_digest"), labels.five_class(F.col("compound")).alias("code")
    )


def _scored(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Messages with the class of their sentence; texts stay where they are while the scores fit a broadcast."""
    joined = lookup(rows, "digest", measure(scores, "scored_digest"))
    return joined.select(
        "key", "value", "timestamp", labels.sentiment_name(F.col("code")).alias("sentiment"), "code"
    )


def score_messages(batch: DataFrame, lexicons: Lexicons) -> DataFrame:
    """key, value, timestamp with the five-class name and code of the longest sentence.

    Sentences repeat, so each distinct one is scored once, and the scores are stored and looked up by digest.
    """
    rows = _with_digest(batch)
    scores, path = _distinct_scores(rows, lexicons), scratch_dir(batch.sparkSession, "sentences")
    scores.write.parquet(path)
    return _scored(rows, batch.sparkSession.read.schema(scores.schema).parquet(path))


def stream_score(stream: DataFrame, lexicons: Lexicons, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Score arriving messages into an append-only table that other streams read.

    The scores of a batch's sentences are kept while the batch is stored, and nothing is left behind. Texts are
    not kept: a text may come once for each topic, so a batch is far larger than what it was read from. Where
    texts repeat, each distinct one is cut and scored once, and messages find its score by a digest of the text;
    elsewhere only sentences are shuffled, and cut a second time. A stream of bounded batches has scores that fit a
    broadcast.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        repeat = _texts_repeat(batch)
        rows = _with_text_digest(batch) if repeat else _with_digest(batch)
        scores = _distinct_scores(_distinct_texts(batch) if repeat else rows, lexicons).persist()
        try:
            _store_batch(_scored(rows, scores), path, batch_id)
        finally:
            scores.unpersist()

    return _start(stream, sink, checkpoint, "append", once)


def window_tally(scored: DataFrame, window: str = WINDOW) -> DataFrame:
    """Counts per topic and window; the same code for a table and for a batch of a stream."""
    code = F.col("code")
    counted = scored.groupBy(F.window("timestamp", window), F.col("key").alias("topic_id")).agg(
        F.count_if(code >= 3).alias("positive"),
        F.count_if(code <= 1).alias("negative"),
        F.count_if(code == 2).alias("neutral"),
    )
    return counted.select(
        "topic_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "positive",
        "negative",
        "neutral",
    )


def stream_tally(scored: DataFrame, path: str, checkpoint: str, once: bool = False, window: str = WINDOW) -> StreamingQuery:
    """Live tallies: every batch stores its own counts, which readers add up.

    Counts of a window may come from any number of batches, so nothing is too late, and no state is
    kept. ``fold_tally`` keeps the number of stored batches small.
    """
    return _start(scored, lambda batch, batch_id: _store_batch(window_tally(batch, window), path, batch_id), checkpoint, "append", once)


def current_tally(stored: DataFrame) -> DataFrame:
    """Counts of each topic and window: the newest fold and the batches after it."""
    fold = stored.agg(F.coalesce(F.min(F.when(F.col("batch_id") < 0, F.col("batch_id"))), F.lit(0))).scalar()
    live = stored.where((F.col("batch_id") == fold) | (F.col("batch_id") >= -fold))
    counts = [F.sum(c).alias(c) for c in ("positive", "negative", "neutral")]
    return live.groupBy("topic_id", "window_start", "window_end").agg(*counts)


def fold_tally(spark: SparkSession, path: str) -> None:
    """Add up what is stored so far as one folder, named -(n + 1) after the last batch n it holds.

    Readers then leave the folded folders out, and they may be removed.
    """
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("batch_id"), F.min("batch_id")).first()
    if last[0] is not None and last[0] >= -last[1]:  # a batch after the newest fold, or no fold yet
        _store_batch(current_tally(stored), path, -(last[0] + 1))
