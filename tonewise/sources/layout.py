"""Tables laid out for their two questions: one topic's rows, and results next to their tweets.

A table is partitioned by topic and, within a topic, bucketed and sorted by tweet. A scan of one topic reads its
folder only; a join with topics chosen at run time reads the folders of those (run-time partition pruning); and
results with the same buckets join their tweets without a shuffle. Rows are dealt by topic and bucket before the
write, so a task writes whole files and a topic with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.operators.tallies import thresholds

BUCKETS = 16


def write_by_topic(rows: DataFrame, table: str, key: str = "tweet_id", topic: str = "topic", buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """A managed table by topic, bucketed by ``key``; rows without a topic are kept in a folder of their own."""
    dealt = rows.repartition(buckets, key)
    dealt.write.mode(mode).format("parquet").partitionBy(topic).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_results_by_tweet(results: DataFrame, table: str, key: str = "tweet_id", buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """A managed table of results in the buckets of their tweets."""
    results.repartition(buckets, key).write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def topic_rows(spark: SparkSession, table: str, topic: str) -> DataFrame:
    return spark.table(table).where(F.col("topic") == topic)


def rows_of_topics(spark: SparkSession, table: str, topics: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the topics in a table; only their folders are read."""
    chosen = topics.select(F.col(key).alias("_topic")).where(F.col("_topic").isNotNull()).distinct()
    tweets = spark.table(table)
    return tweets.join(F.broadcast(chosen), tweets["topic"] == chosen["_topic"]).drop("_topic")


def tally_by_topic(spark: SparkSession, tweets: str, results: str, kind: str, key: str = "tweet_id") -> DataFrame:
    """Counts per topic of a results table; the join needs no shuffle, the counts combine before theirs."""
    joined = spark.table(results).join(spark.table(tweets).select(key, "topic"), key)
    counts = [F.count_if(test).alias(name) for name, test in thresholds(kind, F.col("result")).items()]
    return joined.groupBy("topic").agg(*counts)
