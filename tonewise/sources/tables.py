"""Table readers: topic scan, stored-document coercion, lexicon files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewise import schemas
from tonewise.operators.joins import BROADCAST_ROWS


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, **options: str) -> DataFrame:
    """Read a stored table; row formats need their schema declared, so nothing is inferred."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def scan_topic(tweets: DataFrame, topic: str) -> DataFrame:
    """The rows of one topic. The filter sits on the stored column and reaches the scan."""
    return tweets.where(F.col("topic") == topic)


def coerce_tweets(lines: DataFrame, line: str = "value") -> DataFrame:
    """Stored JSON documents as tweet rows.

    user_id may be stored as an int or a long, the location is dropped, ids are unwrapped. A line
    that is no document, or lacks its id or text, is left out.
    """
    parsed = lines.select(F.from_json(F.col(line), schemas.STORED_TWEET).alias("d")).select("d.*")
    return parsed.select(
        F.col("_id.$oid").alias("_id"),
        "tweet_id",
        "createdAt",
        F.lit(None).cast(schemas.LOCATION).alias("latitude"),
        F.coalesce(
            F.col("user_id").try_cast("int").cast("bigint"), F.col("user_id").try_cast("bigint")
        ).alias("user_id"),
        "user_name",
        F.col("user_followers").try_cast("int").alias("user_followers"),
        "tweetText",
        "lenguage",
        "contain_emoji",
        F.col("topic.$oid").alias("topic"),
    ).where(F.col("tweet_id").isNotNull() & F.col("tweetText").isNotNull())


#: Bits of a line's place within its file: room for 16 terabytes.
_FILE_BITS = 44


def lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, place): place is one number that orders the lines as in the files, however Spark splits them.

    Files follow one another by name. Within a file a line's place is the start of its split and the line's number
    in the task. A task reads no more bytes than a split may have, and a line has a byte at least, so no
    line reaches the place of one in a later split. A number, unlike a struct with the name, lets the lookup of
    the last line combine in a hash table.
    """
    lines = spark.read.text(path)
    ranks = [(name, i) for i, name in enumerate(sorted(lines.inputFiles()))]
    files = spark.createDataFrame(ranks, "file string, rank long")
    placed = lines.select(
        F.col("value").alias("line"),
        F.input_file_name().alias("file"),
        (F.input_file_block_start() + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("at"),
    )
    files = F.broadcast(files) if len(ranks) <= BROADCAST_ROWS else files
    rank = F.coalesce("rank", F.raise_error(F.concat(F.lit("not listed: "), "file")).cast("long"))
    return placed.join(files, "file", "left").select("line", (F.shiftleft(rank, _FILE_BITS) + F.col("at")).alias("place"))


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """Tab-separated token and valence; the last line of a token wins.

    max_by combines on the map side, so a token repeated on a third of all lines is no hot group.
    """
    fields = F.split(F.btrim("line", F.lit(" \t\n\x0b\f\r")), "\t", 3)
    rows = lines.select(
        F.get(fields, F.lit(0)).alias("token"),
        F.get(fields, F.lit(1)).try_cast("double").alias("valence"),
        "place",
    )
    return (
        rows.where(F.col("valence").isNotNull())
        .groupBy("token")
        .agg(F.max_by("valence", "place").alias("valence"))
    )


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return parse_lexicon(lexicon_lines(spark, path))


def merge_polarity(positive: DataFrame, negative: DataFrame, up: float = 1.0, down: float = -1.0) -> DataFrame:
    """One-column word lists as (token, valence); a word on both lists is negative."""
    word = F.trim(F.split(F.trim("line"), "\t")[0])
    both = positive.select(word.alias("token"), F.lit(up).alias("valence")).unionByName(
        negative.select(word.alias("token"), F.lit(down).alias("valence"))
    )
    return both.where("token <> ''").groupBy("token").agg(
        F.when(F.max(F.col("valence") == down), down).otherwise(up).alias("valence")
    )


def load_polarity_lists(spark: SparkSession, positive: str, negative: str, **scores: float) -> DataFrame:
    read = lambda path: spark.read.text(path).select(F.col("value").alias("line"))
    return merge_polarity(read(positive), read(negative), **scores)
