"""Text functions over the tweet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.functions import emoji as em
from tonewise.functions import text as tx
from tonewise.functions.fixed_values import ENGLISH_STOP_WORDS
from tonewise.operators import rows as rw
from tonewise.operators.tallies import emoji_counts as count_emoji
from tonewise.workload import fixtures as fx
from tonewise.workload import query
from tonewise.workload.twin import aliased, common, longest_sentence, scorer, stripped


def _stop_list() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)


@query("emoji_to_alias", common() + f"SELECT tweet_id, {aliased('lower(tweetText)')} AS message FROM tweets")
def emoji_to_alias(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tweets(spark, sf, wide=True).select(
        "tweet_id", em.emoji_to_alias(F.lower("tweetText"), fx.aliases(spark)).alias("message")
    )


@query("strip_emoji", common() + f"SELECT tweet_id, {stripped('tweetText')} AS clean FROM tweets")
def strip_emoji(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tweets(spark, sf, wide=True).select(
        "tweet_id", em.strip_emoji(F.col("tweetText"), fx.aliases(spark)).alias("clean")
    )


SPACE_SQL = common(
    "split_text AS (SELECT tweet_id, unnest(string_split(rtrim(tweetText, ' '), ' ')) AS token, "
    "generate_subscripts(string_split(rtrim(tweetText, ' '), ' '), 1) - 1 AS position FROM tweets)"
)


@query("space_tokens", SPACE_SQL + "SELECT tweet_id, CAST(position AS INT) AS position, token FROM split_text")
def space_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tx.space_tokens(F.col("tweetText"))
    return fx.tweets(spark, sf, wide=True).select("tweet_id", F.posexplode(tokens).alias("position", "token"))


@query(
    "stopwords",
    SPACE_SQL
    + f"""SELECT t.tweet_id, coalesce(k.message, '') AS message FROM tweets t LEFT JOIN (
      SELECT tweet_id, string_agg(token, ' ' ORDER BY position) AS message FROM split_text
      WHERE lower(token) NOT IN ({_stop_list()}) GROUP BY tweet_id) k ON t.tweet_id = k.tweet_id""",
)
def stopwords(spark: SparkSession, sf: str) -> DataFrame:
    kept = tx.drop_stop_words(tx.space_tokens(F.col("tweetText")), ENGLISH_STOP_WORDS)
    return fx.tweets(spark, sf, wide=True).select("tweet_id", F.array_join(kept, " ").alias("message"))


@query(
    "join_tokens",
    common()
    + "SELECT tweet_id, CASE WHEN rtrim(tweetText, ' ') = '' THEN '' ELSE ' ' || rtrim(tweetText, ' ') END AS joined FROM tweets",
)
def join_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tweets(spark, sf, wide=True).select(
        "tweet_id", tx.join_tokens(tx.space_tokens(F.col("tweetText"))).alias("joined")
    )


@query(
    "senti_tokens",
    common(scorer("tweets", "tweet_id", "tweetText", "lexicon"))
    + "SELECT id AS tweet_id, string_agg(tok, ' ' ORDER BY i) AS tokens, count(*) AS n FROM tok GROUP BY id",
)
def senti_tokens(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("tweetText")
    tokens = tx.strip_runs(body)
    rows = fx.tweets(spark, sf, wide=True).select("tweet_id", tokens.alias("t"))
    return rows.select("tweet_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n"))


@query(
    "caps_differential",
    common(scorer("tweets", "tweet_id", "tweetText", "lexicon")) + "SELECT id AS tweet_id, caps FROM per",
)
def caps_differential(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("tweetText")
    tokens = tx.strip_runs(body)
    rows = fx.tweets(spark, sf, wide=True).select("tweet_id", body.alias("body"), tokens.alias("t"))
    return rows.select("tweet_id", tx.caps_differential(F.col("body"), F.col("t")).alias("caps"))


@query(
    "emoji_counts",
    common(f"found AS (SELECT unnest(regexp_extract_all(tweetText, '{fx.EMOJI_PATTERN}')) AS emoji FROM tweets)")
    + "SELECT f.emoji, a.alias, count(*) AS n FROM found f JOIN emoji_alias a ON f.emoji = a.emoji GROUP BY f.emoji, a.alias",
)
def emoji_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_emoji(fx.tweets(spark, sf, wide=True), fx.aliases(spark))


@query(
    "hashtags",
    common()
    + "SELECT DISTINCT tweet_id, hashtag FROM (SELECT tweet_id, unnest(string_split(tweetText, ' ')) AS hashtag FROM tweets) "
    "WHERE starts_with(hashtag, '#')",
)
def hashtags(spark: SparkSession, sf: str) -> DataFrame:
    return rw.hashtag_rows(fx.tweets(spark, sf, wide=True), "tweet_id")


@query(
    "longest_sentence",
    common(longest_sentence("tweets", "tweet_id", "tweetText")) + "SELECT id AS tweet_id, sentence FROM longest",
)
def longest(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tweets(spark, sf, wide=True).select(
        "tweet_id", tx.longest_sentence(F.col("tweetText")).alias("sentence")
    )
