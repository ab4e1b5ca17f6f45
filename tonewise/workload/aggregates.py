"""Tallies and small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.functions import labels
from tonewise.operators import tagging as tg
from tonewise.operators import tallies as ta
from tonewise.operators.splits import dataset_counts as count_dataset
from tonewise.workload import fixtures as fx
from tonewise.workload import query
from tonewise.workload.twin import blend, common, five, fold, longest_sentence, scorer, stripped, three, two

RUN = "run-1"
BY = ["topic"]

VADER_RUN = (
    f"clean AS (SELECT tweet_id, topic, {stripped('tweetText')} AS clean FROM tweets)",
    scorer("clean", "tweet_id", "clean", "lexicon"),
    "runs AS (SELECT t.tweet_id, t.topic, s.compound AS result FROM scores s JOIN tweets t ON s.id = t.tweet_id)",
)
EMOJI_RUN = (
    blend(),
    "runs AS (SELECT t.tweet_id, t.topic, s.compound AS result FROM bl_scores s JOIN tweets t ON s.id = t.tweet_id)",
)
SENTENCE_RUN = (
    longest_sentence("tweets", "tweet_id", "tweetText"),
    scorer("longest", "id", "sentence", "lexicon", p="s_"),
    f"coded AS (SELECT id, {five('compound')} AS code FROM s_scores)",
    f"runs AS (SELECT t.tweet_id, t.topic, CAST({fold('code')} AS DOUBLE) AS result FROM coded c JOIN tweets t ON c.id = t.tweet_id)",
)
RESULT_SQL = "SELECT concat('run-1-', tweet_id) AS id, tweet_id AS \"idTweet\", 'run-1' AS \"idExecution\", '{kind}' AS \"typeModel\", result, topic FROM runs"


def _counts(positive: str, negative: str, neutral: str) -> str:
    parts = {"positive": positive, "negative": negative, "neutral": neutral}
    counted = ", ".join(f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in parts.items())
    return f"SELECT topic, {counted} FROM runs GROUP BY topic"


@query("run_vader", common(*VADER_RUN) + RESULT_SQL.format(kind="vader"))
def run_vader(spark: SparkSession, sf: str) -> DataFrame:
    return tg.run_vader(fx.tweets(spark, sf, wide=True), fx.lexicons(spark), RUN, BY)


@query("run_emoji", common(*EMOJI_RUN) + RESULT_SQL.format(kind="emoji"))
def run_emoji(spark: SparkSession, sf: str) -> DataFrame:
    return tg.run_emoji(fx.tweets(spark, sf, wide=True), fx.lexicons(spark), RUN, BY)


@query("run_sentences", common(*SENTENCE_RUN) + RESULT_SQL.format(kind="nlp"))
def run_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return tg.run_sentences(fx.tweets(spark, sf, wide=True), fx.lexicons(spark), RUN, BY)


API_SQL = f"""api AS ({fx.API_RESPONSES}),
runs AS (SELECT t.tweet_id, t.topic, CASE WHEN CAST(neg AS DOUBLE) > CAST(pos AS DOUBLE) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
  AS result FROM api a JOIN tweets t ON a.tweet_id = t.tweet_id)"""


@query("import_api_scores", common(API_SQL) + RESULT_SQL.format(kind="api"))
def import_api_scores(spark: SparkSession, sf: str) -> DataFrame:
    return tg.import_api_scores(fx.tweets(spark, sf), fx.api_responses(spark, sf), RUN, BY)


@query("tally_vader", common(*VADER_RUN) + _counts("result > 0.5", "result <= -0.5", "result > -0.5 AND result < 0.5"))
def tally_vader(spark: SparkSession, sf: str) -> DataFrame:
    return ta.tally(run_vader(spark, sf), "vader", BY)


@query("tally_emoji", common(*EMOJI_RUN) + _counts("result > 0.6", "result < 0.4", "result BETWEEN 0.4 AND 0.6"))
def tally_emoji(spark: SparkSession, sf: str) -> DataFrame:
    return ta.tally(run_emoji(spark, sf), "emoji", BY)


@query("tally_nlp", common(*SENTENCE_RUN) + _counts("result > 0.6", "result < 0.4", "result BETWEEN 0.4 AND 0.6"))
def tally_nlp(spark: SparkSession, sf: str) -> DataFrame:
    return ta.tally(run_sentences(spark, sf), "nlp", BY)


def _relabelled(expression: str) -> tuple[str, ...]:
    return (*VADER_RUN, f"vader_runs AS (SELECT topic, {expression} AS result FROM runs)")


def _class_counts(expression: str, positive: str, negative: str, neutral: str) -> str:
    return common(*_relabelled(expression)) + _counts(positive, negative, neutral).replace("FROM runs", "FROM vader_runs")


def _tally_class(spark: SparkSession, sf: str, kind: str, result: F.Column) -> DataFrame:
    """Tally of class predictions; the class comes from the lexicon score of the same tweet."""
    return ta.tally(run_vader(spark, sf).select("topic", result.alias("result")), kind, BY)


@query("tally_bernoulli", _class_counts(two("result"), "result = 1", "result = 0", "false"))
def tally_bernoulli(spark: SparkSession, sf: str) -> DataFrame:
    return _tally_class(spark, sf, "bernoulli", labels.two_class(F.col("result")))


@query("tally_multinomial", _class_counts(three("result"), "result = 2", "result = 0", "result = 1"))
def tally_multinomial(spark: SparkSession, sf: str) -> DataFrame:
    return _tally_class(spark, sf, "multinomial", labels.three_class(F.col("result")))


@query("tally_boosting", _class_counts(f"(({three('result')}) + 1) / 2", "result > 1", "result <= 1", "false"))
def tally_boosting(spark: SparkSession, sf: str) -> DataFrame:
    return _tally_class(spark, sf, "boosting", labels.boosting_label(F.col("result")))


@query("tally_rr", _class_counts(three("result"), "result >= 1.333", "result <= 0.666", "result > 0.666 AND result < 1.333"))
def tally_rr(spark: SparkSession, sf: str) -> DataFrame:
    return _tally_class(spark, sf, "rr", labels.three_class(F.col("result")))


@query(
    "sentence_agg",
    "SELECT l_orderkey, CAST(sum(l_linenumber) // count(*) AS DOUBLE) AS mean, CAST(max(l_linenumber) AS DOUBLE) AS max, "
    "CAST(min(m) AS DOUBLE) AS mode FROM (SELECT *, CASE WHEN n = max(n) OVER (PARTITION BY l_orderkey) THEN l_linenumber END AS m "
    "FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)) GROUP BY l_orderkey",
)
def sentence_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, maximum and mode of small whole numbers per group."""
    return ta.sentence_aggregate(fx.table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    "topic_counts",
    common("topics AS (SELECT concat('src', c_custkey) AS id, CAST(40 + c_custkey % 20 AS BIGINT) AS warn_at FROM customer)")
    + """SELECT p.id, coalesce(t."nTweets", 0) AS "nTweets", coalesce(t."nEmojis", 0) AS "nEmojis",
    coalesce(t."nTweets", 0) >= p.warn_at AS warn FROM topics p LEFT JOIN (SELECT topic, count(*) AS "nTweets",
    count(*) FILTER (WHERE contain_emoji) AS "nEmojis" FROM tweets GROUP BY topic) t ON p.id = t.topic""",
)
def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Followed topics, of which most have no tweets."""
    topics = fx.table(spark, sf, "customer").select(
        F.concat(F.lit("src"), F.col("c_custkey")).alias("id"), (40 + F.col("c_custkey") % 20).alias("cuantity_warn")
    )
    return ta.topic_counts(fx.flagged_tweets(spark, sf), topics)


@query(
    "dataset_counts",
    common() + "SELECT count(*) AS tweets, count(*) FILTER (WHERE contain_emoji) AS emoji_tweets FROM tweets",
)
def dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_dataset(fx.flagged_tweets(spark, sf))
