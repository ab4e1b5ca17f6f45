"""Labels, class maps, splits, set operations and features."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.functions import labels
from tonewise.functions.fixed_values import ENGLISH_STOP_WORDS
from tonewise.operators import models as ml
from tonewise.operators import splits as sp
from tonewise.operators import tagging as tg
from tonewise.workload import fixtures as fx
from tonewise.workload import query
from tonewise.workload.twin import aliased, blend, bucket, common, five, fold, longest_sentence, scorer, three, three_way, two

WEIGHTS = sp.Weights(0.6, 0.2, 0.2)
NAMES = "['TERRIBLE', 'NEGATIVE', 'NEUTRAL', 'POSITIVE', 'SUPER_NICE']"

MESSAGE = f"messages AS (SELECT tweet_id, {aliased('lower(tweetText)')} AS message FROM tweets)"
VADER_TAG = (MESSAGE, scorer("messages", "tweet_id", "message", "lexicon"))
EMOJI_TAG = (MESSAGE, blend(source="messages", text="message"))
# Tokens without trailing empty ones; no message of the fixture is blank.
TOKENS = "rtrim(message, ' ') AS tokens"


def _amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers around every class boundary: order totals brought to [-1, 1]."""
    value = F.floor((F.col("o_totalprice") - 250000) / 250000 * 1000 + 0.5) / 1000
    return fx.table(spark, sf, "orders").select("o_orderkey", value.cast("double").alias("value"))


AMOUNTS = "amounts AS (SELECT o_orderkey, floor((o_totalprice - 250000) / 250000 * 1000 + 0.5) / 1000 AS value FROM orders)"


@query("to3class", f"WITH {AMOUNTS} SELECT o_orderkey, value, {three('value')} AS class FROM amounts")
def to3class(spark: SparkSession, sf: str) -> DataFrame:
    return _amounts(spark, sf).withColumn("class", labels.three_class(F.col("value")))


@query("to2class", f"WITH {AMOUNTS} SELECT o_orderkey, value, {two('value')} AS class FROM amounts")
def to2class(spark: SparkSession, sf: str) -> DataFrame:
    return _amounts(spark, sf).withColumn("class", labels.two_class(F.col("value")))


@query(
    "score_to_class",
    f"WITH {AMOUNTS} SELECT o_orderkey, value, CASE WHEN value + 1 >= 1.333::DOUBLE THEN 2.0::DOUBLE "
    "WHEN value + 1 <= 0.666::DOUBLE THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS class FROM amounts",
)
def score_to_class(spark: SparkSession, sf: str) -> DataFrame:
    return _amounts(spark, sf).withColumn("class", labels.score_to_class(F.col("value") + 1))


@query(
    "sentiment5",
    f"WITH {AMOUNTS}, coded AS (SELECT o_orderkey, {five('value')} AS code FROM amounts) "
    f"SELECT o_orderkey, code, {NAMES}[code + 1] AS name, code AS code_again, {fold('code')} AS class FROM coded",
)
def sentiment5(spark: SparkSession, sf: str) -> DataFrame:
    """Code to name, name back to code, and five classes folded to three."""
    coded = _amounts(spark, sf).select("o_orderkey", labels.five_class(F.col("value")).alias("code"))
    named = coded.withColumn("name", labels.sentiment_name(F.col("code")))
    return named.select(
        "*",
        labels.sentiment_code(F.col("name")).alias("code_again"),
        labels.five_to_three(F.col("code")).alias("class"),
    )


def _tag(spark: SparkSession, sf: str, tagger: str, kind: str, **options: object) -> DataFrame:
    tagged = tg.tag_rows(fx.tweets(spark, sf, wide=True), tagger, kind, fx.lexicons(spark), **options)
    return tagged.select("tweet_id", "label", F.array_join("tokens", " ").alias("tokens"))


def _tag_sql(parts: tuple[str, ...], scores: str, label: str) -> str:
    return (
        common(*parts)
        + f"SELECT m.tweet_id, {label} AS label, {TOKENS} FROM messages m JOIN {scores} s ON m.tweet_id = s.id"
    )


@query("tag_vader", _tag_sql(VADER_TAG, "scores", three("compound")))
def tag_vader(spark: SparkSession, sf: str) -> DataFrame:
    return _tag(spark, sf, "vader", "rr")


@query("tag_vader_boosting", _tag_sql(VADER_TAG, "scores", f"(({three('compound')}) + 1) / 2"))
def tag_vader_boosting(spark: SparkSession, sf: str) -> DataFrame:
    return _tag(spark, sf, "vader", "boosting")


@query("tag_vader_score", _tag_sql(VADER_TAG, "scores", "compound"))
def tag_vader_score(spark: SparkSession, sf: str) -> DataFrame:
    return _tag(spark, sf, "vader", "api")


STOPPED = f"""kept AS (SELECT tweet_id, string_agg(w, ' ' ORDER BY n) AS message FROM (SELECT tweet_id,
  unnest(string_split(rtrim(message, ' '), ' ')) AS w, generate_subscripts(string_split(rtrim(message, ' '), ' '), 1) AS n
  FROM messages) WHERE w NOT IN ({', '.join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)}) GROUP BY tweet_id)"""


@query(
    "tag_vader_bayes",
    common(*VADER_TAG, STOPPED)
    + f"SELECT m.tweet_id, {two('compound')} AS label, coalesce(k.message, '') AS tokens FROM messages m "
    "JOIN scores s ON m.tweet_id = s.id LEFT JOIN kept k ON m.tweet_id = k.tweet_id",
)
def tag_vader_bayes(spark: SparkSession, sf: str) -> DataFrame:
    return _tag(spark, sf, "vader", "bernoulli", stop_words=ENGLISH_STOP_WORDS)


@query("tag_emoji", _tag_sql(EMOJI_TAG, "bl_scores", three("compound")))
def tag_emoji(spark: SparkSession, sf: str) -> DataFrame:
    return _tag(spark, sf, "emoji", "multinomial")


@query("tag_emoji_score", _tag_sql(EMOJI_TAG, "bl_scores", "compound"))
def tag_emoji_score(spark: SparkSession, sf: str) -> DataFrame:
    return _tag(spark, sf, "emoji", "api")


@query(
    "tag_nlp",
    common(MESSAGE, longest_sentence("tweets", "tweet_id", "tweetText"), scorer("longest", "id", "sentence", "lexicon", p="s_"))
    + f"SELECT m.tweet_id, CAST({fold('(' + five('compound') + ')')} AS DOUBLE) AS label, {TOKENS} FROM messages m "
    "JOIN s_scores s ON m.tweet_id = s.id",
)
def tag_nlp(spark: SparkSession, sf: str) -> DataFrame:
    return _tag(spark, sf, "nlp", "multinomial")


@query(
    "hash_features",
    common(MESSAGE)
    + """SELECT tweet_id, CAST(len(string_split(rtrim(message, ' '), ' ')) AS DOUBLE) AS total, true AS fits FROM messages""",
)
def hash_features(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed counts add up to the number of tokens, over no more entries than distinct tokens."""
    tokens = tg.tokens_of(fx.tweets(spark, sf, wide=True), fx.lexicons(spark))
    counts = vector_to_array("features")
    sums = ml.hash_features(tokens, 1024).select("tweet_id", "tokens", counts.alias("counts"))
    return sums.select(
        "tweet_id",
        F.aggregate("counts", F.lit(0.0), lambda a, c: a + c).alias("total"),
        (F.size(F.filter("counts", lambda c: c > 0)) <= F.size(F.array_distinct("tokens"))).alias("fits"),
    )


@query(
    "split_sizes",
    "SELECT CAST(floor(count(*) * 0.6::DOUBLE) AS BIGINT) AS train, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS validation, "
    "CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS classification FROM documents",
)
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_sizes(fx.tweets(spark, sf), WEIGHTS)


@query("split_random", common() + f"SELECT tweet_id, {three_way('tweet_id')} AS split FROM tweets")
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_random(fx.tweets(spark, sf), WEIGHTS).select("tweet_id", "split")


@query(
    "split_emoji_aware",
    common("share AS (SELECT coalesce(avg(CAST(contain_emoji AS INT)), 0) AS share FROM tweets)")
    + f"""SELECT tweet_id, CASE WHEN share < 0.8 THEN CASE WHEN NOT contain_emoji THEN 'classify'
      WHEN {bucket('tweet_id')} < 0.6::DOUBLE / (0.6::DOUBLE + 0.2::DOUBLE) THEN 'train' ELSE 'validation' END
      ELSE {three_way('tweet_id')} END AS split FROM tweets, share""",
)
def split_emoji_aware(spark: SparkSession, sf: str) -> DataFrame:
    """Too few rows with emoji: those alone are learnt from."""
    return sp.split_emoji_aware(fx.flagged_tweets(spark, sf), WEIGHTS, "emoji").select("tweet_id", "split")


@query(
    "split_emoji_plenty",
    common("share AS (SELECT coalesce(avg(CAST(contain_emoji AS INT)), 0) AS share FROM tweets)")
    + f"""SELECT tweet_id, CASE WHEN share < 0.1 THEN CASE WHEN NOT contain_emoji THEN 'classify'
      WHEN {bucket('tweet_id')} < 0.08::DOUBLE / (0.08::DOUBLE + 0.02::DOUBLE) THEN 'train' ELSE 'validation' END
      ELSE {three_way('tweet_id', 0.08, 0.02)} END AS split FROM tweets, share""",
)
def split_emoji_plenty(spark: SparkSession, sf: str) -> DataFrame:
    """Enough rows with emoji for small training parts: the plain split."""
    weights = sp.Weights(0.08, 0.02, 0.9)
    return sp.split_emoji_aware(fx.flagged_tweets(spark, sf), weights, "emoji").select("tweet_id", "split")


SIDES = """a AS (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_returnflag <> 'R'),
b AS (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 25)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = fx.table(spark, sf, "lineitem")
    columns = ["l_suppkey", "l_quantity"]
    left = items.where("l_returnflag <> 'R'").select(*columns)
    return left, items.where("l_returnflag = 'R' AND l_quantity < 25").select(*columns)


@query(
    "subtract_rows",
    f"WITH {SIDES} SELECT l_suppkey, l_quantity FROM a WHERE NOT EXISTS "
    "(SELECT 1 FROM b WHERE b.l_suppkey = a.l_suppkey AND b.l_quantity = a.l_quantity)",
)
def subtract_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sp.subtract_rows(*_sides(spark, sf))


@query("union_rows", f"WITH {SIDES} SELECT * FROM a UNION ALL SELECT * FROM b")
def union_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sp.union_rows(*_sides(spark, sf))
