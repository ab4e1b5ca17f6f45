"""Shapes the given tables into tweets, lexicons, topics, models and runs.

Every statement runs unchanged on Spark and in the SQL twin unless it is built by a function here.
Whole texts are kept; a phrase that triggers scoring rules is put in front or behind, and some
frequent words are exchanged for rule words, so the rules also fire within the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.functions.emoji import EmojiAliases, load_aliases
from tonewise.operators.rows import flag_emoji
from tonewise.operators.tagging import Lexicons
from tonewise.session import spread

PHRASE = """CASE doc_id % 16 WHEN 0 THEN 'good!!' WHEN 1 THEN '😀 great day' WHEN 2 THEN 'not good??'
  WHEN 3 THEN 'bad but great' WHEN 4 THEN 'GREAT #win' WHEN 5 THEN 'this very good'
  WHEN 6 THEN '😡 awful 💔' WHEN 7 THEN 'kind of bad' WHEN 8 THEN 'never this good'
  WHEN 9 THEN 'they will cut the mustard' WHEN 10 THEN 'least good' WHEN 11 THEN 'has just enough good'
  WHEN 12 THEN 'happy, BUT bad!' WHEN 13 THEN '👍 #win #win' WHEN 14 THEN 'a really AWFUL, "bad" day ' ELSE '' END"""

BODY = """replace(replace(replace(replace(text, chr(10), ' '),
  CASE WHEN doc_id % 3 = 0 THEN ' with ' ELSE ' never ' END, ' not '),
  CASE WHEN doc_id % 5 = 2 THEN ' for ' ELSE ' but ' END, ' but '),
  CASE WHEN doc_id % 7 = 3 THEN ' on ' ELSE ' very ' END, ' very ')"""

TWEETS = f"""SELECT doc_id AS tweet_id, CAST(1704067200000 + doc_id * 1000 AS BIGINT) AS createdAt,
  CAST(doc_id % 97 AS BIGINT) AS user_id, concat('user', CAST(doc_id % 97 AS STRING)) AS user_name,
  CAST(doc_id % 5000 AS INT) AS user_followers,
  coalesce(CASE WHEN doc_id % 32 < 16 THEN concat({PHRASE}, ' ', {BODY}) ELSE concat({BODY}, ' ', {PHRASE}) END, '') AS tweetText,
  lang AS lenguage, source AS topic FROM documents"""

LEXICON = """SELECT token, CAST(valence AS DOUBLE) AS valence FROM (VALUES ('good',1.9),('great',3.1),('bad',-2.5),
  ('happy',2.7),('awful',-2.0),('mustard',1.0),('is',0.6),('that',-0.4),('de',0.3),('der',-0.9),('of',0.2),
  ('die',-0.6),(':grinning:',2.0)) AS t(token, valence)"""

EMOJI_ALIAS = """SELECT emoji, alias FROM (VALUES ('😀',':grinning:'),('😡',':rage:'),('❤',':heart:'),
  ('🎉',':tada:'),('👍',':+1:'),('💔',':broken_heart:')) AS t(emoji, alias)"""

EMOJI_POLARITY = """SELECT token, CAST(valence AS DOUBLE) AS valence FROM (VALUES ('😀',1),(':grinning:',1),('😡',-1),
  (':rage:',-1),('❤',1),(':heart:',1),('🎉',1),(':tada:',1),('👍',1),(':+1:',1),('💔',-1),(':broken_heart:',-1))
  AS t(token, valence)"""

WORD_POLARITY = """SELECT token, CAST(valence AS DOUBLE) AS valence FROM (VALUES ('good',1),('great',1),('happy',1),
  ('bad',-1),('awful',-1),('der',-1),('is',1)) AS t(token, valence)"""

# Topics to follow, one per benchmark passage: its first words are one phrase, the next another.
TRACKED = """SELECT concat('b', CAST(item_id AS STRING)) AS id, {phrases} AS topics,
  CAST(20 + item_id AS BIGINT) AS cuantity_warn, 0 AS nEmojis, 'created' AS state, 0 AS nTweets,
  item_id % 2 = 0 AS isRT FROM benchmark"""

PICKUPS = """SELECT concat('t', CAST(c_custkey AS STRING)) AS id, c_mktsegment AS keyword,
  CAST(c_custkey % 400 AS BIGINT) AS cuantity_warn,
  CASE c_custkey % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'ready' WHEN 2 THEN 'inprocess' WHEN 3 THEN 'stopped'
    ELSE 'finished' END AS state, c_custkey % 3 = 0 AS isRT, c_acctbal AS balance FROM customer"""

EXECUTIONS = """SELECT concat('r', CAST(o_custkey AS STRING)) AS id, concat('m', CAST(o_custkey % 100 AS STRING)) AS modelId,
  concat('src', CAST(o_custkey % 20 AS STRING)) AS topicId, CAST(o_orderkey AS BIGINT) AS dateExecution,
  CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'P' THEN 'trained' ELSE 'runned' END AS status FROM orders"""

ACTIONS = """SELECT concat('r', CAST(o_custkey AS STRING)) AS run, CASE o_orderstatus WHEN 'O' THEN 'train'
  WHEN 'P' THEN 'evaluate' ELSE 'execute' END AS action, CAST(o_orderkey AS BIGINT) AS asked_at,
  CAST(o_custkey AS BIGINT) AS seq FROM orders"""

AGGS = """SELECT concat(l_returnflag, '-', CAST(l_suppkey AS STRING)) AS id, concat('src', CAST(l_suppkey % 20 AS STRING)) AS topic_id,
  concat('m', CAST(l_suppkey AS STRING)) AS model_id, CAST(sum(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END) AS BIGINT) AS positive,
  CAST(sum(CASE WHEN l_quantity < 20 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
  CAST(sum(CASE WHEN l_quantity BETWEEN 20 AND 30 THEN 1 ELSE 0 END) AS BIGINT) AS neutral
  FROM lineitem GROUP BY l_returnflag, l_suppkey"""

API_RESPONSES = """SELECT doc_id AS tweet_id, toxic * 0.6 + (doc_id % 10) / 25.0 AS neg, 0.1 AS neutral,
  quality * 0.5 + (doc_id % 7) / 30.0 AS pos FROM labels"""

EMOJI_PATTERN = "😀|😡|❤|🎉|👍|💔"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shaped(spark: SparkSession, sf: str, statement: str, source: str) -> DataFrame:
    """Run a fixture statement with its one source table bound to the parquet scan."""
    head, _, tail = statement.rpartition(f"FROM {source}")
    return spark.sql(f"{head}FROM {{{source}}}{tail}", **{source: table(spark, sf, source)})


def tweets(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    """Tweet rows; ``wide`` spreads a scan of fewer partitions than cores before heavy text work."""
    documents = table(spark, sf, "documents")
    documents = spread(documents, "doc_id") if wide else documents
    return spark.sql(TWEETS.replace("FROM documents", "FROM {documents}"), documents=documents)


def flagged_tweets(spark: SparkSession, sf: str, wide: bool = True) -> DataFrame:
    return flag_emoji(tweets(spark, sf, wide), aliases(spark))


def aliases(spark: SparkSession) -> EmojiAliases:
    return load_aliases(spark.sql(EMOJI_ALIAS))


def lexicons(spark: SparkSession) -> Lexicons:
    return Lexicons(
        vader=spark.sql(LEXICON),
        emoji=spark.sql(EMOJI_POLARITY),
        words=spark.sql(WORD_POLARITY),
        aliases=aliases(spark),
    )


TRACKED_SPARK = TRACKED.format(
    phrases="array(concat_ws(' ', slice(split(text, ' '), 1, 3)), concat_ws(' ', slice(split(text, ' '), 4, 3)))"
)


def tracked(spark: SparkSession, sf: str) -> DataFrame:
    return shaped(spark, sf, TRACKED_SPARK, "benchmark")


def pickups(spark: SparkSession, sf: str) -> DataFrame:
    return shaped(spark, sf, PICKUPS, "customer")


def executions(spark: SparkSession, sf: str) -> DataFrame:
    return shaped(spark, sf, EXECUTIONS, "orders")


def actions(spark: SparkSession, sf: str) -> DataFrame:
    return shaped(spark, sf, ACTIONS, "orders")


def aggs(spark: SparkSession, sf: str) -> DataFrame:
    flat = shaped(spark, sf, AGGS, "lineitem")
    return flat.withColumn("model", F.struct(F.col("model_id").alias("id"))).drop("model_id")


def api_responses(spark: SparkSession, sf: str) -> DataFrame:
    return shaped(spark, sf, API_RESPONSES, "labels").select(
        "tweet_id", *[F.col(c).cast("double").alias(c) for c in ("neg", "neutral", "pos")]
    )


def models(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows from suppliers; the kind rotates and every map holds text values."""
    key = F.col("s_suppkey")
    number = lambda base, step: (F.lit(base) + key % step).cast("string")
    kinds = ["nlp", "vader", "emoji", "boosting", "api", "bayes", "rr"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (key % 7 + 1).cast("int"))
    stored = F.create_map(
        F.lit("num_trees"), number(10, 9),
        F.lit("depth"), number(2, 5),
        F.lit("max_bins"), number(16, 17),
        F.lit("subset_strategy"), F.lit("auto"),
        F.lit("impurity"), F.lit("gini"),
        F.lit("seed"), number(1, 50),
        F.lit("nClassWords"), number(500, 100),
        F.lit("num_iterations"), number(3, 8),
        F.lit("strategy_boosting"), F.lit("Regression"),
        F.lit("type_model"), F.when(key % 2 == 0, "bernoulli").otherwise("multinomial"),
        F.lit("lambda"), F.when(key % 3 == 0, "0.5").otherwise("1.0"),
        F.lit("agg_function"), F.lit("meanagg"),
        F.lit("api_client"), F.lit("text_service"),
    )
    conf = F.struct(F.lit(0.6).alias("train"), F.lit(0.2).alias("validation"), F.lit(0.2).alias("classification"))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("m"), key.cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.when(key % 2 == 0, "vader").otherwise("emoji").alias("tag_tweets"),
        kind.alias("type_classifier"),
        stored.alias("parameters"),
        conf.alias("partitionConf"),
    )
