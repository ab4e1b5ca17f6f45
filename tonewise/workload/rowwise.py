"""Scans, sinks, projections, filters, lookups and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.operators import rows as rw
from tonewise.session import scratch_dir
from tonewise.sources import sinks
from tonewise.sources import tables as src
from tonewise.workload import fixtures as fx
from tonewise.workload import query
from tonewise.workload.twin import common

COLUMNS = "tweet_id, createdAt, user_id, user_name, user_followers, tweetText, lenguage, topic"


@query("scan_topic", common() + f"SELECT {COLUMNS} FROM tweets WHERE topic = 'src3'")
def scan_topic(spark: SparkSession, sf: str) -> DataFrame:
    return src.scan_topic(fx.tweets(spark, sf), "src3")


def _object_id(column: str) -> F.Column:
    return F.struct(F.lpad(F.hex(F.col(column)), 24, "0").alias("$oid"))


@query(
    "coerce_tweet",
    common()
    + """SELECT lpad(upper(printf('%x', tweet_id)), 24, '0') AS _id, tweet_id, createdAt,
      CASE WHEN tweet_id % 2 = 0 THEN user_id ELSE user_id + 9000000000 END AS user_id, user_name,
      CASE WHEN tweet_id % 10 = 3 THEN NULL ELSE user_followers END AS user_followers, tweetText, lenguage,
      contain_emoji, topic FROM tweets WHERE tweet_id % 11 <> 4""",
)
def coerce_tweet(spark: SparkSession, sf: str) -> DataFrame:
    """Stored JSON documents with int and long user ids, unreadable counts and broken lines."""
    rows = fx.flagged_tweets(spark, sf)
    wide_id = F.when(F.col("tweet_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 9_000_000_000)
    followers = F.when(F.col("tweet_id") % 10 == 3, "many").otherwise(F.col("user_followers").cast("string"))
    document = F.to_json(
        F.struct(
            _object_id("tweet_id").alias("_id"), "tweet_id", "createdAt", wide_id.alias("user_id"), "user_name",
            followers.alias("user_followers"), "tweetText", "lenguage", "contain_emoji",
            F.struct(F.col("topic").alias("$oid")).alias("topic"),
        )
    )
    broken = F.when(F.col("tweet_id") % 11 == 4, F.lit("{not json")).otherwise(document)
    return src.coerce_tweets(rows.select(broken.alias("value"))).drop("latitude")


LINES = """lines AS (SELECT lower(unnest(string_split(tweetText, ' '))) AS token, (tweet_id % 81 - 40) / 10.0 AS valence,
  tweet_id * 100000 + generate_subscripts(string_split(tweetText, ' '), 1) AS place FROM tweets)"""


@query(
    "load_lexicon",
    common(LINES)
    + "SELECT token, CAST(arg_max(valence, place) AS DOUBLE) AS valence FROM (SELECT token, place, valence FROM lines "
    "WHERE token <> '') GROUP BY token",
)
def load_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon file of all words, with most words repeated; the last line of a word wins."""
    # Texts in ranges of their ids, so the files and the lines of each stand in the order of the words.
    cores = spark.sparkContext.defaultParallelism
    rows = fx.tweets(spark, sf).select("tweet_id", "tweetText").repartitionByRange(cores, "tweet_id").sortWithinPartitions("tweet_id")
    valence = ((F.col("tweet_id") % 81 - 40) / 10).cast("string")
    words = rows.select(valence.alias("valence"), F.explode(F.split("tweetText", " ")).alias("word")).where("word <> ''")
    lines = words.select(F.concat(F.lit(" "), F.lower("word"), F.lit("\t"), "valence", F.lit("\tignored ")).alias("line"))
    path = scratch_dir(spark, "lexicon")
    lines.write.text(path)
    return src.load_lexicon(spark, path)


@query(
    "load_polarity_lists",
    common(LINES)
    + """SELECT token, CASE WHEN bool_or(valence < 0) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS valence FROM lines
    WHERE token <> '' GROUP BY token""",
)
def load_polarity_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Two word lists that overlap: words of texts with a positive and with a negative number."""
    rows = fx.tweets(spark, sf, wide=True).select(
        (F.col("tweet_id") % 81 - 40).alias("n"), F.explode(F.split(F.lower("tweetText"), " ")).alias("line")
    )
    positive, negative = scratch_dir(spark, "positive"), scratch_dir(spark, "negative")
    rows.where("n >= 0").select("line").write.text(positive)
    rows.where("n < 0").select("line").write.text(negative)
    return src.load_polarity_lists(spark, positive, negative)


@query("append_tweets", common() + f"SELECT {COLUMNS}, contain_emoji FROM tweets")
def append_tweets(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends, then the table as read back."""
    path = scratch_dir(spark, "tweets")
    rows = fx.flagged_tweets(spark, sf)
    sinks.append_tweets(rows.where("contain_emoji"), path)
    sinks.append_tweets(rows.where("NOT contain_emoji"), path)
    return src.read_table(spark, path)


@query(
    "flatten_status",
    common()
    + """SELECT tweet_id, createdAt, CASE WHEN tweet_id % 4 = 0 THEN tweet_id / 100.0::DOUBLE END AS latitude,
      CASE WHEN tweet_id % 4 = 0 THEN tweet_id / 50.0::DOUBLE END AS longitude, user_id, user_name, user_followers, tweetText,
      lenguage, contain_emoji FROM tweets WHERE tweet_id % 13 <> 5""",
)
def flatten_status(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses with, without and with half a location, and some broken lines."""
    flat = rw.flatten_statuses(statuses(spark, sf), fx.aliases(spark), language="lang")
    return flat.select(
        "tweet_id", "createdAt", "latitude.latitude", "latitude.longitude", "user_id", "user_name", "user_followers",
        "tweetText", "lenguage", "contain_emoji",
    )


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    """(value, lang): the tweets as nested JSON lines."""
    key = F.col("tweet_id")
    geo = F.when(
        key % 4 == 0, F.struct((key / 100).alias("latitude"), (key / 50).alias("longitude"))
    ).when(key % 4 == 1, F.struct((key / 100).alias("latitude"), F.lit(None).cast("double").alias("longitude")))
    user = F.struct(
        F.col("user_id").alias("id"), F.col("user_name").alias("name"), F.col("user_followers").alias("followersCount")
    )
    status = F.to_json(
        F.struct(key.alias("id"), "createdAt", geo.alias("geoLocation"), user.alias("user"), F.col("tweetText").alias("text"))
    )
    value = F.when(key % 13 == 5, F.concat(F.lit("<"), status)).otherwise(status)
    return fx.tweets(spark, sf, wide=True).select(value.alias("value"), F.col("lenguage").alias("lang"))


@query("flag_emoji", common() + "SELECT tweet_id, contain_emoji FROM tweets")
def flag_emoji(spark: SparkSession, sf: str) -> DataFrame:
    return fx.flagged_tweets(spark, sf).select("tweet_id", "contain_emoji")


@query("filter_emoji", common() + "SELECT tweet_id, topic, tweetText FROM tweets WHERE contain_emoji")
def filter_emoji(spark: SparkSession, sf: str) -> DataFrame:
    return rw.filter_emoji(fx.flagged_tweets(spark, sf)).select("tweet_id", "topic", "tweetText")


TRACKED_SQL = fx.TRACKED.format(
    phrases="[array_to_string(string_split(text, ' ')[1:3], ' '), array_to_string(string_split(text, ' ')[4:6], ' ')]"
)
TRACK_PARTS = (
    f"tracked AS ({TRACKED_SQL})",
    """phrase AS (SELECT id, unnest(topics) AS p, generate_subscripts(topics, 1) AS rank FROM tracked)""",
    r"""need AS (SELECT DISTINCT id, rank, unnest(string_split_regex(lower(p), '[^\p{L}\p{N}#@_]+')) AS w FROM phrase)""",
    """needed AS (SELECT id, rank, count(*) AS n FROM need WHERE w <> '' GROUP BY id, rank)""",
    r"""said AS (SELECT DISTINCT tweet_id, unnest(string_split_regex(lower(tweetText), '[^\p{L}\p{N}#@_]+')) AS w FROM tweets)""",
    """met AS (SELECT s.tweet_id, n.id, n.rank, count(*) AS n FROM said s JOIN need n ON s.w = n.w AND n.w <> '' GROUP BY ALL)""",
    """tracks AS (SELECT DISTINCT m.tweet_id, m.id AS topic FROM met m JOIN needed d ON m.id = d.id AND m.rank = d.rank AND m.n = d.n)""",
)


@query("track_topics", common(*TRACK_PARTS) + "SELECT tweet_id, topic FROM tracks")
def track_topics(spark: SparkSession, sf: str) -> DataFrame:
    return rw.track_topics(fx.tweets(spark, sf, wide=True), fx.tracked(spark, sf)).select("tweet_id", "topic")


@query(
    "language_fanout",
    common() + "SELECT tweet_id, tweetText, l.code AS lenguage FROM tweets, (VALUES ('es'), ('en'), ('fr')) AS l(code)",
)
def language_fanout(spark: SparkSession, sf: str) -> DataFrame:
    rows = rw.language_fanout(fx.tweets(spark, sf), ["es", "en", "fr"], fanout=True)
    return rows.select("tweet_id", "tweetText", "lenguage")


@query("language_filter", common() + "SELECT tweet_id, lenguage FROM tweets WHERE lenguage IN ('es', 'en', 'fr')")
def language_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rw.language_fanout(fx.tweets(spark, sf), ["es", "en", "fr"]).select("tweet_id", "lenguage")


PICKUP_COLUMNS = "id, keyword, cuantity_warn, state, isRT, balance"


@query("lookup_by_id", common() + f"SELECT {PICKUP_COLUMNS} FROM pickups WHERE id = 't42'")
def lookup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return rw.lookup_by_id(fx.pickups(spark, sf), "t42")


@query("list_all", common() + f"SELECT {PICKUP_COLUMNS} FROM pickups")
def list_all(spark: SparkSession, sf: str) -> DataFrame:
    return rw.list_all(fx.pickups(spark, sf))


@query("find_where", common() + f"SELECT {PICKUP_COLUMNS} FROM pickups WHERE state = 'ready' AND cuantity_warn > 100")
def find_where(spark: SparkSession, sf: str) -> DataFrame:
    return rw.find_where(fx.pickups(spark, sf), "state = 'ready' AND cuantity_warn > 100")


@query("find_first", common() + f"SELECT {PICKUP_COLUMNS} FROM pickups WHERE state = 'ready' ORDER BY balance, id LIMIT 1")
def find_first(spark: SparkSession, sf: str) -> DataFrame:
    return rw.find_where(fx.pickups(spark, sf), "state = 'ready'", first_by=["balance", "id"])


@query("realtime_topics", common() + "SELECT id FROM pickups WHERE isRT")
def realtime_topics(spark: SparkSession, sf: str) -> DataFrame:
    return rw.realtime_topics(fx.pickups(spark, sf))


@query("latest_row", common() + f"SELECT {COLUMNS} FROM tweets ORDER BY createdAt DESC, tweet_id DESC LIMIT 1")
def latest_row(spark: SparkSession, sf: str) -> DataFrame:
    return rw.latest_row(fx.tweets(spark, sf), "createdAt", "tweet_id")


@query(
    "latest_by",
    "SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type "
    "ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def latest_by(spark: SparkSession, sf: str) -> DataFrame:
    newest = rw.latest_by(fx.table(spark, sf, "events"), ["event_type"], "ts", "event_id")
    return newest.select("event_type", "event_id", "user_id", "value")


@query("page_rows", common() + f"SELECT {PICKUP_COLUMNS} FROM pickups ORDER BY balance DESC, id LIMIT 25 OFFSET 75")
def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rw.page_rows(fx.pickups(spark, sf), 3, 25, "balance", "id", ascending=False)


# New pickup states, one per supplier: two in three ids exist, the others are unknown.
UPDATES = """SELECT concat(CASE WHEN s_suppkey % 3 = 2 THEN 'x' ELSE 't' END, CAST(s_suppkey * 3 AS STRING)) AS id,
  'updated' AS keyword, CAST(s_suppkey AS BIGINT) AS cuantity_warn, 'stopped' AS state, s_suppkey % 2 = 0 AS isRT,
  s_acctbal AS balance FROM supplier"""


@query(
    "upsert_rows",
    common(f"updates AS ({UPDATES})")
    + f"""SELECT {PICKUP_COLUMNS} FROM pickups p WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.id = p.id)
    UNION ALL SELECT {PICKUP_COLUMNS} FROM updates u WHERE EXISTS (SELECT 1 FROM pickups p WHERE u.id = p.id)""",
)
def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rw.upsert_rows(fx.pickups(spark, sf), fx.shaped(spark, sf, UPDATES, "supplier"))


@query(
    "unknown_updates",
    common(f"updates AS ({UPDATES})")
    + f"SELECT {PICKUP_COLUMNS} FROM updates u WHERE NOT EXISTS (SELECT 1 FROM pickups p WHERE u.id = p.id)",
)
def unknown_updates(spark: SparkSession, sf: str) -> DataFrame:
    return rw.unknown_updates(fx.pickups(spark, sf), fx.shaped(spark, sf, UPDATES, "supplier"))


@query(
    "delete_rows",
    common(f"updates AS ({UPDATES})") + f"SELECT {PICKUP_COLUMNS} FROM pickups WHERE id NOT IN (SELECT id FROM updates)",
)
def delete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rw.delete_rows(fx.pickups(spark, sf), fx.shaped(spark, sf, UPDATES, "supplier"))


@query(
    "tally_for_model",
    common()
    + "SELECT id, topic_id, positive, negative, neutral FROM aggs WHERE topic_id = 'src7' AND model_id = 'm7' ORDER BY id LIMIT 1",
)
def tally_for_model(spark: SparkSession, sf: str) -> DataFrame:
    return rw.tally_for_model(fx.aggs(spark, sf), "src7", "m7").drop("model")


@query(
    "pickup_state",
    common()
    + """SELECT id, state, state NOT IN ('finished', 'inprocess', 'ready') AS can_be_created, state = 'ready' AS can_be_collected,
      state = 'finished' AS can_be_finished FROM pickups""",
)
def pickup_state(spark: SparkSession, sf: str) -> DataFrame:
    states = rw.pickup_state(fx.pickups(spark, sf))
    return states.select("id", "state", "can_be_created", "can_be_collected", "can_be_finished")


@query("skip_bad_rows", common() + "SELECT tweet_id, tweetText FROM tweets WHERE tweet_id % 9 <> 2")
def skip_bad_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose text is missing are dropped."""
    text = F.when(F.col("tweet_id") % 9 != 2, F.col("tweetText"))
    return rw.skip_bad_rows(fx.tweets(spark, sf).select("tweet_id", text.alias("tweetText")))
