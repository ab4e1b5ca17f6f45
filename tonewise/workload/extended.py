"""Languages, order statistics, metrics, query and stored documents, intervals and laid-out tables over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.functions import labels
from tonewise.operators import language as lg
from tonewise.operators import metrics as mt
from tonewise.operators import order as od
from tonewise.operators import querydocs as qd
from tonewise.operators import splits as sp
from tonewise.schemas import MESSAGE
from tonewise.session import scratch_dir, spread
from tonewise.sources import documents as dc
from tonewise.sources import layout as ly
from tonewise.sources.tables import read_table
from tonewise.streaming import intervals as iv
from tonewise.streaming import live
from tonewise.workload import fixtures as fx
from tonewise.workload import query
from tonewise.workload.twin import bucket, common

LANGUAGES = ("de", "en", "es", "fr")


def _logged(count: str, total: str) -> str:
    return f"CAST(floor(ln((({count}) + 1) / CAST({total} + kinds AS DOUBLE)) * {lg.SCALE} + 0.5::DOUBLE) AS BIGINT)"


def _language_sql() -> str:
    """Trigrams of all texts, weights learnt from the rows kept for it, and the best language of each text."""
    counts = ", ".join(f"count(*) FILTER (learnt AND lang = '{c}') AS c_{c}" for c in LANGUAGES)
    sums = ", ".join(f"sum(c_{c}) AS t_{c}" for c in LANGUAGES)
    known = " + ".join(f"c_{c}" for c in LANGUAGES)
    weights = ", ".join(f"CASE WHEN {known} > 0 THEN {_logged(f'c_{c}', f't_{c}')} ELSE {_logged('0', f't_{c}')} END AS w_{c}" for c in LANGUAGES)
    scores = ", ".join(f"sum(w_{c}) AS s_{c}" for c in LANGUAGES)
    best = "CASE " + " ".join(f"WHEN s_{c} = greatest({', '.join(f's_{x}' for x in LANGUAGES)}) THEN '{c}'" for c in LANGUAGES) + " END"
    return f"""WITH cut AS (SELECT doc_id, lang, {bucket('doc_id')} < 0.8 AS learnt,
      concat(' ', unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')), ' ') AS word FROM documents),
    grams AS (SELECT doc_id, lang, learnt, substr(word, i, 3) AS gram FROM
      (SELECT doc_id, lang, learnt, word, unnest(generate_series(1, length(word) - 2)) AS i FROM cut WHERE word <> '  ')),
    profile AS (SELECT gram, {counts} FROM grams GROUP BY gram),
    totals AS (SELECT count(*) AS kinds, {sums} FROM profile WHERE {known} > 0),
    weights AS (SELECT gram, {weights} FROM profile, totals),
    scores AS (SELECT doc_id, {scores} FROM grams JOIN weights USING (gram) GROUP BY doc_id),
    identified AS (SELECT doc_id, {best} AS identified FROM scores) """


def _profiles(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Profiles learnt from four in five of the rows, written once."""
    profiles, path = lg.language_profiles(documents.where(sp.bucket("doc_id", 42) < 0.8), LANGUAGES, "text", "lang"), scratch_dir(spark, "profiles")
    profiles.write.parquet(path)
    return read_table(spark, path, schema=profiles.schema)


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    documents = spread(fx.table(spark, sf, "documents"), "doc_id")
    return lg.identify(documents, _profiles(spark, documents), LANGUAGES, "doc_id", "text")


@query("identify_language", _language_sql() + "SELECT doc_id, identified FROM identified")
def identify_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every text that has letters, by profiles learnt from four in five of the rows."""
    return _identified(spark, sf)


@query(
    "identified_filter",
    _language_sql() + "SELECT d.doc_id, d.source, i.identified AS lang FROM documents d JOIN identified i USING (doc_id) WHERE identified IN ('es', 'en', 'fr')",
)
def identified_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the followed languages, by what their text says and not by what was declared."""
    documents = spread(fx.table(spark, sf, "documents"), "doc_id")
    kept = lg.keep_languages(documents, _profiles(spark, documents), LANGUAGES, ["es", "en", "fr"], "doc_id", "text", "lang")
    return kept.select("doc_id", "source", "lang")


@query(
    "language_accuracy",
    _language_sql()
    + f"""SELECT lang, CAST(count(*) AS BIGINT) AS texts, count(*) FILTER (identified = lang) AS hits FROM documents JOIN identified USING (doc_id)
      WHERE {bucket('doc_id')} >= 0.8 GROUP BY lang""",
)
def language_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Declared languages of the texts that the profiles have not seen, and how many are identified so."""
    found = _identified(spark, sf)
    held = fx.table(spark, sf, "documents").where(sp.bucket("doc_id", 42) >= 0.8).select("doc_id", "lang")
    return held.join(found, "doc_id").groupBy("lang").agg(F.count("*").alias("texts"), F.count_if(F.col("identified") == F.col("lang")).alias("hits"))


ITEM = "l_orderkey, l_linenumber, l_extendedprice"


@query(
    "deep_page",
    f"SELECT {ITEM} FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 200 "
    "OFFSET (SELECT 200 * CAST(floor(count(*) * 0.75::DOUBLE / 200) AS BIGINT) FROM lineitem)",
)
def deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of 200 rows three quarters down the table."""
    items = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    page = int(items.count() * 0.75 / 200)
    return od.deep_page(items, page, 200, [("l_extendedprice", False), ("l_orderkey", True), ("l_linenumber", True)])


def _exact_sql(source: str, key: str) -> str:
    h = f"CAST(('0x' || substr(md5(concat({key}, ':42')), 1, 8)) AS BIGINT)"
    size = lambda w: f"CAST(floor(n * {w}::DOUBLE) AS BIGINT)"
    return f"""SELECT {key}, CASE WHEN r <= {size(0.6)} THEN 'train' WHEN r <= {size(0.6)} + {size(0.2)} THEN 'validation'
      WHEN r <= {size(0.6)} + 2 * {size(0.2)} THEN 'classify' END AS split
      FROM (SELECT {key}, row_number() OVER (ORDER BY {h}, {key}) AS r, count(*) OVER () AS n FROM {source})"""


@query("split_exact", _exact_sql("documents", "doc_id"))
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of exactly the three sizes; the one or two rows left over belong to none."""
    documents = fx.table(spark, sf, "documents").select("doc_id")
    return od.split_exact(documents, sp.Weights(0.6, 0.2, 0.2), "doc_id")


@query("split_exact_orders", _exact_sql("orders", "o_orderkey"))
def split_exact_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders").select("o_orderkey")
    return od.split_exact(orders, sp.Weights(0.6, 0.2, 0.2), "o_orderkey")


JUDGED = f"""WITH api AS ({fx.API_RESPONSES}),
  judged AS (SELECT l.quality AS label, CASE WHEN CAST(neg AS DOUBLE) > CAST(pos AS DOUBLE) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS prediction,
  round(CAST(pos AS DOUBLE) - CAST(neg AS DOUBLE), 4) AS score FROM api a JOIN labels l ON a.tweet_id = l.doc_id)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """The outside service's class and score next to the quality label."""
    truth = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("tweet_id"), F.col("quality").alias("label"))
    neg, pos = F.col("neg"), F.col("pos")
    return fx.api_responses(spark, sf).join(truth, "tweet_id").select("label", labels.api_class(neg, pos).alias("prediction"), F.round(pos - neg, 4).alias("score"))


_PER_CLASS = """, sides AS (SELECT CAST(label AS DOUBLE) AS class, count(*) AS support, 0 AS predicted, count(*) FILTER (label = prediction) AS hits FROM judged GROUP BY 1
  UNION ALL SELECT prediction, 0, count(*), 0 FROM judged GROUP BY 1),
  sums AS (SELECT class, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(hits) AS BIGINT) AS hits FROM sides GROUP BY class)"""


@query(
    "class_metrics",
    JUDGED + _PER_CLASS
    + """ SELECT class, support, predicted, hits, round(hits / nullif(predicted, 0), 9) AS precision, round(hits / nullif(support, 0), 9) AS recall,
    CASE WHEN support > 0 AND predicted > 0 THEN round(2 * hits / (support + predicted), 9) END AS f1 FROM sums""",
)
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    rows = _judged(spark, sf).withColumn("label", F.col("label").cast("double"))
    found = mt.class_metrics(mt.confusion_matrix(rows))
    return found.select("class", "support", "predicted", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "score_auc",
    JUDGED
    + """ SELECT CAST((SELECT count(*) FROM judged WHERE label = 1) AS BIGINT) AS p, CAST((SELECT count(*) FROM judged WHERE label = 0) AS BIGINT) AS n,
    round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 9) AS auc
    FROM judged a, judged b WHERE a.label = 1 AND b.label = 0""",
)
def score_auc(spark: SparkSession, sf: str) -> DataFrame:
    """How often a good text has a higher score than a bad one; the twin compares all pairs."""
    found = mt.area_under_curve(mt.score_histogram(_judged(spark, sf)))
    return found.select("p", "n", F.round("auc", 9).alias("auc"))


PICKUP_QUERY = {
    "$or": [{"state": {"$in": ["ready", "created"]}, "balance": {"$gt": 0, "$lte": 5000.0}}, {"isRT": True, "keyword": {"$ne": "BUILDING"}}],
    "cuantity_warn": {"$not": {"$lt": 50}},
    "$nor": [{"state": "finished", "cuantity_warn": {"$gte": 300}}],
}


@query(
    "query_document",
    common()
    + """SELECT id, keyword, cuantity_warn, state, isRT, balance FROM pickups WHERE ((state IN ('ready', 'created') AND balance > 0 AND balance <= 5000)
    OR (isRT AND keyword <> 'BUILDING')) AND cuantity_warn >= 50 AND NOT (state = 'finished' AND cuantity_warn >= 300)""",
)
def query_document(spark: SparkSession, sf: str) -> DataFrame:
    return qd.find(fx.pickups(spark, sf), PICKUP_QUERY)


@query(
    "query_document_first",
    common() + "SELECT id, keyword, cuantity_warn, state, isRT, balance FROM pickups WHERE state = 'ready' AND NOT isRT ORDER BY balance DESC, id LIMIT 5",
)
def query_document_first(spark: SparkSession, sf: str) -> DataFrame:
    return qd.find(fx.pickups(spark, sf), {"state": "ready", "isRT": False}, [("balance", -1), ("id", 1)], 5)


# One line a document, in the shapes that stores hold them; the same expression on both sides.
STORED = """SELECT CASE doc_id % 9
  WHEN 0 THEN concat('{"_id":{"$oid":"o', doc_id, '"},"tweet_id":', doc_id, ',"createdAt":17, "user_id":', doc_id, ',"user_followers":12,"tweetText":"short ', doc_id, '","contain_emoji":true,"topic":{"$oid":"t1"},"location":{"latitude":12.5,"longitude":-7.25}}')
  WHEN 1 THEN concat('{"_id":"plain', doc_id, '","tweet_id":{"$numberLong":"', doc_id, '"},"user_id":', doc_id + 9000000000, ',"user_followers":"many","tweetText":"wide","contain_emoji":"false","topic":"t2","geoLocation":{"type":"Point","coordinates":[100.5,50]}}')
  WHEN 2 THEN concat('{"tweet_id":"', doc_id, '","user_id":"77","user_followers":3000000000,"tweetText":"half","location":{"latitude":1}}')
  WHEN 3 THEN concat('{"tweet_id":', doc_id, '.0,"user_id":true,"tweetText":"flags","contain_emoji":1,"latitude":{"latitude":91,"longitude":0},"location":{"latitude":3,"longitude":4}}')
  WHEN 4 THEN concat('{"tweet_id":', doc_id, '.5,"tweetText":"fraction"}')
  WHEN 5 THEN concat('{"tweet_id":', doc_id, ',"tweetText":', doc_id, '}')
  WHEN 6 THEN '{not json' WHEN 7 THEN concat('[', doc_id, ']') END AS value, doc_id FROM documents"""


def _stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    statement = STORED.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}")
    return spark.sql(statement, documents=fx.table(spark, sf, "documents"))


def _json(path: str, name: str = "value") -> str:
    return f"json_extract_string({name}, '{path}')"


def _whole(path: str) -> str:
    """Numbers, texts of digits and wrapped longs; flags are none."""
    text = f"coalesce({_json(path + '.\"$numberLong\"')}, {_json(path + '.\"$numberInt\"')}, {_json(path)})"
    return f"""CASE WHEN json_type(value, '{path}') = 'BOOLEAN' THEN NULL WHEN json_type(value, '{path}') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN
      CASE WHEN TRY_CAST({text} AS DOUBLE) = floor(TRY_CAST({text} AS DOUBLE)) THEN CAST(TRY_CAST({text} AS DECIMAL(38, 9)) AS BIGINT) END
      WHEN regexp_full_match({text}, '[+-]?[0-9]{{1,19}}') THEN TRY_CAST({text} AS BIGINT) END"""


def _words(path: str) -> str:
    return f"CASE WHEN json_type(value, '{path}') = 'VARCHAR' THEN {_json(path)} END"


def _place(axis: int) -> str:
    tries = []
    for path in ("$.latitude", "$.location", "$.geoLocation"):
        for up, across in ((f"{path}.latitude", f"{path}.longitude"), (f"{path}.coordinates[1]", f"{path}.coordinates[0]")):
            lat, lon = f"TRY_CAST({_json(up)} AS DOUBLE)", f"TRY_CAST({_json(across)} AS DOUBLE)"
            tries.append(f"CASE WHEN {lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180 THEN {(lat, lon)[axis]} END")
    return f"coalesce({', '.join(tries)})"


_VALID = f"stored AS (SELECT value FROM ({STORED})), parsed AS (SELECT value FROM stored WHERE json_valid(value) AND json_type(value) = 'OBJECT')"


@query(
    "stored_documents",
    f"""WITH {_VALID} SELECT * FROM (SELECT coalesce({_json('$._id."$oid"')}, {_words('$._id')}) AS _id, {_whole('$.tweet_id')} AS tweet_id, {_place(0)} AS latitude,
    {_place(1)} AS longitude, {_whole('$.user_id')} AS user_id, TRY_CAST({_whole('$.user_followers')} AS INTEGER) AS user_followers, {_words('$.tweetText')} AS "tweetText",
    CASE WHEN {_json('$.contain_emoji')} IN ('true', '1') THEN true WHEN {_json('$.contain_emoji')} IN ('false', '0') THEN false END AS contain_emoji,
    coalesce({_json('$.topic."$oid"')}, {_words('$.topic')}) AS topic FROM parsed) WHERE tweet_id IS NOT NULL AND "tweetText" IS NOT NULL""",
)
def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of many shapes as rows; the twin reads the same lines with JSON functions."""
    rows = dc.tweets_of(_stored_lines(spark, sf))
    return rows.select("_id", "tweet_id", "latitude.latitude", "latitude.longitude", "user_id", "user_followers", "tweetText", "contain_emoji", "topic")


@query(
    "stored_rejected",
    f"""WITH {_VALID}, sound AS (SELECT CASE WHEN json_valid(value) THEN value END AS value FROM stored),
    reasons AS (SELECT CASE WHEN NOT coalesce(json_type(value) = 'OBJECT', false) THEN 'no document'
    WHEN {_whole('$.tweet_id')} IS NULL THEN 'no id' WHEN {_words('$.tweetText')} IS NULL THEN 'no text' END AS reason FROM sound)
    SELECT reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY reason""",
)
def stored_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Why lines give no row."""
    return dc.rejected(_stored_lines(spark, sf))


# A topic is followed for six hours from each of its purchases of more than 60.
SPANS = "SELECT CAST(user_id AS STRING) AS topic, ts AS opens, ts + INTERVAL '6 hours' AS closes FROM events WHERE event_type = 'purchase' AND value > 60"


@query(
    "stream_followed",
    f"WITH spans AS ({SPANS}) SELECT CAST(e.user_id AS STRING) AS key, CAST(e.event_id AS STRING) AS value FROM events e "
    "WHERE EXISTS (SELECT 1 FROM spans s WHERE s.topic = CAST(e.user_id AS STRING) AND e.ts >= s.opens AND e.ts < s.closes)",
)
def stream_followed(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages, passed while their user's interval is open; both sides are streams."""
    events = fx.table(spark, sf, "events")
    path, spans, messages = (scratch_dir(spark, label) for label in ("followed", "spans", "messages"))
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    opened = stamped.where("event_type = 'purchase' AND value > 60").select(F.col("user_id").cast("string").alias("topic"), F.col("ts").alias("opens"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("closes"))
    iv.distinct_intervals(opened).select("topic", "opens", "closes").write.parquet(spans)
    stamped.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").alias("timestamp")).write.parquet(messages)
    run = iv.stream_followed(
        live.open_stream(spark, "parquet", messages, MESSAGE), live.open_stream(spark, "parquet", spans, iv.INTERVAL), path, scratch_dir(spark, "mark"), once=True, longest="40 days"
    )
    run.awaitTermination()
    return read_table(spark, path).select("key", "value")


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"


ITEMS = "SELECT o_orderkey AS tweet_id, concat('src', CAST(o_custkey % 20 AS STRING)) AS topic, CAST(o_custkey % 11 AS DOUBLE) / 10 AS result FROM orders"


@query(
    "tally_stored_topics",
    f"WITH items AS ({ITEMS}) SELECT topic, count(*) FILTER (result > 0.6) AS positive, count(*) FILTER (result < 0.4) AS negative, "
    "count(*) FILTER (result BETWEEN 0.4 AND 0.6) AS neutral FROM items GROUP BY topic",
)
def tally_stored_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Results joined with their tweets where both lie in the same buckets."""
    items, tweets, results = fx.shaped(spark, sf, ITEMS, "orders"), _name("tweets"), _name("results")
    ly.write_by_topic(items.select("tweet_id", "topic"), tweets)
    ly.write_results_by_tweet(items.select("tweet_id", "result"), results)
    return ly.tally_by_topic(spark, tweets, results, "nlp")


@query(
    "rows_of_topics",
    f"WITH items AS ({ITEMS}) SELECT tweet_id, topic FROM items WHERE topic IN (SELECT concat('src', n_nationkey) FROM nation WHERE n_regionkey = 2)",
)
def rows_of_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of topics that another table names."""
    table = _name("tweets")
    ly.write_by_topic(fx.shaped(spark, sf, ITEMS, "orders").select("tweet_id", "topic"), table)
    named = fx.table(spark, sf, "nation").where("n_regionkey = 2").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("id"))
    return ly.rows_of_topics(spark, table, named).select("tweet_id", "topic")
