"""Scorer stages, one query per rule, and the scorers as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.functions import text as tx
from tonewise.operators import scoring as sc
from tonewise.workload import fixtures as fx
from tonewise.workload import query
from tonewise.workload.twin import blend, common, scorer

KEY = ["tweet_id"]
TWIN = common(scorer("tweets", "tweet_id", "tweetText", "lexicon"))
PUBLISHED = common(scorer("tweets", "tweet_id", "tweetText", "lexicon", stop=False, full_map=True))


def _trace(spark: SparkSession, sf: str, **flags: bool) -> DataFrame:
    rows = fx.tweets(spark, sf, wide=True)
    return sc.trace(rows, KEY, "tweetText", {"vader": spark.sql(fx.LEXICON)}, **flags).where("position >= 0")


def _step(spark: SparkSession, sf: str, *steps: tuple[str, str], **flags: bool) -> DataFrame:
    picked = [F.col(f"vader_{label}").alias(name) for label, name in steps]
    return _trace(spark, sf, **flags).select("tweet_id", "position", "token", *picked)


def _sql(twin: str, *columns: str) -> str:
    return f"{twin} SELECT id AS tweet_id, CAST(i AS INT) AS position, tok AS token, {', '.join(columns)} FROM trace"


@query("vader_v1", TWIN + "SELECT id AS tweet_id, CAST(i AS INT) AS position, piece AS token FROM raw")
def raw_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tx.raw_tokens(F.col("tweetText"))
    return fx.tweets(spark, sf, wide=True).select("tweet_id", F.posexplode(tokens).alias("position", "token"))


@query("vader_v2", TWIN + "SELECT id AS tweet_id, w AS word FROM known")
def punctuation_map(spark: SparkSession, sf: str) -> DataFrame:
    words = tx.words_before_repeat(tx.bare_words(F.col("tweetText")))
    return fx.tweets(spark, sf, wide=True).select("tweet_id", F.explode(words).alias("word"))


@query("vader_v3", TWIN + "SELECT id AS tweet_id, CAST(i AS INT) AS position, tok AS token FROM tok")
def mapped_tokens(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("tweetText")
    tokens = tx.strip_runs(body)
    return fx.tweets(spark, sf, wide=True).select("tweet_id", F.posexplode(tokens).alias("position", "token"))


@query(
    "vader_v4",
    TWIN + "SELECT id AS tweet_id, CAST(coalesce(stop, -1) AS INT) AS stop_position, "
    "CAST(CASE WHEN stop IS NULL THEN n ELSE stop + 1 END AS INT) AS scanned FROM per",
)
def stop_rule(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("tweetText")
    rows = fx.tweets(spark, sf, wide=True).select(
        "tweet_id", tx.strip_runs(body).alias("tokens")
    )
    rows = rows.select("tweet_id", "tokens", tx.lower_tokens(F.col("tokens")).alias("lowered"))
    rows = rows.select("tweet_id", "tokens", tx.first_stop("tokens", "lowered").alias("stop"))
    return rows.select(
        "tweet_id",
        (F.col("stop") - 1).alias("stop_position"),
        F.when(F.col("stop") > 0, F.col("stop")).otherwise(F.size("tokens")).alias("scanned"),
    )


@query("vader_v5", _sql(TWIN, "v5 AS valence"))
def lexicon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _step(spark, sf, ("lookup", "valence"))


@query("vader_v6", _sql(TWIN, "v5 AS valence", "v6_v AS boosted"))
def caps_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _step(spark, sf, ("lookup", "valence"), ("caps", "boosted"))


@query("vader_v7", _sql(PUBLISHED, "v6_v AS valence", "g1 AS near", "g2 AS middle", "g3 AS far"))
def degree_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Degree words only act when the scan goes on behind them."""
    return _step(
        spark, sf, ("caps", "valence"), ("degree1", "near"), ("degree2", "middle"), ("degree3", "far"),
        stop_at_booster=False, full_punct_map=True,
    )


@query("vader_v8", _sql(TWIN, "n1_v AS near", "n2_v AS middle", "n3_v AS far"))
def negation_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _step(spark, sf, ("negation1", "near"), ("negation2", "middle"), ("negation3", "far"))


@query("vader_v9", _sql(TWIN, "n3_v AS valence", "v9 AS phrased"))
def idiom_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _step(spark, sf, ("negation3", "valence"), ("idiom", "phrased"))


@query("vader_v10", _sql(TWIN, "v9 AS valence", "v10 AS flipped"))
def least_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _step(spark, sf, ("idiom", "valence"), ("least", "flipped"))


@query("vader_v11", _sql(TWIN, "v10 AS valence", "v11 AS weighed"))
def contrast_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _step(spark, sf, ("least", "valence"), ("but", "weighed"))


@query("vader_v12", TWIN + "SELECT id AS tweet_id, emphasis FROM emph")
def emphasis(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tweets(spark, sf).select(
        "tweet_id", tx.punctuation_emphasis(F.col("tweetText")).alias("emphasis")
    )


def _scores(spark: SparkSession, sf: str, **flags: bool) -> DataFrame:
    return sc.vader_scores(fx.tweets(spark, sf, wide=True), KEY, "tweetText", spark.sql(fx.LEXICON), **flags)


@query("vader_v13", TWIN + "SELECT id AS tweet_id, compound FROM scores")
def compound(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("tweet_id", "compound")


@query("vader_v14", TWIN + "SELECT id AS tweet_id, neg, neu, pos FROM scores")
def shares(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("tweet_id", "neg", "neu", "pos")


@query(
    "vader_v15",
    "SELECT o_orderkey, floor((o_totalprice - 250000) / 8 * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS three_places, "
    "floor((o_totalprice - 250000) / 8 * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS four_places FROM orders",
)
def rounding(spark: SparkSession, sf: str) -> DataFrame:
    """Half-up rounding on signed amounts; an eighth of a cent gives exact ties."""
    amount = (F.col("o_totalprice") - 250000) / 8
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        tx.round_half_up(amount, 3).alias("three_places"),
        tx.round_half_up(amount, 4).alias("four_places"),
    )


SPARSE = """SELECT tweet_id, CASE WHEN tweet_id % 4 = 0 THEN ''
  WHEN tweet_id % 4 = 1 THEN regexp_replace(tweetText, '[^ ]{2,}', 'a', 'g') ELSE tweetText END AS tweetText FROM tweets"""


@query(
    "vader_v16",
    common(f"sparse AS ({SPARSE})", scorer("sparse", "tweet_id", "tweetText", "lexicon"))
    + "SELECT id AS tweet_id, neg, neu, pos, compound FROM scores",
)
def empty_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are empty, or hold nothing but one-character tokens, score zero throughout."""
    part = F.col("tweet_id") % 4
    sparse = F.when(part == 0, "").when(
        part == 1, F.regexp_replace("tweetText", "[^ ]{2,}", "a")
    ).otherwise(F.col("tweetText"))
    rows = fx.tweets(spark, sf, wide=True).withColumn("tweetText", sparse)
    return sc.vader_scores(rows, KEY, "tweetText", spark.sql(fx.LEXICON))


def _blend(spark: SparkSession, sf: str) -> DataFrame:
    words = fx.lexicons(spark)
    return sc.emoji_word_scores(fx.tweets(spark, sf, wide=True), KEY, "tweetText", words.emoji, words.words)


@query("vader_v17", common(blend()) + "SELECT id AS tweet_id, neg, neu, pos, compound FROM bl_scores")
def emoji_blend(spark: SparkSession, sf: str) -> DataFrame:
    return _blend(spark, sf)


@query(
    "emoji_word_scores",
    common(blend())
    + "SELECT e.id AS tweet_id, e.compound AS emoji, w.compound AS word, b.compound AS blended FROM bl_e_scores e "
    "JOIN bl_w_scores w ON e.id = w.id JOIN bl_scores b ON e.id = b.id",
)
def emoji_word_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Both lexicons scored in one pass, with the blend of the two."""
    tables = fx.lexicons(spark)
    scored = sc.score_texts(
        fx.tweets(spark, sf, wide=True), KEY, "tweetText", {"emoji": tables.emoji, "word": tables.words}
    )
    emoji, word = F.col("emoji.compound"), F.col("word.compound")
    return scored.select(
        "tweet_id", emoji.alias("emoji"), word.alias("word"), ((emoji * 2 + word) / 3).alias("blended")
    )


@query("vader_scores", TWIN + "SELECT id AS tweet_id, neg, neu, pos, compound FROM scores")
def vader_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


@query("vader_scores_published", PUBLISHED + "SELECT id AS tweet_id, neg, neu, pos, compound FROM scores")
def vader_scores_published(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, stop_at_booster=False, full_punct_map=True)


@query(
    "conversation_scores",
    common(
        "turns AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)",
        scorer("turns", "turn_id", "text", "lexicon"),
    )
    + "SELECT conv_id, turn, neg, neu, pos, compound FROM scores JOIN conversations ON id = conv_id * 1000 + turn",
)
def conversation_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The same scorer on another text table, keyed by two columns; line breaks stay in tokens."""
    return sc.vader_scores(fx.table(spark, sf, "conversations"), ["conv_id", "turn"], "text", spark.sql(fx.LEXICON))
