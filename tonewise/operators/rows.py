"""Projections, filters, lookups and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise import schemas
from tonewise.functions.emoji import EmojiAliases, has_emoji
from tonewise.functions.text import hashtags
from tonewise.operators.joins import lookup, measure

# A phrase matches whole tokens; letters, digits and the marks # @ _ belong to a token.
TOKEN_BREAK = r"[^\p{L}\p{N}#@_]+"


def flatten_statuses(lines: DataFrame, aliases: EmojiAliases, line: str = "value", language: str | None = None, topic: str | None = None) -> DataFrame:
    """Nested status JSON as flat tweet rows.

    A location needs both coordinates. A line that does not parse, or has no id or text, is left
    out. ``language`` and ``topic`` are columns of the input, or absent.
    """
    parsed = lines.select("*", F.from_json(F.col(line), schemas.STATUS).alias("s"))
    geo = F.col("s.geoLocation")
    located = F.when(
        geo["latitude"].isNotNull() & geo["longitude"].isNotNull(), geo
    )
    return parsed.select(
        F.lit(None).cast("string").alias("_id"),
        F.col("s.id").alias("tweet_id"),
        F.col("s.createdAt").alias("createdAt"),
        located.alias("latitude"),
        F.col("s.user.id").alias("user_id"),
        F.col("s.user.name").alias("user_name"),
        F.col("s.user.followersCount").alias("user_followers"),
        F.col("s.text").alias("tweetText"),
        (F.col(language) if language else F.lit(None).cast("string")).alias("lenguage"),
        has_emoji(F.col("s.text"), aliases).alias("contain_emoji"),
        (F.col(topic) if topic else F.lit(None).cast("string")).alias("topic"),
    ).where(F.col("tweet_id").isNotNull() & F.col("tweetText").isNotNull())


def flag_emoji(df: DataFrame, aliases: EmojiAliases, text: str = "tweetText") -> DataFrame:
    return df.withColumn("contain_emoji", has_emoji(F.col(text), aliases))


def filter_emoji(df: DataFrame) -> DataFrame:
    return df.where("contain_emoji")


def topic_phrases(pickups: DataFrame) -> DataFrame:
    """One row per followed phrase: its words, an anchor word, and the topic's earlier phrases."""
    cleaned = F.transform(
        F.col("topics"),
        lambda p: F.array_distinct(
            F.filter(F.split(F.lower(p), TOKEN_BREAK), lambda w: w != "")
        ),
    )
    phrases = pickups.select(
        F.col("id").alias("topic"),
        F.filter(cleaned, lambda words: F.size(words) > 0).alias("phrases"),
    )
    return phrases.select("topic", "phrases", F.posexplode("phrases").alias("rank", "words")).select(
        "topic",
        "rank",
        "words",
        F.slice("phrases", 1, F.col("rank")).alias("earlier"),
        # The longest word of a phrase is the rarest as a rule, so it gives the fewest candidates.
        F.reduce(
            "words",
            F.lit(""),
            lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best),
        ).alias("anchor"),
    )


def track_topics(df: DataFrame, pickups: DataFrame, text: str = "tweetText") -> DataFrame:
    """Each row once per followed topic that has a phrase whose words all occur in the text.

    The row's distinct words are looked up as phrase anchors, the rest of the phrase is checked
    against the row's own words, and a topic is emitted for the first of its phrases that matches, so
    no grouping follows. The rule is one for any number of phrases: a list that fits a broadcast needs
    no shuffle, a longer one goes through the salted join, and both work on a stream.
    """
    phrases = measure(topic_phrases(pickups), "anchor")
    columns = [c for c in df.columns if c != "topic"]
    # The outer form, because for the plain one Catalyst adds a test for empty arrays and pushes it
    # to the scan, where the words would be made a second time; an empty row finds no anchor anyway.
    words = df.withColumn(
        "_words", F.array_distinct(F.split(F.lower(text), TOKEN_BREAK))
    ).withColumn("_word", F.explode_outer("_words"))
    candidates = lookup(words.drop("topic"), "_word", phrases, "inner")

    def all_in(phrase: Column) -> Column:
        return F.forall(phrase, lambda w: F.array_contains(F.col("_words"), w))

    # Most candidates fail on a first word; this test stays in the generated stage of the join, so
    # a failing candidate's row is never copied. The exact test follows in the explode.
    for n in (0, 1, 2):
        candidates = candidates.where(
            F.coalesce(F.array_contains("_words", F.get("words", F.lit(n))), F.lit(True))
        )
    followed = F.filter(
        F.array("topic"),
        lambda topic: all_in(F.col("words")) & ~F.exists(F.col("earlier"), all_in),
    )
    return candidates.select(*columns, F.explode(followed).alias("topic"))


def language_fanout(df: DataFrame, languages: Sequence[str], fanout: bool = False) -> DataFrame:
    """Rows in one of the languages; ``fanout`` emits every row once per language instead."""
    if fanout:
        codes = F.array(*[F.lit(code) for code in languages])
        return df.withColumn("lenguage", F.explode(codes))
    return df.where(F.col("lenguage").isin(list(languages)))


def hashtag_rows(df: DataFrame, key: str, text: str = "tweetText") -> DataFrame:
    return df.select(key, F.explode(hashtags(F.col(text))).alias("hashtag"))


def lookup_by_id(df: DataFrame, value: object, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def list_all(df: DataFrame) -> DataFrame:
    return df


def find_where(df: DataFrame, condition: Column | str, first_by: Sequence[str] | None = None) -> DataFrame:
    """All matching rows, or the first in the given order."""
    found = df.where(condition)
    return found.orderBy(*first_by).limit(1) if first_by else found


def realtime_topics(pickups: DataFrame) -> DataFrame:
    return pickups.where("isRT").select("id")


def latest_row(df: DataFrame, time: str, key: str) -> DataFrame:
    """The newest row, the larger key on a tie; a top-1, not a sort."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(1)


def latest_by(df: DataFrame, group: Sequence[str], time: str, key: str) -> DataFrame:
    """The newest row of each group; combined on the map side, so hot groups stay spread."""
    rest = [c for c in df.columns if c not in group]
    newest = F.max_by(F.struct(*rest), F.struct(time, key))
    return df.groupBy(*group).agg(newest.alias("_newest")).select(*group, "_newest.*")


def page_rows(df: DataFrame, page: int, page_size: int, sort: str, key: str, ascending: bool = True) -> DataFrame:
    """One page (from 0) in the order of ``sort``, then ``key``."""
    order = [F.asc(sort), F.asc(key)] if ascending else [F.desc(sort), F.asc(key)]
    return df.orderBy(*order).offset(page * page_size).limit(page_size)


def upsert_rows(target: DataFrame, updates: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Replace rows that have an update; updates of unknown ids are not taken in.

    Of several updates of one id the last by ``order``, a column of the updates, wins; without such a
    column they are refused when the query runs. One row per id is left, so one left join does for
    removing and inserting.
    """
    row = F.struct(*target.columns)
    if order:
        last = F.max_by(row, order)
    else:
        last = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several updates of one id need an order"))).otherwise(F.first(row))
    new = updates.groupBy(key).agg(last.alias("_new"))
    joined = target.join(new, key, "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(target[c]).alias(c)
            for c in target.columns
        ]
    )


def unknown_updates(target: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """The updates an upsert refuses."""
    return updates.join(target.select(key), key, "left_anti")


def delete_rows(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def tally_for_model(aggs: DataFrame, topic: str, model: str) -> DataFrame:
    found = aggs.where((F.col("topic_id") == topic) & (F.col("model.id") == model))
    return found.orderBy("id").limit(1)


def pickup_state(pickups: DataFrame) -> DataFrame:
    state = F.col("state")
    return pickups.select(
        "*",
        (~state.isin("finished", "inprocess", "ready")).alias("can_be_created"),
        state.isin("ready").alias("can_be_collected"),
        state.isin("finished").alias("can_be_finished"),
    )


def skip_bad_rows(df: DataFrame, text: str = "tweetText", observation=None) -> DataFrame:
    """Drop rows without text; an Observation receives how many were seen and dropped."""
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("seen"),
            F.count_if(F.col(text).isNull()).alias("dropped"),
        )
    return df.where(F.col(text).isNotNull())
