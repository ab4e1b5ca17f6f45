"""Positive / negative / neutral tallies and other small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.functions.labels import score_to_class


def _between(result: Column) -> dict[str, Column]:
    return {"positive": result > 0.6, "negative": result < 0.4, "neutral": (result >= 0.4) & (result <= 0.6)}


def thresholds(kind: str, result: Column) -> dict[str, Column]:
    """The three conditions of a model kind. A result may meet none of them."""
    never = F.lit(False)
    if kind == "bernoulli":
        return {"positive": result == 1, "negative": result == 0, "neutral": never}
    if kind == "multinomial":
        return {"positive": result == 2, "negative": result == 0, "neutral": result == 1}
    if kind == "boosting":
        return {"positive": result > 1, "negative": result <= 1, "neutral": never}
    if kind == "vader":
        return {"positive": result > 0.5, "negative": result <= -0.5, "neutral": (result > -0.5) & (result < 0.5)}
    if kind == "rr":
        found = score_to_class(result)
        return {"positive": found == 2, "negative": found == 0, "neutral": found == 1}
    if kind in ("nlp", "emoji"):
        return _between(result)
    raise ValueError(f"model kind {kind!r} has no tally")


def tally(results: DataFrame, kind: str, by: Sequence[str] = (), result: str = "result") -> DataFrame:
    """All three counts in one pass; combined on the map side before the shuffle by group."""
    counts = [F.count_if(test).alias(name) for name, test in thresholds(kind, F.col(result)).items()]
    return results.groupBy(*by).agg(*counts)


def sentence_aggregate(df: DataFrame, group: Sequence[str], code: str) -> DataFrame:
    """Whole-number mean, maximum and mode (the smallest on a tie) of class codes."""
    value = F.col(code)
    return df.groupBy(*group).agg(
        F.expr(f"sum({code}) div count({code})").cast("double").alias("mean"),
        F.max(value).cast("double").alias("max"),
        F.mode(value, True).cast("double").alias("mode"),
    )


def topic_counts(tweets: DataFrame, pickups: DataFrame) -> DataFrame:
    """Row and emoji counts per followed topic, and whether the warning size is reached."""
    counted = tweets.groupBy("topic").agg(
        F.count(F.lit(1)).alias("nTweets"), F.count_if("contain_emoji").alias("nEmojis")
    )
    joined = pickups.select("id", "cuantity_warn").join(counted, F.col("id") == F.col("topic"), "left")
    n = F.coalesce("nTweets", F.lit(0))
    return joined.select(
        "id",
        n.alias("nTweets"),
        F.coalesce("nEmojis", F.lit(0)).alias("nEmojis"),
        (n >= F.col("cuantity_warn")).alias("warn"),
    )


def emoji_counts(df: DataFrame, aliases, text: str = "tweetText") -> DataFrame:
    """How often each emoji occurs, with its alias."""
    from tonewise.functions.emoji import extract_emoji

    found = df.select(F.explode(extract_emoji(F.col(text), aliases)).alias("emoji"))
    return found.groupBy("emoji").agg(F.count(F.lit(1)).alias("n")).select("emoji", aliases.alias(F.col("emoji")).alias("alias"), "n")
