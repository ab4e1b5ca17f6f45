"""Language identification from character trigrams of words, counted and scored by Spark.

A profile holds, for every trigram of the learnt texts and every language, a whole-number weight: 10,000 times
the logarithm of its smoothed share, less that of a trigram the language has never shown. A text's score for a
language adds up the weights of all its trigrams, so sums are whole numbers and don't depend on their order. The
lookup keeps a text's trigrams in its own partition, where they combine to one row, and only that is shuffled.

Words are runs of letters in lower case, with a blank on both sides. A text without letters has no language;
of equal scores the first code wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.operators.joins import lookup, measure

#: A weight of 1 stands for a ten-thousandth of a natural logarithm.
SCALE = 10_000
_BREAK = r"[^\p{L}]+"


def trigrams(text: Column) -> Column:
    """All trigrams of a text's words; each word is cut on its own, so a long text takes linear time."""
    words = F.filter(F.split(F.lower(text), _BREAK), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    return F.flatten(F.transform(padded, cut))


def gram_rows(df: DataFrame, keep: str, text: str) -> DataFrame:
    """(keep, _gram): the trigrams as rows, of words as rows, which Spark cuts in generated code; an array function would be interpreted."""
    words = df.select(keep, F.explode(F.split(F.lower(F.col(text)), _BREAK)).alias("_word")).where("_word <> ''")
    padded = words.select(keep, F.concat(F.lit(" "), "_word", F.lit(" ")).alias("_word"))
    places = padded.select(keep, "_word", F.explode(F.sequence(F.lit(1), F.char_length("_word") - 2)).alias("_place"))
    return places.select(keep, F.substring("_word", F.col("_place"), F.lit(3)).alias("_gram"))


def _weight(count: Column, total: Column, kinds: Column) -> Column:
    return F.floor(F.log((count + 1) / (total + kinds)) * SCALE + 0.5).cast("long")


def language_profiles(texts: DataFrame, languages: Sequence[str], text: str = "tweetText", language: str = "lenguage") -> DataFrame:
    """(gram, weights) of the learnt texts, and a row without a gram for those never seen; weights follow ``languages``."""
    grams = gram_rows(texts.where(F.col(language).isin(list(languages))), language, text).withColumnRenamed("_gram", "gram")
    counts = [F.count_if(F.col(language) == code).alias(f"c{i}") for i, code in enumerate(languages)]
    profile = grams.groupBy("gram").agg(*counts)
    totals = profile.agg(F.count("*").alias("kinds"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"t{i}") for i in range(len(languages))])
    total = lambda i: F.col(f"t{i}")
    unseen = [_weight(F.lit(0), total(i), F.col("kinds")) for i in range(len(languages))]
    seen = [_weight(F.col(f"c{i}"), total(i), F.col("kinds")) for i in range(len(languages))]
    rows = profile.crossJoin(F.broadcast(totals)).select("gram", F.array(*[s - u for s, u in zip(seen, unseen)]).alias("weights"))
    return rows.unionByName(totals.select(F.lit(None).cast("string").alias("gram"), F.array(*unseen).alias("weights")))


def language_scores(df: DataFrame, profiles: DataFrame, languages: Sequence[str], key: str = "tweet_id", text: str = "tweetText") -> DataFrame:
    """(key, scores): the sums for each language of every row that has letters; ``key`` is unique."""
    base = profiles.where("gram IS NULL").select("weights").first()["weights"]
    side = measure(profiles.where("gram IS NOT NULL"), "gram")
    met = lookup(gram_rows(df, key, text), "_gram", side, "left")
    sums = [F.sum(F.coalesce(F.col("weights")[i], F.lit(0)) + F.lit(base[i])).alias(f"s{i}") for i in range(len(languages))]
    return met.groupBy(key).agg(*sums).select(key, F.array(*[f"s{i}" for i in range(len(languages))]).alias("scores"))


def identify(df: DataFrame, profiles: DataFrame, languages: Sequence[str], key: str = "tweet_id", text: str = "tweetText") -> DataFrame:
    """(key, identified) of every row that has letters."""
    scores = language_scores(df, profiles, languages, key, text)
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    return scores.select(key, F.element_at(F.array(*[F.lit(c) for c in languages]), best).alias("identified"))


def keep_languages(
    df: DataFrame, profiles: DataFrame, languages: Sequence[str], wanted: Sequence[str], key: str = "tweet_id", text: str = "tweetText", column: str = "lenguage"
) -> DataFrame:
    """Rows identified as one of the wanted languages, with the code in ``column``; declared codes aren't trusted."""
    found = identify(df, profiles, languages, key, text).where(F.col("identified").isin(list(wanted)))
    return df.drop(column).join(found.withColumnRenamed("identified", column), key)
