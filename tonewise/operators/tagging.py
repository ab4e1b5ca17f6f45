"""Weak labels from the lexicon scorers, and the unsupervised runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.functions import labels
from tonewise.functions import text as tx
from tonewise.functions.emoji import EmojiAliases, emoji_to_alias, strip_emoji
from tonewise.operators.rows import skip_bad_rows
from tonewise.operators.scoring import emoji_word_scores, vader_scores
from tonewise.operators.sentences import SentenceModel, longest_sentences, score_sentences


@dataclass(frozen=True)
class Lexicons:
    """The lexicon tables of a deployment: (token, valence) frames and the emoji aliases."""

    vader: DataFrame
    emoji: DataFrame
    words: DataFrame
    aliases: EmojiAliases


def _messages(tweets: DataFrame, lexicons: Lexicons, *keep: str) -> DataFrame:
    """(keep..., message) of the rows with a text. Lower case first, so rules on capitals only act in the unsupervised runs.

    Each step is a column of its own: inside array functions an expression is made anew wherever it is named.
    """
    lowered = skip_bad_rows(tweets).select(*keep, F.lower("tweetText").alias("message"))
    return lowered.select(*keep, emoji_to_alias(F.col("message"), lexicons.aliases).alias("message"))


def compound_of(tweets: DataFrame, tagger: str, lexicons: Lexicons, key: str = "tweet_id") -> DataFrame:
    """(key, compound) of the message text under one tagger."""
    if tagger == "nlp":
        return sentence_scores(skip_bad_rows(tweets), lexicons, [key]).select(key, "compound")
    rows = _messages(tweets, lexicons, key)
    if tagger == "emoji":
        return emoji_word_scores(rows, [key], "message", lexicons.emoji, lexicons.words).select(key, "compound")
    if tagger == "vader":
        return vader_scores(rows, [key], "message", lexicons.vader).select(key, "compound")
    raise ValueError(f"unknown tagger {tagger!r}")


def label_for(kind: str, tagger: str, compound: Column) -> Column:
    """Label of a compound score for a model kind; classifiers get classes, others the score."""
    if tagger == "nlp":
        return labels.five_to_three(labels.five_class(compound)).cast("double")
    if kind in ("rr", "multinomial"):
        return labels.three_class(compound)
    if kind == "bernoulli":
        return labels.two_class(compound)
    if kind == "boosting":
        return labels.boosting_label(compound)
    return compound


def labels_of(tweets: DataFrame, tagger: str, kind: str, lexicons: Lexicons, key: str = "tweet_id") -> DataFrame:
    scored = compound_of(tweets, tagger, lexicons, key)
    return scored.select(key, label_for(kind, tagger, F.col("compound")).alias("label"))


def tokens_of(
    tweets: DataFrame, lexicons: Lexicons, keep: Sequence[str] = (), key: str = "tweet_id", stop_words: list[str] | None = None
) -> DataFrame:
    """(key, keep..., tokens) of the message without emoji; row-local."""
    tokens = tx.space_tokens(F.col("message"))
    if stop_words:
        tokens = tx.drop_stop_words(tokens, stop_words)
    rows = _messages(tweets, lexicons, key, *keep).withColumn("message", strip_emoji(F.col("message"), lexicons.aliases))
    return rows.select(key, *keep, tokens.alias("tokens"))


def tag_rows(
    tweets: DataFrame,
    tagger: str,
    kind: str,
    lexicons: Lexicons,
    keep: Sequence[str] = (),
    key: str = "tweet_id",
    stop_words: list[str] | None = None,
) -> DataFrame:
    """(key, keep..., tokens, label). ``key`` is unique: ingest keeps one row per tweet and topic."""
    tokens = tokens_of(tweets, lexicons, keep, key, stop_words)
    return tokens.join(labels_of(tweets, tagger, kind, lexicons, key), key)


def sentence_scores(df: DataFrame, lexicons: Lexicons, key: Sequence[str], text: str = "tweetText") -> DataFrame:
    """Score of each text's longest sentence: picked row-locally, so only that one is scored."""
    picked = df.select(*key, tx.longest_sentence(F.col(text)).alias("sentence"))
    return vader_scores(picked, key, "sentence", lexicons.vader)


def as_results(scored: DataFrame, kind: str, execution: str, result: Column, key: str = "tweet_id", keep: Sequence[str] = ()) -> DataFrame:
    """Result rows. The id is made of run and tweet, so a repeated write can be recognised."""
    return scored.select(
        F.concat_ws("-", F.lit(execution), F.col(key).cast("string")).alias("id"),
        F.col(key).alias("idTweet"),
        F.lit(execution).alias("idExecution"),
        F.lit(kind).alias("typeModel"),
        result.cast("double").alias("result"),
        *keep,
    )


def run_vader(tweets: DataFrame, lexicons: Lexicons, execution: str, keep: Sequence[str] = ()) -> DataFrame:
    """Compound score of the raw text without emoji; capitals count."""
    rows = skip_bad_rows(tweets).select(
        "tweet_id", *keep, strip_emoji(F.col("tweetText"), lexicons.aliases).alias("clean")
    )
    scored = vader_scores(rows, ["tweet_id", *keep], "clean", lexicons.vader)
    return as_results(scored, "vader", execution, F.col("compound"), keep=keep)


def run_emoji(tweets: DataFrame, lexicons: Lexicons, execution: str, keep: Sequence[str] = ()) -> DataFrame:
    """Blended emoji and word score of the raw text."""
    rows = skip_bad_rows(tweets)
    scored = emoji_word_scores(rows, ["tweet_id", *keep], "tweetText", lexicons.emoji, lexicons.words)
    return as_results(scored, "emoji", execution, F.col("compound"), keep=keep)


def run_sentences(tweets: DataFrame, lexicons: Lexicons, execution: str, keep: Sequence[str] = ()) -> DataFrame:
    """Three-class value of the longest sentence."""
    scored = sentence_scores(skip_bad_rows(tweets), lexicons, ["tweet_id", *keep])
    result = labels.five_to_three(labels.five_class(F.col("compound")))
    return as_results(scored, "nlp", execution, result, keep=keep)


def run_trained_sentences(tweets: DataFrame, model: SentenceModel, execution: str, keep: Sequence[str] = ()) -> DataFrame:
    """Class of the longest sentence by a trained model of two classes: 0 negative, 2 positive."""
    sentences = longest_sentences(skip_bad_rows(tweets), ("tweet_id", *keep))
    scored = score_sentences(sentences, model, ("tweet_id", *keep))
    return as_results(scored, "nlp", execution, F.when(F.col("prediction") > 0, 2.0).otherwise(0.0), keep=keep)


def import_api_scores(tweets: DataFrame, responses: DataFrame, execution: str, keep: Sequence[str] = ()) -> DataFrame:
    """Results of an outside service, delivered as a table (tweet_id, neg, neutral, pos)."""
    joined = tweets.select("tweet_id", *keep).join(responses, "tweet_id")
    return as_results(joined, "api", execution, labels.api_class(F.col("neg"), F.col("pos")), keep=keep)
