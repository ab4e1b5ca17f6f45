"""Hand-derived scores, one or more per rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tonewise.functions import emoji as em
from tonewise.functions import text as tx
from tonewise.operators.scoring import emoji_word_scores, vader_scores

LEXICON = [("good", 1.9), ("great", 3.1), ("bad", -2.5), ("happy", 2.7), ("awful", -2.0), ("mustard", 1.0), ("ass", -2.5)]

GOLDEN = [
    ("", 0, 0, 0, 0),
    ("a b c", 0, 0, 0, 0),
    ("the film is good", 0, 0.508, 0.492, 0.4404),
    ("the film is GOOD", 0, 0.452, 0.548, 0.5622),
    ("the film is good!!", 0, 0.463, 0.537, 0.5399),
    ("good???? film", 0, 1, 0, 0),
    ('"good" film', 0, 1, 0, 0),
    ("good good. bad!", 0, 0.141, 0.859, 0.7263),
    ("film is not good", 0.445, 0.555, 0, -0.3412),
    ("film can't be good", 0.445, 0.555, 0, -0.3412),
    ("never this good film", 0, 0.438, 0.562, 0.5927),
    ("film was kept this good", 0, 0.542, 0.458, 0.5228),
    ("the bad good, but great end", 0.175, 0.233, 0.591, 0.7469),
    ("GREAT start BUT awful end", 0.403, 0.303, 0.294, -0.2694),
    ("this very good film", 0, 1, 0, 0),
    ("it is kind of good", 0, 1, 0, 0),
    ("film is good, very bad but great", 0, 0.606, 0.394, 0.2382),
    ("at least good film", 0, 0.508, 0.492, 0.4404),
    ("film least good here", 0.445, 0.555, 0, -0.3412),
    ("they will cut the mustard", 0, 0.571, 0.429, 0.4588),
    ("what a total bad ass", 0.438, 0.25, 0.313, -0.25),
    ("it has just enough good", 0, 0.605, 0.395, 0.3832),
    ("😀 good film 😀", 0, 0.508, 0.492, 0.4404),
    ("a good  day   ", 0, 0.256, 0.744, 0.4404),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, valence double")


def scored(spark, lexicon, texts, **flags):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    found = {r.id: r for r in vader_scores(rows, ["id"], "body", lexicon, **flags).collect()}
    return [found[i] for i in range(len(texts))]


def test_golden_rows(spark, lexicon):
    got = scored(spark, lexicon, [g[0] for g in GOLDEN])
    for row, (text, *want) in zip(got, GOLDEN):
        assert [row.neg, row.neu, row.pos, row.compound] == want, text


def test_published_variant_scans_past_degree_words(spark, lexicon):
    texts = ["this very good film", "it is kind of good", "film is good, very bad but great"]
    got = scored(spark, lexicon, texts, stop_at_booster=False)
    assert [r.compound for r in got] == [0.4927, 0.3832, 0.7649]


def test_full_map_strips_behind_a_repeat(spark, lexicon):
    kept, stripped = (
        scored(spark, lexicon, ["well well said bad!"], full_punct_map=flag)[0] for flag in (False, True)
    )
    assert kept.compound == 0 and stripped.compound < 0


def test_missing_text_scores_zero(spark, lexicon):
    row = scored(spark, lexicon, [None])[0]
    assert (row.neg, row.neu, row.pos, row.compound) == (0, 0, 0, 0)


def test_two_column_key_and_repeated_ids(spark, lexicon):
    rows = spark.createDataFrame([(1, "en", "good"), (1, "fr", "bad")], "id int, lang string, body string")
    got = {r.lang: r.compound for r in vader_scores(rows, ["id", "lang"], "body", lexicon).collect()}
    assert got["en"] > 0 > got["fr"]


def test_blend_counts_emoji_twice(spark):
    emoji = spark.createDataFrame([("😀", 1.0), ("😡", -1.0)], "token string, valence double")
    words = spark.createDataFrame([("bad", -1.0)], "token string, valence double")
    rows = spark.createDataFrame([(1, "😀 bad film")], "id int, body string")
    row = emoji_word_scores(rows, ["id"], "body", emoji, words).first()
    assert row.compound == (0.25 * 2 + -0.25) / 3


TOKENS = [("a b  ", ["a", "b"]), (" a  b", ["", "a", "", "b"]), ("", [""]), ("   ", [])]


@pytest.mark.parametrize("body, want", TOKENS)
def test_space_tokens(spark, body, want):
    row = spark.createDataFrame([(body,)], "body string").select(tx.space_tokens(F.col("body")).alias("t")).first()
    assert row.t == want


def test_join_tokens(spark):
    frame = spark.createDataFrame([(["a", "b"],), ([],)], "t array<string>")
    assert [r[0] for r in frame.select(tx.join_tokens(F.col("t"))).collect()] == [" a b", ""]


def test_half_up_rounding_of_negative_ties(spark):
    row = spark.range(1).select(tx.round_half_up(F.lit(-0.00125), 4), tx.round_half_up(F.lit(0.125), 2)).first()
    assert list(row) == [-0.0012, 0.13]


def test_longest_sentence_first_wins_tie(spark):
    rows = spark.createDataFrame([("Ab cd. Ef gh. X",), ("One 😀. Two xyz.",), ("",)], "body string")
    got = [r[0] for r in rows.select(tx.longest_sentence(F.col("body"))).collect()]
    assert got == ["Ab cd.", "Two xyz.", ""]


def test_aliases_prefer_longest_sequence(spark):
    table = spark.createDataFrame([("👍", ":up:"), ("👍🏽", ":up_medium:"), ("❤", ":heart:")], "emoji string, alias string")
    aliases = em.load_aliases(table)
    rows = spark.createDataFrame([("a👍🏽b👍❤",), ("plain",), ("",)], "body string")
    body = F.col("body")
    got = rows.select(
        em.emoji_to_alias(body, aliases), em.strip_emoji(body, aliases), em.has_emoji(body, aliases)
    ).collect()
    assert [tuple(r) for r in got] == [("a:up_medium:b:up::heart:", "ab", True), ("plain", "plain", False), ("", "", False)]


def test_alias_table_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(em, "MAX_ALIASES", 1)
    table = spark.createDataFrame([("👍", ":a:"), ("❤", ":b:")], "emoji string, alias string")
    with pytest.raises(ValueError):
        em.load_aliases(table)
