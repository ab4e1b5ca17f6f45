"""Properties that hold whatever the data: bounds, coverage, independence of layout and skew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tonewise.operators import joins, models, registry, rows, splits, tallies
from tonewise.operators import scoring as sc
from tonewise.workload import fixtures as fx

SF = "/root/testdata/sf0.001"
WEIGHTS = splits.Weights(0.6, 0.2, 0.2)


@pytest.fixture(scope="module")
def tweets(spark):
    return fx.flagged_tweets(spark, SF).cache()


def _scores(tweets, spark):
    return sc.vader_scores(tweets, ["tweet_id"], "tweetText", spark.sql(fx.LEXICON))


def _rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_scores_are_bounded_and_shares_add_up(spark, tweets):
    bad = _scores(tweets, spark).where(
        "abs(compound) > 1 OR (neg + neu + pos > 0 AND abs(neg + neu + pos - 1) > 0.002)"
    )
    assert bad.count() == 0


def test_scores_do_not_depend_on_partitioning(spark, tweets):
    assert _rows(_scores(tweets.repartition(1), spark)) == _rows(_scores(tweets.repartition(13), spark))


def test_scores_of_a_lexicon_beyond_the_broadcast_limit(spark, tweets, monkeypatch):
    small = _rows(_scores(tweets, spark))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    frame = _scores(tweets, spark)
    assert _rows(frame) == small
    assert "_salt" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_topics_of_a_list_beyond_the_broadcast_limit(spark, tweets, monkeypatch):
    find = lambda: _rows(rows.track_topics(tweets, fx.tracked(spark, SF)).select("tweet_id", "topic"))
    small = find()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert small and find() == small


def test_a_topic_is_emitted_once_per_row(spark):
    pickups = spark.createDataFrame(
        [("t1", ["good day", "DAY", ""]), ("t2", ["night"]), ("t3", ["day good"])], "id string, topics array<string>"
    )
    frame = spark.createDataFrame([(1, "A good, good day!"), (2, "daylight")], "tweet_id int, tweetText string")
    assert _rows(rows.track_topics(frame, pickups).select("tweet_id", "topic")) == [(1, "t1"), (1, "t3")]


def test_salted_lookup_equals_broadcast_on_a_hot_key(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    side = spark.createDataFrame([("hot", 1), ("1", 2)], "name string, v int")
    for how in ("left", "inner", "left_semi"):
        one = _rows(joins.lookup(hot, "k", joins.Lookup(side, "name", True), how).select("k", "id"))
        two = _rows(joins.lookup(hot, "k", joins.Lookup(side, "name", False), how).select("k", "id"))
        assert one == two


@pytest.mark.parametrize("tag", ["vader", "emoji"])
def test_splits_are_disjoint_and_cover(tweets, tag):
    split = splits.split_emoji_aware(tweets, WEIGHTS, tag)
    assert split.count() == tweets.count() == split.select("tweet_id").distinct().count()
    assert {r[0] for r in split.select("split").distinct().collect()} <= {"train", "validation", "classify"}


def test_emoji_split_without_any_emoji(tweets):
    none = tweets.where("NOT contain_emoji")
    assert {r[0] for r in splits.split_emoji_aware(none, WEIGHTS, "emoji").select("split").distinct().collect()} == {"classify"}
    assert splits.split_emoji_aware(none.limit(0), WEIGHTS, "emoji").count() == 0


def test_bucket_takes_very_long_ids(spark):
    ids = spark.createDataFrame([(9_223_372_036_854_775_807,), (1_800_000_000_000_000_001,)], "tweet_id long")
    assert splits.split_random(ids, WEIGHTS).count() == 2


def test_vader_tally_leaves_out_exactly_one_half(spark):
    frame = spark.createDataFrame([(0.5,), (0.51,), (-0.5,), (0.0,)], "result double")
    row = tallies.tally(frame, "vader").first()
    assert (row.positive, row.negative, row.neutral) == (1, 1, 1)


def test_upsert_twice_changes_nothing(spark):
    target = fx.pickups(spark, SF)
    updates = target.limit(20).withColumn("state", F.lit("stopped"))
    once = rows.upsert_rows(target, updates)
    assert _rows(once.select("id", "state")) == _rows(rows.upsert_rows(once, updates).select("id", "state"))


def test_upsert_takes_the_last_update_or_refuses(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    updates = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (9, "x", 1)], "id int, v string, at int")
    assert _rows(rows.upsert_rows(target, updates, order="at")) == _rows(spark.createDataFrame([(1, "new"), (2, "b")], "id int, v string"))
    with pytest.raises(Exception, match="several updates"):
        rows.upsert_rows(target, updates).collect()


def test_neighbouring_seeds_split_differently(spark):
    ids = spark.range(4000).withColumnRenamed("id", "tweet_id")
    both = splits.split_random(ids, WEIGHTS, seed=42).join(splits.split_random(ids, WEIGHTS, seed=43).withColumnRenamed("split", "other"), "tweet_id")
    assert both.where("split <> other").count() > 4000 / 3


@pytest.mark.parametrize("limit", [200_000, 1])
def test_topics_of_rows_that_share_an_id(spark, monkeypatch, limit):
    from tonewise.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    tweets = spark.createDataFrame([(1, "a good day", "en"), (1, "a good day", "fr"), (2, "happy night", "en")], "tweet_id long, tweetText string, lenguage string")
    pickups = spark.createDataFrame([("t1", ["good day"]), ("t2", ["happy", "night happy"])], "id string, topics array<string>")
    got = sorted((r.tweet_id, r.lenguage, r.topic) for r in rows.track_topics(tweets, pickups).collect())
    assert got == [(1, "en", "t1"), (1, "fr", "t1"), (2, "en", "t2")]


def test_emoji_sequences_of_a_large_table(spark):
    from tonewise.functions import emoji as em

    points = [chr(0x1F300 + i) for i in range(700)]
    names = {p: f":p{i}:" for i, p in enumerate(points) if i % 5}
    names |= {points[i] + "\u200d" + points[j]: f":s{i}x{j}:" for i in range(0, 300) for j in (7, 9, 11)}
    names |= {points[3] + "\u200d" + points[7] + "\u200d" + points[1]: ":long:", "+\ufe0f": ":plus:", "a.": ":dot:"}
    aliases = em.EmojiAliases(names)
    rng = random.Random(2)
    pieces = [*rng.sample(sorted(names), 300), "x", " ", points[0], points[5], "ab", "\u200d", "+", points[3] + "\u200d"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = frame.select("t", em.emoji_to_alias(t, aliases), em.strip_emoji(t, aliases), em.has_emoji(t, aliases)).collect()
    longest = max(map(len, names))
    for text, aliased, stripped, has in got:
        i, a, s = 0, "", ""
        while i < len(text):
            hit = next((text[i : i + n] for n in range(longest, 0, -1) if text[i : i + n] in names), None)
            a, s, i = (a + names[hit], s, i + len(hit)) if hit else (a + text[i], s + text[i], i + 1)
        assert (aliased, stripped, has) == (a, s, a != text)


def test_subtract_keeps_left_repeats_and_nulls(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "b"), (3, "c")], "a int, b string")
    right = spark.createDataFrame([(2, "b"), (2, "b"), (9, None)], "a int, b string")
    assert splits.subtract_rows(left, right).count() == 3


def test_empty_split_has_no_accuracy(spark):
    frame = spark.createDataFrame([("train", 1.0, 1.0), ("train", 0.0, 1.0)], "split string, prediction double, label double")
    row = models.evaluate_splits(frame, "bayes").first()
    assert (row.train_accuracy, row.valid_accuracy, row.test_accuracy) == (0.5, None, None)


def test_evaluation_before_training_is_refused(spark):
    frame = spark.createDataFrame(
        [("r", "evaluate", 1, 1), ("r", "train", 2, 1), ("r", "evaluate", 3, 1), ("q", "evaluate", 1, 1)],
        "run string, action string, asked_at int, seq int",
    )
    got = {(r.run, r.asked_at): r.accepted for r in registry.judge_actions(frame).collect()}
    assert got == {("r", 1): False, ("r", 2): True, ("r", 3): True, ("q", 1): False}
    states = {r.run: (r.status, r.refused) for r in registry.run_states(frame).collect()}
    assert states == {"r": ("trained", 1), "q": ("created", 1)}


def test_model_parameters_round_trip(spark):
    stored = fx.models(spark, SF)
    typed = registry.parse_model_params(stored)
    again = registry.parse_model_params(registry.format_model_params(typed))
    assert [r.asDict() for r in typed.orderBy("id").collect()] == [
        r.asDict() for r in again.orderBy("id").collect()
    ]


def test_bad_rows_are_counted(spark):
    from pyspark.sql import Observation

    seen = Observation()
    frame = spark.createDataFrame([(1, "a"), (2, None)], "tweet_id int, tweetText string")
    assert rows.skip_bad_rows(frame, observation=seen).count() == 1
    assert seen.get == {"seen": 2, "dropped": 1}
