"""Token preparation by whole-array functions gives what the rules say token by token, and makes each message once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tonewise.functions import emoji as em
from tonewise.functions import text as tx
from tonewise.functions.fixed_values import ENGLISH_STOP_WORDS, RAISING
from tonewise.functions.valence import stops
from tonewise.operators import tagging as tg
from tonewise.workload import fixtures as fx


def texts() -> list[str]:
    rng = random.Random(5)
    odd = ["kind", "Kind", "of", "OF", "BUT", "but,", "NASA", "U.S.A", "É", "ÉÉ!", "Σ", "ΟΔΟΣ", "ϒϒ", "😀", "a", "", "!!", "--x", "'tis", "VERY", "so?", "ǅǅ", "\nAB", "can't"]
    out = ["", " ", "kind of", "kind off very", "of kind", "a b c", "AB", "ab", "AB cd", "𝐀𝐀 b"]
    for n in (5, 40, 64, 65, 130, 511, 512, 513, 900):
        fresh = [f"w{i}" for i in range(n)]
        out += [" ".join(fresh), " ".join([*fresh, fresh[-1] + ",", "w0!", "w3??", "!?w4", "w5?"]), " ".join([*fresh, "very"])]
        for _ in range(4):
            out.append(" ".join(rng.choice([*odd, *RAISING[:3], *fresh]) + rng.choice(["", "", "", ",", "!!", "."]) for _ in range(n)))
    return out


def test_tokens_stops_and_capitals_follow_the_plain_rules(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "id int, body string")
    body = F.col("body")
    bare = F.split(F.translate(body, tx.SINGLE_MARKS, ""), " ")
    rows = rows.select("id", "body", tx.strip_runs(body).alias("tokens"), F.split(body, " ").alias("pieces"), bare.alias("bare"))
    rows = rows.select("*", tx.words_before_repeat(F.filter("bare", tx.two_units)).alias("known"), tx.lower_tokens(F.col("tokens")).alias("lowered"))
    plain = F.zip_with("pieces", "bare", lambda t, w: F.when((t != w) & tx.two_units(w) & tx._edge_run(t, w) & F.array_contains("known", w), w).when(tx.two_units(t), t))
    flags = f"zip_with(tokens, slice(tokens, 2, size(tokens)), (t, f) -> {stops('t', 'f')})"
    tokens, marks = F.col("tokens"), lambda m: F.length("body") - F.length(F.replace(body, F.lit(m), F.lit("")))
    found = rows.select(
        "id",
        "body",
        tx._known_words(F.col("bare")).eqNullSafe(F.col("known")).alias("same_known"),
        tokens.eqNullSafe(F.filter(plain, lambda t: t.isNotNull())).alias("same_tokens"),
        tx.first_stop("tokens", "lowered").eqNullSafe(F.expr(f"CAST(array_position({flags}, true) AS INT)")).alias("same_stop"),
        tx.caps_differential(body, tokens).eqNullSafe(F.exists(tokens, tx.is_upper) & F.exists(tokens, lambda t: ~tx.is_upper(t))).alias("same_caps"),
        tx.punctuation_emphasis(body).eqNullSafe(F.least(marks("!"), F.lit(4)) * 0.292 + F.when(marks("?") > 3, 0.96).otherwise(marks("?") * 0.18)).alias("same_emphasis"),
    )
    for row in found.collect():
        assert all(row[2:]), row


def test_a_message_is_made_once(spark):
    tweets = spark.range(3).select(F.col("id").alias("tweet_id"), F.lit("A 😀 day").alias("tweetText"))
    tokens = tg.tokens_of(tweets, fx.lexicons(spark), stop_words=ENGLISH_STOP_WORDS)
    assert [r.tokens for r in tokens.collect()] == [[":grinning:", "day"]] * 3
    stored = spark.range(3).select(F.col("id").alias("tweet_id"), F.concat(F.lit("A 😀 day"), F.col("id").cast("string")).alias("tweetText"))
    plan = tg.tokens_of(stored, fx.lexicons(spark), stop_words=ENGLISH_STOP_WORDS)._jdf.queryExecution().optimizedPlan().toString()
    # One to cut the text at its emoji, one to strip what is left.
    assert plan.count("regexp_replace(") == 2 and plan.count("lower(cast(") + plan.count("lower(concat(") <= 1, plan


def test_single_emoji_are_one_class_and_sequences_are_found(spark):
    names = {"😀": ":a:", "👍": ":b:", "👍🏽": ":c:", "1️⃣": ":d:", "❤": ":e:"}
    aliases = em.EmojiAliases(names)
    single = em.EmojiAliases({"😀": ":a:", "❤": ":e:"})
    assert single.pattern.startswith("[")
    few = spark.createDataFrame([("1 😀👍❤x",)], "b string").select(em.extract_emoji(F.col("b"), single).alias("found"), em.strip_emoji(F.col("b"), single).alias("rest")).first()
    assert (few.found, few.rest) == (["😀", "❤"], "1 👍x")
    body = "1 😀👍🏽👍 1️⃣❤1"
    row = spark.createDataFrame([(body,)], "b string").select(em.extract_emoji(F.col("b"), aliases).alias("found"), em.strip_emoji(F.col("b"), aliases).alias("rest")).first()
    assert (row.found, row.rest) == (["😀", "👍🏽", "👍", "1️⃣", "❤"], "1  1")
