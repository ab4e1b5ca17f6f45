"""Sources, models and streams end to end on small data."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tonewise.operators import models as ml
from tonewise.plans import jobs
from tonewise.schemas import MESSAGE
from tonewise.session import scratch_dir
from tonewise.sources import sinks, tables
from tonewise.streaming import live
from tonewise.workload import fixtures as fx


def test_lexicon_file_last_line_wins_over_many_blocks(spark, tmp_path):
    lines = [f"w{i % 50}\t{i}.5\textra" for i in range(5000)] + ["broken line", "", "  spaced\t-1.0"]
    path = tmp_path / "the lexicon"
    path.mkdir()
    (path / "a 1%20é.txt").write_text("\n".join(lines[:2000]), encoding="utf-8")
    (path / "b.txt").write_text("\n".join(lines[2000:]), encoding="utf-8")
    (path / "aa.txt").write_text("w1\t7\nw2\t8", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = {r.token: r.valence for r in tables.load_lexicon(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"w{i % 50}": i + 0.5 for i in range(4950, 5000)} | {"spaced": -1.0}


def test_polarity_files_negative_wins(spark, tmp_path):
    (tmp_path / "up.txt").write_text("good\nodd\n", encoding="utf-8")
    (tmp_path / "down.txt").write_text("odd\nbad\n", encoding="utf-8")
    got = tables.load_polarity_lists(spark, str(tmp_path / "up.txt"), str(tmp_path / "down.txt")).collect()
    assert {r.token: r.valence for r in got} == {"good": 1.0, "odd": -1.0, "bad": -1.0}


def test_scratch_folder_is_below_the_shared_one(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_unknown_result_table(spark):
    with pytest.raises(ValueError):
        sinks.write_results(spark.range(1), "/nowhere", "other")


def _separable(spark):
    words = F.when(F.col("tweet_id") % 3 == 0, "good great film").otherwise("awful bad film")
    return spark.range(300).select(
        F.col("id").alias("tweet_id")
    ).select("tweet_id", words.alias("tweetText"), F.lit("src0").alias("topic"), F.lit(False).alias("contain_emoji"))


@pytest.mark.parametrize(
    "spec",
    [
        ml.ModelSpec("nb", "bayes", type_model="bernoulli", n_class_words=64),
        ml.ModelSpec("nm", "bayes", n_class_words=64),
        ml.ModelSpec("rf", "rr", num_trees=5, depth=3, n_class_words=64),
        ml.ModelSpec("gb", "boosting", num_iterations=3, depth=2, n_class_words=64),
    ],
    ids=lambda s: s.id,
)
def test_model_beats_the_majority(spark, spec):
    root = scratch_dir(spark, "models")
    tweets = _separable(spark)
    lexicons = fx.lexicons(spark)
    row = jobs.train_and_evaluate(tweets, spec, lexicons, root).metrics.first()
    assert min(row.train_accuracy, row.valid_accuracy, row.test_accuracy) > 0.9
    again = jobs.evaluate_saved(tweets, spec, lexicons, root, "trained").first()
    assert again.test_accuracy == row.test_accuracy
    results = jobs.run_saved(tweets, spec, lexicons, root, "e1")
    assert 0 < results.count() < 300
    assert results.columns == ["id", "idTweet", "idExecution", "typeModel", "result"]


def _run_tables(spark, root):
    names = ("executions", "model_results", "tweet_results", "aggs")
    tables_ = {n: spark.read.parquet(f"{root}/{n}") for n in names}
    return {n: sorted(str(r) for r in t.select([F.col(c).cast("string") for c in t.columns]).collect()) for n, t in tables_.items()}


def test_a_repeated_run_leaves_the_same_tables_and_trainings_keep_their_metrics(spark):
    models, root, lexicons, tweets = scratch_dir(spark, "models"), scratch_dir(spark, "tables"), fx.lexicons(spark), _separable(spark)
    spec = ml.ModelSpec("nm", "bayes", n_class_words=64)

    def run(execution, rows=tweets):
        jobs.train_run_and_store(rows, spec, lexicons, models, root, execution, "src0", "2024-01-01")

    run("7")
    first = _run_tables(spark, root)
    run("7")
    assert _run_tables(spark, root) == first
    assert (len(first["executions"]), len(first["model_results"]), len(first["aggs"])) == (3, 1, 1)
    run("8 b", tweets.withColumn("tweetText", F.lit("good great film")))
    runs = spark.read.parquet(f"{root}/executions")
    metrics = spark.read.parquet(f"{root}/model_results").withColumnRenamed("id", "resultModel")
    linked = runs.join(metrics, "resultModel").select(F.col("id").cast("string"), "status", F.col("idExecution").cast("string")).collect()
    assert sorted((r.id, r.status) for r in linked) == [("7", "runned"), ("7", "trained"), ("8 b", "runned"), ("8 b", "trained")]
    assert all(r.id == r.idExecution for r in linked)
    aggs = {r.id: (r.positive, r.negative) for r in spark.read.parquet(f"{root}/aggs").collect()}
    assert aggs["agg-8 b"][1] == 0 and aggs["agg-7"][1] > aggs["agg-7"][0] > 0
    assert set(first["tweet_results"]) <= set(_run_tables(spark, root)["tweet_results"])


def test_evaluating_an_untrained_run_is_refused(spark):
    with pytest.raises(ValueError):
        jobs.evaluate_saved(_separable(spark), ml.ModelSpec("x", "rr"), fx.lexicons(spark), "/nowhere", "created")


def test_unsupervised_kind_cannot_be_trained(spark):
    with pytest.raises(ValueError):
        ml.train(spark.range(1), ml.ModelSpec("x", "vader"))


def _codes(spark, rows):
    return spark.createDataFrame(rows, "key string, t long, code int").select(
        "key", F.timestamp_seconds("t").alias("timestamp"), "code"
    )


def test_live_tally_restarts_and_counts_late_rows(spark):
    source, out, mark = (scratch_dir(spark, label) for label in ("source", "tally", "mark"))

    def feed(rows):
        frame = _codes(spark, rows)
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = live.open_stream(spark, "parquet", source, frame.schema)
        live.stream_tally(stream, out, mark, once=True).awaitTermination()

    feed([("a", 100, 4), ("a", 101, 0), ("b", 102, 2)])
    feed([("a", 103, 3), ("a", 200, 1)])
    feed([("a", 101, 4), ("a", 201, 1)])

    def current():
        rows = live.current_tally(tables.read_table(spark, out)).collect()
        return {(r.topic_id, int(r.window_start.timestamp())): (r.positive, r.negative, r.neutral) for r in rows}

    want = {("a", 100): (3, 1, 0), ("b", 100): (0, 0, 1), ("a", 200): (0, 2, 0)}
    assert current() == want
    live.fold_tally(spark, out)
    live.fold_tally(spark, out)
    assert current() == want
    feed([("b", 100, 4)])
    want["b", 100] = (1, 0, 1)
    assert current() == want
    live.fold_tally(spark, out)
    assert current() == want


def _ingest(spark, source, tweets, sent, mark):
    pickups = spark.createDataFrame([("t1", ["good day"]), ("t2", ["happy"])], "id string, topics array<string>")
    aliases = fx.aliases(spark)
    stream = live.open_stream(spark, "parquet", source, "value string, lang string")
    live.stream_ingest(stream, pickups, aliases, ["en", "fr"], tweets, sent, mark, once=True).awaitTermination()


def _statuses(spark, rows, source):
    lines = [(f'{{"id":{i},"createdAt":{t},"text":"{text}","user":{{"id":1,"name":"n","followersCount":1}}}}', lang) for i, t, text, lang in rows]
    spark.createDataFrame(lines, "value string, lang string").coalesce(1).write.mode("append").parquet(source)


@pytest.mark.parametrize("limit", [200_000, 1])
def test_ingest_keeps_old_statuses_and_drops_repeats_in_any_batch(spark, monkeypatch, limit):
    from tonewise.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    source, tweets, sent, mark = (scratch_dir(spark, x) for x in ("statuses", "tweets", "sent", "mark"))
    day = 86_400_000
    for rows in (
        [(1, 9 * day, "a good day", "en"), (2, 9 * day, "so happy", "fr")],
        [(1, 9 * day, "a good day", "en"), (3, 5 * day, "happy good day", "en")],
        [(4, day, "day is good", "en"), (2, 9 * day, "so happy", "fr"), (5, day, "nothing", "en")],
    ):
        _statuses(spark, rows, source)
        _ingest(spark, source, tweets, sent, mark)
    got = sorted((r.tweet_id, r.topic) for r in tables.read_table(spark, tweets).collect())
    assert got == [(1, "t1"), (2, "t2"), (3, "t1"), (3, "t2"), (4, "t1")]


@pytest.mark.parametrize("any_distance", [False, True])
def test_ingest_stores_a_text_once_however_many_topics_follow_it(spark, any_distance):
    """Topics see the whole status they came with, edited texts stay apart, and rows of one text are stored side by side."""
    from tonewise.streaming import seen

    source, tweets, sent, mark = (scratch_dir(spark, x) for x in ("statuses", "tweets", "sent", "mark"))
    store = seen.SeenIds(scratch_dir(spark, "seen"), live.REPEAT_KEYS) if any_distance else None
    words = [f"word{i}" for i in range(40)]
    pickups = spark.createDataFrame([(w, [w]) for w in [*words, "edited"]] + [(None, ["word0"])], "id string, topics array<string>")
    text = " ".join(words) + " " + "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    for rows in ([(1, 1000, text, "en"), (1, 1000, text, "en"), (2, 2000, "word1 here", "en")], [(1, 1000, text, "en"), (1, 3000, "word1 edited", "en"), (3, 4000, "word2", "fr")]):
        _statuses(spark, rows, source)
        stream = live.open_stream(spark, "parquet", source, "value string, lang string")
        query = live.stream_ingest(stream, pickups, fx.aliases(spark), ["en", "fr"], tweets, sent, mark, once=True, seen=store)
        query.awaitTermination()
        assert len(query.lastProgress["sources"]) == 1  # keys and texts come from one reading of the source's offsets
    want = sorted([(1, t, text, 1000) for t in [*words, "None"]] + [(1, "edited", "word1 edited", 3000), (2, "word1", "word1 here", 2000), (3, "word2", "word2", 4000)])
    got = sorted((r.tweet_id, str(r.topic), r.tweetText, r.createdAt) for r in tables.read_table(spark, tweets).collect())
    assert got == want
    assert sorted((r.key or "None", r.value) for r in tables.read_table(spark, sent).collect()) == sorted((t, x) for _, t, x, _ in want)
    size = sum(f.stat().st_size for f in Path(tweets).glob("batch_id=*/*.parquet"))
    assert size < 40_000  # a text of 13,000 packed bytes on 41 topics


def test_batch_that_runs_again_repeats_nothing_downstream(spark):
    from pathlib import Path

    source, tweets, sent, mark, scored, scored_mark = (scratch_dir(spark, x) for x in ("statuses", "tweets", "sent", "mark", "scored", "mark2"))
    lexicons = fx.lexicons(spark)

    def downstream():
        live.stream_score(live.open_stream(spark, "parquet", sent, MESSAGE), lexicons, scored, scored_mark, once=True).awaitTermination()
        return tables.read_table(spark, scored).count()

    _statuses(spark, [(1, 1000, "a good day", "en"), (2, 1000, "so happy", "fr")], source)
    _ingest(spark, source, tweets, sent, mark)
    assert downstream() == 2
    for commit in Path(mark, "commits").iterdir():  # as if the driver had died before it noted the batch
        commit.unlink()
    _ingest(spark, source, tweets, sent, mark)
    assert tables.read_table(spark, tweets).count() == 2
    assert downstream() == 2


def test_scored_stream_restarts_without_repeats(spark):
    source, out, mark = (scratch_dir(spark, label) for label in ("source", "scored", "mark"))
    lexicons = fx.lexicons(spark)

    def feed(rows):
        frame = spark.createDataFrame(rows, "key string, value string").withColumn(
            "timestamp", F.timestamp_seconds(F.lit(100))
        )
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = live.open_stream(spark, "parquet", source, MESSAGE)
        live.stream_score(stream, lexicons, out, mark, once=True).awaitTermination()

    feed([("a", "a great happy good day."), ("a", "a great happy good day."), ("b", "Bad. An awful bad film.")])
    feed([("c", "nothing here")])
    rows = tables.read_table(spark, out).collect()
    assert sorted((r.key, r.sentiment, r.code) for r in rows) == [
        ("a", "SUPER_NICE", 4), ("a", "SUPER_NICE", 4), ("b", "TERRIBLE", 0), ("c", "NEUTRAL", 2)
    ]


def test_realtime_filter(spark):
    pickups = spark.createDataFrame([("a", True), ("b", False)], "id string, isRT boolean")
    frame = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, value string")
    assert [r.key for r in live.realtime_only(frame, pickups).collect()] == ["a"]
