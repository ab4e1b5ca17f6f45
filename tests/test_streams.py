"""Seen ids at any distance and event-time windows over several batches."""

from __future__ import annotations

import collections
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tonewise.session import scratch_dir
from tonewise.sources import tables
from tonewise.streaming import live, seen, windows
from tonewise.streaming.batches import batch_ids
from tonewise.workload import fixtures as fx

KEYS = "a long, b string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{KEYS}, n int")


def _batches(seed, n):
    rng = random.Random(seed)
    return [[(rng.choice([None, *range(90)]), rng.choice([None, "x", "y"])) for _ in range(60)] for _ in range(n)]


def _expected(batches):
    met, out = set(), []
    for rows in batches:
        fresh = set(rows) - met
        met |= fresh
        out.append(fresh)
    return out


@pytest.mark.parametrize("fold", [False, True])
def test_each_key_is_admitted_once_at_any_distance(spark, monkeypatch, fold):
    monkeypatch.setattr(seen, "IDS_PER_BUCKET", 20)  # several generations
    batches = _batches(5, 6)
    store = seen.SeenIds(scratch_dir(spark, "seen"), ("a", "b"), buckets=1, shards=3)
    for i, (rows, want) in enumerate(zip(batches, _expected(batches))):
        admitted = store.admit(_frame(spark, rows), i)
        got = [(r.a, r.b) for r in admitted.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        store.remember(admitted, i)
        store.remember(admitted, i)  # as if the batch had been run again
        again = store.admit(_frame(spark, rows), i)
        assert {(r.a, r.b) for r in again.collect()} == want
        if fold and i % 2:
            store.fold(spark, KEYS)
            store.prune(spark)
    ids = batch_ids(spark, f"{store.path}/{seen.IDS}")
    assert (len([i for i in ids if i >= 0]) <= 1 and min(ids) < 0) if fold else ids == list(range(6))
    generations = store._read(spark, seen.BITMAPS, store._live(spark, 99), seen._BITMAP).select("generation").distinct().count()
    assert generations > 1


def test_bitmaps_rule_new_keys_out_and_never_an_old_one(spark):
    store = seen.SeenIds(scratch_dir(spark, "seen"), ("a",), buckets=4)
    store.remember(spark.range(8000).select(F.col("id").alias("a")), 0)
    old = store.candidates(spark.range(8000).select(F.col("id").alias("a")), 1)
    new = store.candidates(spark.range(100_000, 120_000).select(F.col("id").alias("a")), 1)
    assert old.count() == 8000
    assert new.count() < 200


def test_only_the_shards_of_hits_are_read(spark):
    store = seen.SeenIds(scratch_dir(spark, "seen"), ("a",))
    store.remember(spark.range(1000).select(F.col("id").alias("a")), 0)
    plan = lambda a, b: store.admit(spark.range(a, b).select(F.col("id").alias("a")), 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*shard#\d+ = \d", plan(999, 1001))
    assert "shard" not in plan(2000, 2003)


def _statuses(spark, ids, source):
    lines = [(f'{{"id":{i},"createdAt":{i},"text":"a good day","user":{{"id":1,"name":"n","followersCount":1}}}}', "en") for i in ids]
    spark.createDataFrame(lines, "value string, lang string").coalesce(1).write.mode("append").parquet(source)


def test_stream_drops_a_repeat_of_a_batch_long_ago_and_of_a_batch_that_ran_twice(spark):
    source, tweets, sent, mark = (scratch_dir(spark, x) for x in ("statuses", "tweets", "sent", "mark"))
    store = seen.SeenIds(scratch_dir(spark, "seen"), live.REPEAT_KEYS)
    pickups = spark.createDataFrame([("t1", ["good day"]), ("t2", ["a day"])], "id string, topics array<string>")

    def run():
        stream = live.open_stream(spark, "parquet", source, "value string, lang string")
        live.stream_ingest(stream, pickups, fx.aliases(spark), ["en"], tweets, sent, mark, once=True, seen=store).awaitTermination()

    for ids in ([1, 2], [3], [4, 4], [1, 5], [2, 1, 6]):
        _statuses(spark, ids, source)
        run()
    for commit in Path(mark, "commits").iterdir():  # as if the driver had died before it noted the last batch
        commit.unlink()
    run()
    got = collections.Counter((r.tweet_id, r.topic) for r in tables.read_table(spark, tweets).collect())
    assert got == {(i, t): 1 for i in range(1, 7) for t in ("t1", "t2")}


def _scored(spark, rows):
    return spark.createDataFrame(rows, "key string, t double, code int").select(
        "key", F.timestamp_seconds("t").alias("timestamp"), "code"
    )


def _seconds(value):
    return None if value is None else int(value.timestamp())


def _windows(rows):
    return {(r.topic_id, _seconds(r.window_start)): (r.positive, r.negative, r.neutral) for r in rows.collect()}


def test_windows_close_once_and_late_rows_are_kept(spark):
    """Out-of-order batches against a plain reading of the rules, row by row."""
    rng = random.Random(11)
    batches = [[(rng.choice("aab"), 100 + 7 * i + rng.uniform(-25, 6), rng.randint(0, 4)) for _ in range(25)] for i in range(8)]
    batches[2].append(("a", None, 3))
    path, delay = scratch_dir(spark, "windows"), 10
    latest, counts, late, closed_at = None, collections.defaultdict(lambda: [0, 0, 0]), [], {}
    for i, rows in enumerate(batches):
        windows.store_windows(_scored(spark, rows), i, path, "10 seconds")
        windows.store_windows(_scored(spark, rows), i, path, "10 seconds")
        mark = None if latest is None else latest - delay
        for key, t, code in rows:
            end = None if t is None else t // 5 * 5 + 5
            if t is None or mark is not None and end <= mark:
                late.append((key, code, i))
            else:
                counts[key, int(end - 5)][0 if code >= 3 else 1 if code <= 1 else 2] += 1
        latest = max([t for _, t, _ in rows if t is not None] + ([latest] if latest else []))
        for key, start in counts:
            if start + 5 <= latest - delay:
                closed_at.setdefault((key, start), i)
        assert {(r.topic_id, _seconds(r.window_start)): r.batch_id for r in windows.closed_windows(spark, path).collect()} == closed_at
        assert _windows(windows.current_windows(spark, path)) == {k: tuple(v) for k, v in counts.items()}
    assert len(late) > 5 and len(closed_at) > 5
    assert collections.Counter((r.key, r.code, r.batch_id) for r in windows.late_rows(spark, path).collect()) == collections.Counter(late)
    state = windows.open_windows(spark, path)
    assert all(_seconds(r.window_end) > latest - delay for r in state.collect())


def test_windows_without_late_rows_equal_the_batch_tally(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), 1000 + i / 7 + rng.uniform(-4, 4), rng.randint(0, 4)) for i in range(700)]
    source, path, mark = (scratch_dir(spark, x) for x in ("scored", "windows", "mark"))
    for i in range(0, 700, 140):
        _scored(spark, rows[i : i + 140]).coalesce(1).write.mode("append").parquet(source)
        stream = live.open_stream(spark, "parquet", source, _scored(spark, rows).schema)
        windows.stream_windows(stream, path, mark, once=True, delay="20 seconds").awaitTermination()
    assert windows.late_rows(spark, path).count() == 0
    assert _windows(windows.current_windows(spark, path)) == _windows(live.window_tally(_scored(spark, rows)))


def test_an_empty_batch_moves_nothing(spark):
    path = scratch_dir(spark, "windows")
    windows.store_windows(_scored(spark, [("a", 100.0, 4)]), 0, path)
    windows.store_windows(_scored(spark, []), 1, path)
    assert _windows(windows.open_windows(spark, path)) == {("a", 100): (1, 0, 0)}
    assert windows.closed_windows(spark, path).isEmpty() and windows.late_rows(spark, path).isEmpty()


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, monkeypatch, parts):
    """A table may be a folder of part files; a stream over it takes every row, as a batch does, in any number of batches."""
    from tonewise.workload import streams

    if parts > 1:
        monkeypatch.setattr(streams, "BATCH", {"maxBytesPerTrigger": "1"})
    day = F.timestamp_seconds(F.lit(1704067200) + F.col("id")).cast("timestamp_ntz")
    tables_of = {
        "documents": spark.range(30).selectExpr("id AS doc_id", "concat('A happy day. Number ', id) AS text", "'en' AS lang", "concat('src', id % 30) AS source"),
        "events": spark.range(40).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), day.alias("ts"), F.col("id").cast("double").alias("value")),
        "customer": spark.range(6, 300, 30).selectExpr("id AS c_custkey", "-999.0D AS c_acctbal"),
    }
    for name, rows in tables_of.items():
        rows.repartition(parts).write.parquet(f"{tmp_path}/made/{name}")
        files = sorted(Path(f"{tmp_path}/made/{name}").glob("part-*"))
        target = Path(f"{tmp_path}/sf/{name}.parquet")
        target.parent.mkdir(exist_ok=True)
        if parts > 1:
            target.mkdir()
            for file in files:
                (target / file.name).write_bytes(file.read_bytes())
        else:
            target.write_bytes(files[0].read_bytes())
    sf = f"{tmp_path}/sf"
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    tweets = fx.tweets(spark, sf).select("topic", "tweetText")
    assert rows(streams.publish_stream(spark, sf)) == rows(tweets)
    assert rows(streams.stream_score(spark, sf)) == rows(streams.score_messages(spark, sf))
    assert rows(streams.stream_topic_filter(spark, sf)) == rows(tweets.where("topic = 'src6'"))
    assert rows(streams.stream_tally(spark, sf)) == rows(streams.batch_tally(spark, sf))


@pytest.mark.parametrize("topics", [1, 6])
def test_a_text_that_many_topics_follow_is_cut_once(spark, monkeypatch, topics):
    texts = ["good day. this is a very good day", "bad", "", None, "nothing here at all"]
    rows = [(f"t{i}", text, i) for text in texts for i in range(topics)]
    messages = spark.createDataFrame(rows, "key string, value string, n int").selectExpr("key", "value", "timestamp_seconds(n) AS timestamp")
    cut, whole = [], live._distinct_scores
    counted = lambda rows: rows.select("digest", "sentence").distinct()._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    monkeypatch.setattr(live, "_distinct_scores", lambda rows, lexicons: cut.append((rows.count(), counted(rows))) or whole(rows, lexicons))
    source, path = scratch_dir(spark, "messages"), scratch_dir(spark, "scored")
    messages.write.parquet(source)
    live.stream_score(live.open_stream(spark, "parquet", source, messages.schema), fx.lexicons(spark), path, scratch_dir(spark, "mark"), once=True).awaitTermination()
    assert cut == [(4, 1 if topics == 1 else 2)]  # with repeats, texts are distinct before they are cut
    got = spark.read.parquet(path).drop("batch_id")
    want = live.score_messages(messages, fx.lexicons(spark)).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4 * topics
