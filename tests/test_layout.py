"""Stored documents, topic intervals and laid-out tables."""

from __future__ import annotations

import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tonewise.schemas import MESSAGE
from tonewise.session import scratch_dir
from tonewise.sources import documents, layout, tables
from tonewise.streaming import intervals, live


def _lines(spark, docs):
    return spark.createDataFrame([(d if d is None or isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def test_fields_in_all_their_shapes(spark):
    shapes = [5, 5.0, "5", "+5", {"$numberLong": "5"}, {"$numberInt": "5"}, 5.5, "5.5", "x", True, None, [5], {"n": 5}, 9_000_000_000, -(2**63), 2**63, "99999999999999999999", 1e300, ""]
    want = [5, 5, 5, 5, 5, 5, None, None, None, None, None, None, None, 9_000_000_000, -(2**63), None, None, None, None]
    d = F.col("document")
    rows = documents.parsed(_lines(spark, [{"v": v} for v in shapes])).select(documents.number(d, "$.v").alias("n"), documents.number(d, "$.v", "int").alias("i"))
    got = rows.collect()
    assert [r.n for r in got] == want
    assert [r.i for r in got] == [v if v is not None and abs(v) < 2**31 else None for v in want]


def test_ids_flags_and_locations(spark):
    d = F.col("document")
    ids = documents.parsed(_lines(spark, [{"_id": v} for v in ("a", {"$oid": "b"}, 7, None, {"x": 1}, ["c"])])).select(documents.object_id(d, "$._id").alias("v"))
    assert [r.v for r in ids.collect()] == ["a", "b", None, None, None, None]
    flags = documents.parsed(_lines(spark, [{"f": v} for v in (True, False, 1, 0, "true", "FALSE", "yes", None)])).select(documents.flag(d, "$.f").alias("v"))
    assert [r.v for r in flags.collect()] == [True, False, True, False, True, False, None, None]
    places = [
        {"l": {"latitude": 1, "longitude": 2.5}}, {"l": {"latitude": 1}}, {"l": {"coordinates": [3, 4]}}, {"l": {"coordinates": [3]}},
        {"l": {"latitude": 99, "longitude": 0}, "g": {"latitude": 5, "longitude": 6}}, {"l": "here"}, {},
    ]
    found = documents.parsed(_lines(spark, places)).select(documents.location(d, "$.l", "$.g").alias("v"))
    assert [r.v and tuple(r.v) for r in found.collect()] == [(1.0, 2.5), None, (4.0, 3.0), None, (5.0, 6.0), None, None]


def test_broken_lines_are_counted_not_fatal(spark):
    docs = [None, "", "{", "[1]", "3", "null", {}, {"tweet_id": 1}, {"tweet_id": 1, "tweetText": 4}, {"tweet_id": 1, "tweetText": "ok"}, {"tweetText": "x"}]
    assert documents.tweets_of(_lines(spark, docs)).count() == 1
    counted = {r.reason: r.n for r in documents.rejected(_lines(spark, docs)).collect()}
    assert counted == {"no document": 6, "no id": 2, "no text": 2}


def _at(rows, names):
    return lambda spark: spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n in ('timestamp', 'opens', 'closes') else 'string'}" for n in names)).select(
        *[F.timestamp_seconds(n).alias(n) if n in ("timestamp", "opens", "closes") else n for n in names]
    )


def _messages(spark, rows):
    return _at([(k, v, float(t)) for k, v, t in rows], ("key", "value", "timestamp"))(spark)


def _spans(spark, rows):
    return _at([(t, float(a), float(b)) for t, a, b in rows], ("topic", "opens", "closes"))(spark)


def test_topics_open_and_close_while_the_stream_runs(spark):
    sent, spans, out, mark = (scratch_dir(spark, x) for x in ("sent", "spans", "out", "mark"))

    def run(messages, opened):
        _messages(spark, messages).coalesce(1).write.mode("append").parquet(sent)
        _spans(spark, opened).coalesce(1).write.mode("append").parquet(spans)
        intervals.stream_followed(
            live.open_stream(spark, "parquet", sent, MESSAGE), live.open_stream(spark, "parquet", spans, intervals.INTERVAL), out, mark, once=True, longest="10 minutes"
        ).awaitTermination()

    run([("a", "before", 99), ("a", "first", 100), ("a", "in", 150), ("b", "unknown", 150)], [("a", 100, 200)])
    run([("a", "last", 199.5), ("a", "end", 200), ("a", "after", 230), ("c", "early", 240)], [])
    run([("a", "again", 260), ("c", "open", 255)], [("c", 235, 300), ("a", 250, 270), ("b", 400, 300)])
    run([("c", "closed", 300), ("b", "never", 390)], [])
    got = sorted(r.value for r in tables.read_table(spark, out).collect())
    assert got == ["again", "early", "first", "in", "last", "open"]


def test_old_intervals_leave_the_state(spark):
    sent, spans, out, mark = (scratch_dir(spark, x) for x in ("sent", "spans", "out", "mark"))
    for i in range(5):
        _messages(spark, [("a", f"m{i}", 9000 + 1000 * i + 5)]).write.mode("append").parquet(sent)
        _spans(spark, [("a", 9000 + 1000 * i, 9000 + 1000 * i + 50)]).write.mode("append").parquet(spans)
        query = intervals.stream_followed(
            live.open_stream(spark, "parquet", sent, MESSAGE), live.open_stream(spark, "parquet", spans, intervals.INTERVAL), out, mark, once=True, longest="1 minute"
        )
        query.awaitTermination()
    rows = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert rows and rows[-1] <= 4
    assert tables.read_table(spark, out).count() == 5


def test_overlapping_intervals_are_joined(spark):
    rows = [("a", 1, 5), ("a", 4, 8), ("a", 8, 9), ("a", 20, 30), ("a", 21, 22), ("b", 1, 2), ("b", 3, 3), ("a", 25, 26)]
    got = sorted((r.topic, int(r.opens.timestamp()), int(r.closes.timestamp())) for r in intervals.distinct_intervals(_spans(spark, rows)).collect())
    assert got == [("a", 1, 9), ("a", 20, 30), ("b", 1, 2)]
    messages = _messages(spark, [("a", "x", 4.5), ("a", "y", 9), ("b", "z", 1)])
    passed = intervals.in_interval(messages, intervals.distinct_intervals(_spans(spark, rows)))
    assert sorted(r.value for r in passed.collect()) == ["x", "z"]


@pytest.fixture()
def stored(spark):
    names = [f"{x}_{uuid.uuid4().hex}" for x in ("tweets", "results")]
    rows = spark.range(3000).select(F.col("id").alias("tweet_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.least(F.col("id") % 7, F.lit(4)))).alias("topic"))
    layout.write_by_topic(rows, names[0], buckets=4)
    layout.write_results_by_tweet(rows.select("tweet_id", (F.col("tweet_id") % 5 / 4).alias("result")), names[1], buckets=4)
    yield names
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_topic_is_one_folder(spark, stored):
    one = layout.topic_rows(spark, stored[0], "t2")
    assert re.search(r"PartitionFilters: \[[^]]*topic#\d+ = t2", _plan(one))
    assert one.count() == sum(1 for i in range(3000) if i % 3 > 0 and min(i % 7, 4) == 2)
    assert spark.table(stored[0]).where("topic IS NULL").count() == 1000


def test_topics_chosen_at_run_time_prune_folders(spark, stored):
    chosen = spark.createDataFrame([("t1", True), ("t4", True), ("t2", False), (None, True)], "id string, isRT boolean").where("isRT = true and id > 't0'")
    rows = layout.rows_of_topics(spark, stored[0], chosen)
    assert {r.topic for r in rows.select("topic").distinct().collect()} == {"t1", "t4"}
    assert "dynamicpruning" in _plan(rows)


def test_bucketed_join_has_no_shuffle_of_rows(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tally = layout.tally_by_topic(spark, *stored, "nlp")
        got = {r.topic: (r.positive, r.negative, r.neutral) for r in tally.collect()}
        plan = _plan(tally)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "hashpartitioning(tweet_id" not in plan
    values = [(f"t{min(i % 7, 4)}" if i % 3 else None, i % 5 / 4) for i in range(3000)]
    assert got == {t: (sum(x == t and v > 0.6 for x, v in values), sum(x == t and v < 0.4 for x, v in values), sum(x == t and 0.4 <= v <= 0.6 for x, v in values)) for t in {x for x, _ in values}}
