"""Language profiles, order statistics, metrics and query documents against plain Python and DuckDB."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewise.operators import joins, language, metrics, order, querydocs
from tonewise.operators.splits import Weights, split_sizes

# --- languages


def test_trigrams_as_rows_are_those_of_the_array(spark):
    """Any letters, repeats, no letters, no text: the rows hold the same trigrams as often, and are cut in generated code."""
    rows = [(1, "The the, l'été ÀÉ"), (2, "12 !"), (3, None), (4, "a"), (5, ""), (None, "😀x日本語 x"), (5, "the"), (5, "the")]
    frame = spark.createDataFrame(rows, "k long, t string")
    got = language.gram_rows(frame, "k", "t")
    want = frame.select("k", F.explode(language.trigrams(F.col("t"))).alias("_gram"))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))
    assert want.count() > 20
    profiles = language.language_profiles(frame.withColumn("l", F.lit("en")), ["en"], "t", "l")
    scores = language.language_scores(frame, profiles, ["en"], "k", "t")
    for plan in (profiles, scores):
        assert "lambdafunction" not in plan._jdf.queryExecution().optimizedPlan().toString()


def _grams(text):
    words = [f" {w} " for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    return [w[i : i + 3] for w in words for i in range(len(w) - 2)]


TEXTS = {
    "en": ["the cat and the dog", "this is the house that he had", "with the wind", "THE END"],
    "fr": ["le chat et la souris", "c'est une maison", "avec le vent", "où est-ce que tu es"],
    "es": ["el gato y la casa", "esta es una señora", "con el viento", "¿dónde está?"],
}


@pytest.mark.parametrize("limit", [200_000, 1])
def test_scores_equal_plain_sums(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    codes = ("en", "es", "fr")
    learnt = [(code, t) for code, texts in TEXTS.items() for t in texts]
    asked = [(1, "the mouse"), (2, "la souris est où"), (3, ""), (4, None), (5, "1234 !!"), (6, "xyzzy qqq"), (7, "señora " * 3000), (8, "a")]
    profiles = language.language_profiles(spark.createDataFrame(learnt, "lenguage string, tweetText string"), codes)
    counts = {c: collections.Counter(g for code, t in learnt if code == c for g in _grams(t)) for c in codes}
    kinds = len({g for c in counts.values() for g in c})
    weight = lambda c, g: math.floor(math.log((counts[c][g] + 1) / (sum(counts[c].values()) + kinds)) * 10_000 + 0.5)
    want = {i: [sum(weight(c, g) for g in _grams(t)) for c in codes] for i, t in asked if _grams(t)}
    frame = spark.createDataFrame(asked, "tweet_id int, tweetText string")
    got = {r.tweet_id: list(r.scores) for r in language.language_scores(frame, profiles, codes).collect()}
    assert got == want
    named = {r.tweet_id: r.identified for r in language.identify(frame, profiles, codes).collect()}
    assert named == {i: codes[s.index(max(s))] for i, s in want.items()}
    assert (named[1], named[2], named[7]) == ("en", "fr", "es")
    kept = language.keep_languages(frame, profiles, codes, ["fr", "es"]).collect()
    assert {r.tweet_id: r.lenguage for r in kept} == {i: c for i, c in named.items() if c != "en"}


def test_long_texts_take_linear_time(spark):
    text = spark.range(4).select(F.col("id").alias("tweet_id"), F.expr("repeat('palabra ', 100000)").alias("tweetText"))
    profiles = language.language_profiles(spark.createDataFrame([("es", "palabra")], "lenguage string, tweetText string"), ["es"])
    assert language.identify(text, profiles, ["es"]).count() == 4


# --- order


def _ordered(rows, order_):
    for i, ascending in reversed(list(enumerate(a for _, a in order_))):
        # nulls first ascending, last descending; NaN above all numbers
        rows = sorted(rows, key=lambda r, i=i: (r[i] is not None, isinstance(r[i], float) and math.isnan(r[i]), 0 if r[i] is None or r[i] != r[i] else r[i]), reverse=not ascending)
    return rows


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("hot", [False, True])
def test_any_page_equals_the_sorted_one(spark, monkeypatch, ascending, hot):
    monkeypatch.setattr(order, "SORTED_ROWS", 40)
    rng = random.Random(8)
    value = lambda: rng.choice([None, 5.0, 5.0, math.nan, -0.5]) if hot else rng.choice([None, rng.random(), float(rng.randint(0, 3))])
    rows = [(value(), i) for i in rng.sample(range(10_000), 3000)]
    by = [("v", ascending), ("k", True)]
    df = spark.createDataFrame(rows, "v double, k int").repartition(6)
    want = [k for _, k in _ordered(rows, by)]
    for page in (0, 7, 100, 112, 149, 150, 400):
        got = [r.k for r in order.deep_page(df, page, 20, by).collect()]
        assert got == want[page * 20 : page * 20 + 20], page


def test_pages_of_text_and_of_rows_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(order, "SORTED_ROWS", 30)
    rng = random.Random(2)
    rows = [("".join(rng.choices("aé😀zZ", k=rng.randint(0, 4))),) for _ in range(900)]
    df = spark.createDataFrame(rows, "s string")
    got = [r.s for r in order.deep_page(df, 40, 20, [("s", True)]).collect()]
    assert got == sorted((s for (s,) in rows), key=lambda s: s.encode())[800:820]
    same = spark.range(500).select(F.lit(1).alias("s"))
    assert order.deep_page(same, 3, 10, [("s", True)]).count() == 10
    assert order.deep_page(same.where("false"), 3, 10, [("s", True)]).count() == 0


def test_a_deep_page_reads_and_sorts_a_few_ranges_only(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(400_000).select(F.xxhash64("id").alias("v"), "id").write.parquet(path)
    few, offset = order.narrowed(spark.read.parquet(path), [("v", False), ("id", True)], 300_000, 100)
    assert few.count() <= max(order.SORTED_ROWS, 2 * 400_000 / 32) and 0 <= offset < few.count()
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(v", few._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("weights", [Weights(0.6, 0.2, 0.2), Weights(0.1, 0.0, 0.33), Weights(0, 0, 1)])
@pytest.mark.parametrize("n", [0, 1, 7, 2000])
def test_exact_splits(spark, weights, n):
    df = spark.range(n).select((F.col("id") * 7).alias("tweet_id")).repartition(5)
    got = order.split_exact(df, weights, seed=3)
    parts = collections.Counter(r.split for r in got.collect())
    sizes = split_sizes(df, weights).first()
    assert (parts["train"], parts["validation"], parts["classify"]) == tuple(sizes)
    digest = lambda i: (int(hashlib.md5(f"{i}:3".encode()).hexdigest()[:8], 16), i)
    want = sorted((7 * i for i in range(n)), key=digest)
    assert {r.tweet_id for r in got.where("split = 'train'").collect()} == set(want[: sizes.train])


def test_equal_hashes_are_split_by_key(spark, monkeypatch):
    monkeypatch.setattr(order, "hash_of", lambda key, seed: F.col(key) % 3 + 4_000_000_000)
    got = order.split_exact(spark.range(90).select(F.col("id").alias("tweet_id")), Weights(0.5, 0.25, 0.25))
    want = sorted(range(90), key=lambda i: (i % 3, i))
    assert sorted(r.tweet_id for r in got.where("split = 'train'").collect()) == sorted(want[:45])
    assert got.where("split = 'validation'").count() == 22 and got.where("split IS NULL").count() == 1


# --- metrics


def test_metrics_of_small_tables(spark):
    rows = [(0.0, 0.0)] * 3 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] + [(2.0, 0.0)] + [(None, 1.0), (1.0, None)] + [(5.0, 7.0)]
    frame = spark.createDataFrame(rows, "label double, prediction double")
    got = {r["class"]: r for r in metrics.class_metrics(metrics.confusion_matrix(frame)).collect()}
    assert (got[0.0].precision, got[0.0].recall, got[0.0].f1) == (3 / 4, 3 / 5, 6 / 9)
    assert (got[2.0].precision, got[2.0].recall, got[2.0].f1) == (None, 0.0, None)
    assert (got[7.0].precision, got[7.0].recall, got[7.0].support) == (0.0, None, 0)
    total = metrics.overall_metrics(metrics.confusion_matrix(frame)).first()
    assert total.accuracy == 4 / 8 and total.weighted_recall == pytest.approx(4 / 8)
    assert metrics.class_metrics(metrics.confusion_matrix(frame.where("false"))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_area_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 1, None]), rng.choice([None, float("nan"), 0.0, -0.0, rng.randint(-40, 40) / 8, rng.random()])) for _ in range(1200)]
    frame = spark.createDataFrame(rows, "label int, score double").repartition(4)
    kept = [(y, s) for y, s in rows if y is not None and s is not None and s == s]
    up, down = [s for y, s in kept if y == 1], [s for y, s in kept if y == 0]
    wins = sum((a > b) + (a == b) / 2 for a in up for b in down)
    got = metrics.area_under_curve(metrics.score_histogram(frame)).first()
    assert (got.p, got.n) == (len(up), len(down)) and got.auc == pytest.approx(wins / len(up) / len(down), abs=1e-12)


def test_area_needs_both_classes(spark):
    frame = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert metrics.area_under_curve(metrics.score_histogram(frame)).first().auc is None
    assert metrics.area_under_curve(metrics.score_histogram(frame.where("false"))).first().auc is None


# --- query documents

FIELDS = {"a": [None, -1, 0, 1, 2], "s": [None, "", "x", "y"], "n.b": [None, 0.5, 1.0, 2.5]}


def _sql(document):
    """The same document for DuckDB, three-valued logic written out."""
    sure = lambda t: f"coalesce({t}, false)"
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)

    def one(field, name, value):
        if name == "$not":
            return f"NOT ({all_of(field, value)})"
        if name in ("$ne", "$nin"):
            return f"NOT ({one(field, '$eq' if name == '$ne' else '$in', value)})"
        if name == "$exists":
            return f"{field} IS {'NOT ' if value else ''}NULL"
        if name == "$in":
            return "(" + " OR ".join([one(field, "$eq", v) for v in value] or ["false"]) + ")"
        if value is None:
            return f"{field} IS NULL"
        sign = {"$eq": "=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}[name]
        return sure(f"{field} {sign} {quoted(value)}")

    def all_of(field, tests):
        return "(" + " AND ".join([one(field, k, v) for k, v in tests.items()] or ["true"]) + ")"

    parts = []
    for name, value in document.items():
        if name in ("$and", "$or"):
            parts.append("(" + (" AND " if name == "$and" else " OR ").join(_sql(d) for d in value) + ")")
        elif name == "$nor":
            parts.append("NOT (" + " OR ".join(_sql(d) for d in value) + ")")
        else:
            parts.append(all_of(name, value) if isinstance(value, dict) else one(name, "$eq", value))
    return "(" + " AND ".join(parts or ["true"]) + ")"


def _tests(values):
    some = st.sampled_from([v for v in values if v is not None])
    compare = st.tuples(st.sampled_from(["$gt", "$gte", "$lt", "$lte"]), some)
    equal = st.tuples(st.sampled_from(["$eq", "$ne"]), st.sampled_from(values))
    within = st.tuples(st.sampled_from(["$in", "$nin"]), st.lists(st.sampled_from(values), max_size=3))
    flat = st.lists(st.one_of(compare, equal, within, st.tuples(st.just("$exists"), st.booleans())), min_size=1, max_size=2).map(dict)
    return st.one_of(st.sampled_from(values), flat, flat.map(lambda d: {"$not": d}))


_leaf = st.lists(st.sampled_from(sorted(FIELDS)).flatmap(lambda f: st.tuples(st.just(f), _tests(FIELDS[f]))), max_size=2).map(dict)
DOCUMENTS = st.recursive(_leaf, lambda d: st.tuples(_leaf, st.sampled_from(["$and", "$or", "$nor"]), st.lists(d, min_size=1, max_size=3)).map(lambda t: {**t[0], t[1]: t[2]}), max_leaves=5)


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(i, a, s, Row(b=b)) for i, (a, s, b) in enumerate((a, s, b) for a in FIELDS["a"] for s in FIELDS["s"] for b in FIELDS["n.b"])]
    schema = "id int, a int, s string, n struct<b double>"
    con = duckdb.connect()
    con.execute("CREATE TABLE grid (id INT, a INT, s VARCHAR, n STRUCT(b DOUBLE))")
    con.executemany("INSERT INTO grid VALUES (?, ?, ?, {'b': ?})", [(i, a, s, n.b) for i, a, s, n in rows])
    return spark.createDataFrame(rows, schema).coalesce(1).cache(), con


@settings(max_examples=60, deadline=None)
@given(DOCUMENTS)
def test_documents_mean_the_same_in_duckdb(grid, document):
    df, con = grid
    want = [r[0] for r in con.execute(f"SELECT id FROM grid WHERE {_sql(document)} ORDER BY id").fetchall()]
    assert sorted(r.id for r in querydocs.find(df, document).select("id").collect()) == want, document


def test_documents_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(50).select("id", F.struct(F.col("id").alias("b")).alias("n")).write.parquet(path)
    found = querydocs.find(spark.read.parquet(path), {"$or": [{"id": {"$gte": 7, "$lt": 9}}, {"n.b": {"$in": [1, 2]}}], "id": {"$ne": 8}})
    assert sorted(r.id for r in found.collect()) == [1, 2, 7]
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", found._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "GreaterThanOrEqual(id,7)" in pushed and "n.b" in pushed


def test_arrays_orders_and_errors(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None), (4, ["z"])], "id int, tags array<string>")
    ids = lambda d, **k: [r.id for r in querydocs.find(df, d, [("id", -1)], **k).collect()]
    assert ids({"tags": "x"}) == [1] and ids({"tags": {"$in": ["z", "y"]}}) == [4, 1]
    assert ids({"tags": {"$ne": "x"}}) == [4, 3, 2] and ids({}, limit=2) == [4, 3]
    for bad in ({"tagz": 1}, {"id": {"$near": 1}}, {"$where": 1}, {"$or": []}, {"id": {"$gt": None}}, {"id": {"$in": "12"}}, {"id.x": 1}):
        with pytest.raises(ValueError):
            querydocs.condition(bad, df.schema)
    with pytest.raises(ValueError):
        querydocs.find(df, {}, limit=1)
    assert isinstance(df.schema, T.StructType)
