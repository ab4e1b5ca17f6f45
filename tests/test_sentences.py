"""The composed sentence model: forward and backward passes, barrier training, and what a bag of words can't learn."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewise.operators import sentences as sn
from tonewise.session import scratch_dir

SMALL = sn.SentenceSpec(buckets=64, size=5, rounds=3, batch=16, tasks=2)


def _plain(model, ids):
    """The tree of one sentence in plain Python."""
    p = model.params
    values = [list(p["words"][i]) for i in ids]
    d = len(values[0])
    while len(values) > 1:
        pairs = [values[i : i + 2] for i in range(0, len(values), 2)]
        values = [
            v[0] if len(v) == 1 else [math.tanh(sum(v[0][k] * p["left"][k][j] + v[1][k] * p["right"][k][j] for k in range(d)) + p["bias"][j]) for j in range(d)]
            for v in pairs
        ]
    scores = [sum(values[0][k] * p["out"][k][c] for k in range(d)) + p["out_bias"][c] for c in range(len(model.classes))]
    top = max(scores)
    e = [math.exp(s - top) for s in scores]
    return [x / sum(e) for x in e]


def _random(seed, n):
    rng = random.Random(seed)
    return [[rng.randrange(64) for _ in range(rng.randint(1, 11))] for _ in range(n)]


def _flat(rows):
    return np.array([i for r in rows for i in r]), np.array([len(r) for r in rows])


def test_forward_pass_equals_plain_python():
    model, rows = sn.SentenceModel.fresh((0.0, 1.0, 2.0), SMALL), _random(1, 40)
    got = model.probabilities(*_flat(rows))
    assert np.allclose(got, [_plain(model, r) for r in rows], atol=1e-12)


def test_gradients_equal_differences():
    model, rows = sn.SentenceModel.fresh((0.0, 1.0, 2.0), SMALL), _random(2, 6)
    ids, sizes = _flat(rows)
    labels = np.array([0, 1, 2, 0, 1, 2])
    _, grads = model.gradients(ids, sizes, labels)
    rng = np.random.default_rng(0)
    for name in ("words", "left", "right", "bias", "out", "out_bias"):
        value = model.params[name]
        for _ in range(6):
            at = (rng.choice(grads["rows"]), rng.integers(5)) if name == "words" else tuple(rng.integers(n) for n in value.shape)
            kept, losses = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = kept + step
                losses.append(model.gradients(ids, sizes, labels)[0])
            value[at] = kept
            mine = grads[name][np.searchsorted(grads["rows"], at[0]), at[1]] if name == "words" else grads[name][at]
            assert mine == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-5), name


def _labelled(spark, n):
    """Good and bad turned round by "not": no sum of word weights can tell these apart."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        negated, good = rng.random() < 0.5, rng.random() < 0.5
        words = ["it", "is", *(["not"] if negated else ["so"]), "good" if good else "bad", rng.choice(["today", "here", "now"])]
        rows.append((i, " ".join(words), float(good != negated)))
    return spark.createDataFrame(rows, "tweet_id int, sentence string, label double").repartition(3)


def test_learns_negation_and_scores_like_plain_python(spark):
    rows = _labelled(spark, 600)
    spec = sn.SentenceSpec(buckets=128, size=8, rounds=15, batch=8, tasks=3)
    model = sn.train_sentences(rows.where("tweet_id < 400"), (0.0, 1.0), spec)
    scored = sn.score_sentences(rows, model, ("tweet_id", "label")).collect()
    held = [r for r in scored if r.tweet_id >= 400]
    assert sum(r.prediction == r.label for r in held) / len(held) > 0.97
    ids = {r.tweet_id: r.ids for r in rows.select("tweet_id", sn.word_ids(F.col("sentence"), 128).alias("ids")).collect()}
    for r in scored[:50]:
        want = _plain(model, ids[r.tweet_id])
        assert r.probability == pytest.approx(max(want)) and r.prediction == want.index(max(want))


def test_tasks_make_the_model_of_one_task(spark):
    """With one batch a round the average over tasks is the step along the gradient of all rows."""
    rows = _labelled(spark, 60)
    spec = lambda tasks: sn.SentenceSpec(buckets=64, size=4, rounds=4, batch=60, tasks=tasks)
    one, four, again = (sn.train_sentences(rows, (0.0, 1.0), spec(t)) for t in (1, 4, 4))
    for name in one.params:
        assert np.allclose(one.params[name], four.params[name], atol=1e-9)
        assert (four.params[name] == again.params[name]).all()


def test_few_rows_and_odd_ones(spark):
    rows = spark.createDataFrame([(1, "good", 1.0), (2, None, 0.0), (3, "", 0.0), (4, "good", 5.0), (5, "x " * 5000, 1.0)], "tweet_id int, sentence string, label double")
    model = sn.train_sentences(rows, (0.0, 1.0), SMALL)
    got = {r.tweet_id: r.prediction for r in sn.score_sentences(rows, model).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[2] == got[3] and got[1] == got[4]
    assert sn.score_sentences(rows.where("false"), model).count() == 0
    with pytest.raises(ValueError):
        sn.train_sentences(rows, (7.0,), SMALL)


def test_stored_models_score_alike(spark):
    model, path = sn.SentenceModel.fresh((0.0, 2.0), SMALL), scratch_dir(spark, "model")
    sn.save_sentences(model, spark, path)
    loaded = sn.load_sentences(spark, path)
    assert loaded.classes == model.classes and all((loaded.params[k] == v).all() for k, v in model.params.items())


def test_a_bounded_draw_is_learnt_from(spark):
    rows = _labelled(spark, 500)
    spec = sn.SentenceSpec(buckets=64, size=4, rounds=1, batch=500, tasks=2, most_rows=100)
    few = sn.train_sentences(rows, (0.0, 1.0), spec)
    again = sn.train_sentences(rows.repartition(7), (0.0, 1.0), spec)
    assert all((few.params[k] == again.params[k]).all() for k in few.params)
