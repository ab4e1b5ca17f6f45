"""Line removal against plain Python: whole tables, batches, levels of runs and odd texts."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from tests.compare import compare, duck
from tonewise.llm import lines

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_chars=20, least_docs=3):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    number = lambda i: lines._FIRST if i is None else i
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(number(i))
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if len(holders.get(key(p), ())) < least_docs or max(holders[key(p)]) == number(i)]
        out.append((i, None if text is None else "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()], key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_twin(spark, sf):
    sf = f"/root/testdata/{sf}"
    status, rows, _, _ = compare(spark, duck(sf), "op11_line_dedup", sf)
    assert status == "ok" and rows > 0
    assert entry.queries()["op11_line_dedup"](spark, sf).agg({"n_dropped": "sum"}).first()[0] > 0


LINE = st.text(alphabet="aAé \t\x0b\x0c\r\x85b", max_size=5)
TEXT = st.one_of(st.none(), st.lists(LINE, max_size=5).map("\n".join))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(0, 4))
def test_lines_of_a_chunk(texts, least):
    got = []
    for first, found in lines.line_chunks(pa.array(texts, pa.string()), least):
        got += [(first + int(r), found.data[a:b].tobytes().decode(), bool(x), int(h), int(w)) for r, a, b, x, h, w in zip(found.rows, found.left, found.right, found.long, found.high, found.low)]
    want = [(i, p.strip(SPACES)) for i, t in enumerate(texts) for p in (t or "").split("\n")]
    assert [(r, k) for r, k, _, _, _ in got] == want
    assert all(x == (len(k) >= max(least, 1)) for _, k, x, _, _ in got)
    names = {}
    for _, k, _, *h in got:
        assert names.setdefault(k.translate(LOWER), h) == h
    assert len({tuple(h) for h in names.values()}) == len(names)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.randoms())
def test_text_without_lines(texts, rng):
    column = pa.array(texts, pa.string())
    for first, found in lines.line_chunks(column, 1):
        gone = np.array([rng.random() < 0.5 for _ in found.rows], bool)
        kept = [[] for _ in texts]
        for r, a, b, g in zip(found.rows, found.starts, found.ends, gone):
            if not g:
                kept[r].append(found.data[a:b].tobytes().decode())
        got = lines._without(found, gone, column).to_pylist()
        assert got == [None if t is None else "\n".join(k) for t, k in zip(texts, kept)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(-3, 9)), max_size=12), max_size=30), st.integers(1, 4))
def test_levels_keep_the_largest_documents(batches, most):
    levels = lines.Levels(most)
    for batch in batches:
        levels.add(lines.compacted([np.array(batch, lines.ENTRY)], most))
        assert all(len(level) < lines.FANOUT for level in levels.levels)
    want = collections.defaultdict(set)
    for high, low, doc in {x for b in batches for x in b}:
        want[high, low].add(doc)
    assert levels.all().tolist() == [(h, w, d) for (h, w), docs in sorted(want.items()) for d in sorted(docs, reverse=True)[:most]]


def odd_rows(seed, n):
    rng = random.Random(seed)
    pool = ["", " ", "short", "Subscribe to our newsletter now", "subscribe TO our newsletter now \t", "é" * 19, "É" * 20, "é" * 20, "x" * 70_000, "\r", *[f"a line that stands only {i} times here" for i in range(30)]]
    text = lambda: rng.choice([None, "", "\n", "\n".join(rng.choices(pool, k=rng.randint(1, 9)))])
    return [(rng.choice([None, *range(-5, 60)]), text()) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, n_lines int, shard string")


def test_odd_tables(spark):
    rows = odd_rows(1, 200)
    rows += rows[:30]
    assert result(lines.dedupe(frame(spark, rows).repartition(5))) == brute(rows)
    assert result(lines.dedupe(frame(spark, rows), least_chars=1, least_docs=1)) == brute(rows, 1, 1)
    assert lines.dedupe(frame(spark, rows).where("false")).count() == 0
    assert "shard" in lines.dedupe(frame(spark, rows)).columns


def test_batches_in_any_order_and_twice(spark):
    rows = odd_rows(2, 240)
    whole = frame(spark, rows)
    index = lines.LineIndex(spark, 3)
    for i in (4, 0, 3, 1, 2, 3, 5):
        index.add(frame(spark, rows[i * 40 : i * 40 + 40]))
    assert result(index.dedupe(whole)) == brute(rows)


def test_a_lost_run_is_an_error(spark):
    import pathlib

    index = lines.LineIndex(spark, 1)
    index.add(frame(spark, odd_rows(3, 60)))
    next(pathlib.Path(index.folder).glob("run-*")).unlink()
    with pytest.raises(Exception, match="run-"):
        index.settled()
