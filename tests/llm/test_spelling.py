"""Spelling variants against plain comparison of all words, and the registered query against plain Python."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from tonewise.llm import spelling
from tonewise.llm.words import text_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    return (out | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def counted(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(words):
    letters, out = sorted({c for w in words for c in w}), {}
    for word, n in words.items():
        near = [v for v in edits(word, letters) if v in words]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[word] = [n, len(near), form, words[form] if form else None]
    for word, row in out.items():
        root = word
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def result(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op12_spelling_variants"](spark, f"/root/testdata/{sf}")
    assert set(got.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
    want = brute(counted(rows))
    assert len(want) > 100 and result(got) == want


def variants(seed, letters, size, longest):
    rng = random.Random(seed)
    words = {}
    for _ in range(size // 6):
        base = "".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 8, longest])))
        words[base] = rng.randint(5, 5000)
        for _ in range(5):
            base = rng.choice(list(edits(base, letters)))
            if len(base) >= 6:
                words[base] = rng.choice([5, 6, 25, 30, 125, 600])
    return words


@pytest.mark.parametrize("block", [1 << 15, 7])
@pytest.mark.parametrize("letters,longest", [("ab", 9), ("aé÷z", 12), ("abcdefghij", 300)])
def test_forms_of_any_vocabulary(spark, monkeypatch, block, letters, longest):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    words = variants(block, letters, 400, longest)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert result(spelling.forms(df)) == brute(words)


def test_lanes_of_a_hot_group():
    rng = random.Random(9)
    words = {"common" + "".join(rng.choice("abc") for _ in range(rng.choice([6, 7]))): rng.randint(5, 99) for _ in range(1500)}
    rows = [(w, n, a) for w, n in words.items() for a in (12, 13) if len(w) == a or len(w) == a + 1]
    table = pa.table({"word": [w for w, _, _ in rows], "n": [n for _, n, _ in rows], "a": pa.array([a for _, _, a in rows], pa.int32()), "second": [False] * len(rows), "role": pa.array([3] * len(rows), pa.int32()), "piece": [a for _, _, a in rows]})
    got = collections.Counter()
    for r in spelling._neighbours(table).to_pylist():
        got[r["word"]] += r["n_near"]
    assert got == {w: r[1] for w, r in brute(words).items() if r[1]}


def test_checksums_and_runs():
    texts = ["", "Éa×BĀc×d", "x" * 3000, "a1b c", "¿ÿ"]
    data, offsets = text_bytes(pa.array(texts))
    starts, ends, rows = spelling.runs_of(data, offsets)
    got = [(int(r), data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows)]
    assert got == [(i, m) for i, t in enumerate(texts) for m in RUN.findall(t)]
    begun = np.array([zlib.crc32(f"{r}:".encode()) for r in rows], np.uint32)
    assert spelling.checksums(data, starts, ends, begun).tolist() == [zlib.crc32(f"{r}:{w}".encode()) for r, w in got]


def test_odd_tables(spark):
    rng = random.Random(3)
    base = ["Receive", "receives", "recieve", "RECEIVE", "naïveté", "naivete", "été", "a" * 4000, "a" * 3999, "straße"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", " ".join(rng.choices(base, k=rng.randint(0, 30)))])) for _ in range(500)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "w", 2) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = result(spelling.forms(spelling.vocabulary(df)))
    assert got == brute(counted(rows)) and any(len(w) > 3000 for w in got)
    assert spelling.forms(spelling.vocabulary(df.where("false"))).count() == 0
