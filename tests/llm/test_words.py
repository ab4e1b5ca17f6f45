"""Words, n-grams and stored hash arrays against plain Python."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonewise.llm import store
from tonewise.llm.words import chunks, grams, inside, mix, unmix, word_hash

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x0cé \x1fA", max_size=30)), max_size=8)


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    got = []
    for chunk in chunks(pa.array(texts, pa.string()), limit=limit):
        for i in range(chunk.rows):
            a, b = chunk.bounds[i], chunk.bounds[i + 1]
            got.append([(chunk.data[s:e].tobytes(), int(h)) for s, e, h in zip(chunk.starts[a:b], chunk.ends[a:b], chunk.hashes[a:b])])
    assert got == [[(w.encode(), int(word_hash(w.encode()))) for w in words(t)] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.integers(1, 5))
def test_grams_stay_in_rows_and_tell_apart(rows, n):
    (chunk,) = list(chunks(pa.array([" ".join(r) for r in rows], pa.string()))) or [None]
    if chunk is None:
        return
    at = inside(chunk.bounds, n)
    want = [tuple(r[i : i + n]) for r in rows for i in range(len(r) - n + 1)]
    hashes = grams(chunk.hashes, n)[at].tolist() if len(at) else []
    assert len(hashes) == len(want)
    names = dict(zip(want, hashes))
    assert [names[w] for w in want] == hashes and len(set(names.values())) == len(names)


def test_mix_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (unmix(mix(x)) == x).all()


def test_slices_and_large_strings():
    column = pa.array(["a b", None, "", "c d e"], pa.string())
    for part in (column.slice(1), column.slice(3), column.slice(0, 0), pa.chunked_array([column, column])):
        assert sum(len(c.hashes) for c in chunks(part)) == sum(len(words(t)) for t in part.to_pylist())


def test_arrays_are_merged_written_and_found(tmp_path):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2)
    keys = np.concatenate([keys, keys[:100]])
    values = rng.integers(0, 9, len(keys)).astype("i8")
    writer = store.Writer({"v": "i8"}, {"v": "add"}, 3, limit=50)
    sent = [b for a in range(0, len(keys), 40) if (b := writer.add(keys[a : a + 40], {"v": values[a : a + 40]})) is not None]
    sent += [b for b in [writer.flush()] if b is not None]
    table = pa.Table.from_batches(sent)
    for shard in range(8):
        rows = table.filter(pa.compute.equal(table["shard"], shard))
        key, got = store.reduced(rows, {"v": "i8"}, {"v": "add"})
        for _ in range(2):  # a repeated task
            store.write(str(tmp_path), "x", shard, {"key": key, **got})
    asked = np.concatenate([keys, np.array([1, 3], np.uint64)])
    found = store.lookup(str(tmp_path), "x", 3, asked, {"v": "i8"}, {"v": -1})
    want = {int(k): int(values[keys == k].sum()) for k in np.unique(keys)}
    assert found["v"].tolist() == [want.get(int(k), -1) for k in asked]
    assert found["found"].tolist() == [int(k) in want for k in asked]
    assert len(list(tmp_path.iterdir())) == 8  # a file a shard
    (tmp_path / "x-0000003").unlink()
    store._open.clear()
    with pytest.raises(FileNotFoundError):
        store.lookup(str(tmp_path), "x", 3, asked, {"v": "i8"}, {"v": -1})


def test_many_shards_need_few_handles(tmp_path):
    """Two thousand shards of three columns under a limit of 256 handles, in a process of its own."""
    code = f"""
import resource, numpy as np
from tonewise.llm import store
keys = np.sort(np.random.default_rng(1).integers(0, 2**64 - 1, 40_000, dtype=np.uint64))
for shard, part in enumerate(np.split(keys, np.searchsorted(keys, np.arange(1, 2048, dtype=np.uint64) << np.uint64(53)))):
    store.write({str(tmp_path)!r}, "t", shard, {{"key": part, "a": np.arange(len(part), dtype="u1"), "b": part.astype("f8")}})
resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
for _ in range(2):
    got = store.lookup({str(tmp_path)!r}, "t", 11, keys, {{"a": "u1", "b": "f8"}}, {{"a": 0, "b": 0}})
    assert got["found"].all() and (got["b"] == keys.astype("f8")).all()
assert len(store._open) <= store.MAPS
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])


def test_every_shard_is_written_and_read(spark, tmp_path):
    packed = spark.createDataFrame([], store.schema({"v": "i8"}))
    assert store.build(packed, str(tmp_path), "none", 4, {"v": "i8"}, {"v": "add"}) == 0
    assert len(list(tmp_path.iterdir())) == 16
    got = store.lookup(str(tmp_path), "none", 4, np.arange(0, 2**63, 2**59, dtype=np.uint64), {"v": "i8"}, {"v": 7})
    assert not got["found"].any() and (got["v"] == 7).all()
