"""Operators over words against brute force: scoring, passages, near duplicates and rules."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewise.llm import jaccard, lm, rules, substrings
from tonewise.llm.words import mix

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, n_words string, id string"
SPECIAL = [None, "", " \n\t ", "one", "a b c", "A B c", "x " * 3000, "  \x1f é", "The end of it\nthe END of it"]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SHAPE).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# --- scoring


def brute_scores(train, rows):
    tokens = [[*words(lower(t)), None] for t in train]
    c, follow, pairs = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
    for t in tokens:
        c.update(t)
        for a, b in zip(["<s>", *t], t):
            pairs[a, b] += 1
            follow[a][b] += 1
    before = collections.Counter(b for _, b in pairs)
    n, v = sum(c.values()), len(c)
    d = lm.discounts(np.array([sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)]))
    e = lm.discounts(np.array([sum(x == k for x in before.values()) for k in (1, 2, 3, 4)]))
    total = len(pairs)

    def q(w):
        if not total:
            return 1 / (v + 1)
        free = sum(e[min(k, 3)] for k in before.values()) / total
        return max(before[w] - e[min(before[w], 3)], 0) / total + free / (v + 1)

    def p(a, w):
        held = sum(follow[a].values())
        if not held:
            return q(w)
        free = sum(d[min(k, 3)] for k in follow[a].values()) / held
        return max(pairs[a, w] - d[min(pairs[a, w], 3)], 0) / held + free * q(w)

    for doc, text in rows:
        t = [*words(lower(text)), None]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        yield doc, len(t), sum(c[w] > 0 for w in t), n, base, sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t)), p, c


def test_scores_equal_a_plain_model(spark, documents):
    rows = documents[:60] + [(-i, t) for i, t in enumerate(SPECIAL, 1)] + documents[:2]
    train = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    df = frame(spark, rows).withColumn("held_out", lm.held_out())
    model = lm.train(df.where(~F.col("held_out")))
    got = sorted(lm.score(df, model).collect())
    want = sorted(x[:6] for x in brute_scores(train, rows))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)


def test_probabilities_sum_to_one(documents):
    *_, p, c = next(brute_scores([t for _, t in documents[:30]], documents[:1]))
    for context in ("<s>", next(iter(c)), "never seen"):
        assert sum(p(context, w) for w in [*c, "an unseen word"]) == pytest.approx(1)


def test_frequent_first_words_are_spread(spark):
    rows = [(i, f"the w{i} the v{i % 7} the") for i in range(300)]
    df = frame(spark, rows)
    model = lm.train(df)
    assert len(model.hot) > 1
    for g, w in zip(sorted(lm.score(df, model).collect()), brute_scores([t for _, t in rows], rows), strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)


def test_scoring_without_training_text(spark):
    df = frame(spark, [(1, "a b"), (2, None)])
    got = {r["doc_id"]: r for r in lm.score(df, lm.train(df.where("false"))).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0
    assert got[1]["score"] == 0 == got[1]["base_score"] and got[2]["n_tokens"] == 1
    assert lm.score(df.where("false"), lm.train(df.where("false"))).count() == 0


# --- passages


def brute_dedupe(rows, window):
    big = float("inf")
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, big), big if d is None else d)
    for d, t in rows:
        w, d_ = words(t), big if d is None else d
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d_:
                gone.update(range(i, i + window))
        yield d, len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]


def check_dedupe(spark, rows, window):
    got = substrings.dedupe(frame(spark, rows), window=window)
    assert got.columns == ["doc_id", "text", "id", "n_words", "n_removed"]
    have = sorted(((r["doc_id"], r["n_words"], r["n_removed"], words(r["text"])) for r in got.collect()), key=str)
    assert have == sorted(brute_dedupe(rows, window), key=str)
    return got


@pytest.mark.parametrize(("window", "contexts"), [(4, 200), (4, 1), (7, 2), (50, 200)])
def test_passages_equal_brute_force(spark, monkeypatch, window, contexts):
    monkeypatch.setattr(substrings, "CONTEXTS", contexts)
    rng = random.Random(window * contexts)
    parts = [[rng.choice("abcdefgh") for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(parts)[rng.randint(0, 2) :] if rng.random() < 0.5 else [rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))]
        rows.append((i * 3 % 61, rng.choice([" ", "\n", "  "]).join(text)))
    rows += rows[:4] + [(None, rows[5][1]), (None, rows[6][1])] + [(-i, t) for i, t in enumerate(SPECIAL, 1)]
    check_dedupe(spark, rows, window)


def test_passages_of_the_given_table(spark, documents):
    got = check_dedupe(spark, documents, 50)
    digests = {r[0]: r[1] for r in got.select("doc_id", substrings.kept_digest(F.col("text"))).collect()}
    for d, _, _, kept in brute_dedupe(documents, 50):
        assert digests[d] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_passages_keep_null_and_untouched_texts(spark):
    rows = [(1, None), (2, "a  b\n\nc"), (3, "")]
    got = substrings.dedupe(frame(spark, rows), window=3).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == rows
    assert substrings.dedupe(frame(spark, []), window=3).count() == 0


def test_automaton_finds_earlier_windows():
    rng = random.Random(5)
    for _ in range(40):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 14))] for _ in range(6)]
        automaton, seen = substrings.Automaton(), set()
        for doc, text in enumerate(texts):
            want = [i + 4 for i in range(len(text) - 3) if tuple(text[i : i + 4]) in seen]
            assert list(automaton.matches(text, doc, 4)) == want
            automaton.add(text, doc)
            seen |= {tuple(text[i : i + 4]) for i in range(len(text) - 3)}


# --- near duplicates


def shingles(text, n):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_classes(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and None not in (rows[i][0], rows[j][0]) and den * both >= num * len(x | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), None if d is None else low[root(i)]) for i, (d, _) in enumerate(rows)]


def near_copies(rng, families, members, length):
    rows = []
    for _ in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(length)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = f"z{rng.randint(0, 10**6)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(i * 7 % 997, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [jaccard.BLOCK, 400])
@pytest.mark.parametrize(("num", "den"), [(85, 100), (1, 2)])
def test_classes_equal_brute_force(spark, block, num, den):
    rng = random.Random(block + num)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = near_copies(rng, 8, 6, 60) + [(2000 + i, f"{t} {passage}") for i, (_, t) in enumerate(near_copies(rng, 10, 3, 20))]
    rows += [(3000 + i, t) for i, t in enumerate(SPECIAL)] + [(None, rows[0][1])]
    got = [tuple(r) for r in jaccard.classes(frame(spark, rows), num=num, den=den, block=block).collect()]
    assert sorted(got, key=str) == sorted(brute_classes(rows, 4, num, den), key=str)


def test_classes_of_the_given_table(spark, documents):
    got = sorted(tuple(r) for r in jaccard.classes(frame(spark, documents)).collect())
    assert got == sorted(brute_classes(documents, 4, 85, 100))


def test_rows_that_share_an_id_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (9, text), (7, "alone here now then")]
    got = sorted(tuple(r) for r in jaccard.classes(frame(spark, rows)).collect())
    assert got == [(5, 27, 5), (5, 27, 5), (7, 1, 7), (9, 27, 5)]
    assert jaccard.classes(frame(spark, [])).count() == 0


def test_linked_sets_share_a_key_whatever_is_called_common():
    rng = np.random.default_rng(8)
    for num, den in ((85, 100), (1, 2), (9, 10)):
        parts = jaccard.Parts(num, den)
        for _ in range(400):
            n = int(rng.choice([6, 9, 14, 30, 80, 300]))
            x = np.unique(mix(rng.integers(0, 2**62, n).astype(np.uint64)))
            most = int(parts.differ(np.array([2 * n]))[0])
            drop = rng.permutation(n)[: rng.integers(0, most + 1)]
            y = np.unique(np.concatenate([np.delete(x, drop), mix(rng.integers(0, 2**62, rng.integers(0, most + 1)).astype(np.uint64))]))
            both = len(np.intersect1d(x, y))
            if den * both < num * (len(x) + len(y) - both) or (len(x) == len(y) == both):
                continue
            values, bounds = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
            hot = set(rng.permutation(x)[: rng.integers(0, n)].tolist())
            for common in (None, np.array([v in hot for v in values.tolist()])):
                keys, owners = parts.keys(values, bounds, common)
                assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())


def test_tree_keeps_every_link():
    rng = random.Random(3)
    rows = near_copies(rng, 12, 9, 40)
    sets = [np.unique(np.array([zlib.crc32(repr(s).encode()) for s in shingles(t, 4)], np.uint64)) for _, t in rows]
    got = jaccard.linked(np.array([d for d, _ in rows]), sets, 85, 100)
    assert got.tolist() == [c for _, _, c in brute_classes(rows, 4, 85, 100)]


def brute_links(rows, n, num, den):
    """For each row, how many other rows with an id it links with."""
    sets = [shingles(t, n) for _, t in rows]
    for i, (d, _) in enumerate(rows):
        near = (j for j, (e, _) in enumerate(rows) if j != i and e is not None and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]))
        yield None if d is None else sum(1 for _ in near)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 400])
def test_every_link_is_counted(spark, block):
    rng = random.Random(block)
    rows = near_copies(rng, 6, 14, 60)
    rows += rows[:9] + rows[:3] + [(4000 + i, t) for i, (_, t) in enumerate(rows[5:20])] + [(3000 + i, t) for i, t in enumerate(SPECIAL)] + [(None, rows[0][1])]
    got = [tuple(r) for r in jaccard.links(frame(spark, rows), block=block).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    want = [(*c, k) for c, k in zip(brute_classes(rows, 4, 85, 100), brute_links(rows, 4, 85, 100))]
    assert max(k or 0 for *_, k in want) > 10
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_set_of_a_large_component_is_stored_once(spark, tmp_path, monkeypatch):
    """What the comparison of blocks writes grows with the sets, not with the pairs of blocks."""
    monkeypatch.setattr(jaccard.store, "new_folder", lambda _, label: f"file://{tmp_path}/{label}")
    rows = near_copies(random.Random(2), 2, 40, 60)
    got = [tuple(r) for r in jaccard.links(frame(spark, rows), block=400).select("doc_id", "n_links").collect()]
    files = [p.name.rsplit("-", 1) for p in (tmp_path / "jaccard").glob("block*_*-*")]
    assert len(files) > 10
    held = [jaccard.store.mapped(f"file://{tmp_path}/jaccard", name, int(part), jaccard.BLOCKED) for name, part in files]
    sets = {frozenset(shingles(t, 4)) for _, t in rows}
    assert sorted(np.concatenate([x["n"] for x in held]).tolist()) == sorted(map(len, sets))
    assert sum(len(x["items"]) for x in held) == sum(map(len, sets))
    assert sorted(got) == sorted((d, k) for (d, _), k in zip(rows, brute_links(rows, 4, 85, 100)))


def test_texts_that_share_an_id_keep_their_own_class(spark):
    x, y = ([f"{p}{i}" for i in range(60)] for p in "xy")
    rows = [(2, " ".join(x[:-1])), (3, " ".join(y[:-1])), (5, " ".join(x)), (5, " ".join(y))]
    got = sorted(tuple(r) for r in jaccard.links(frame(spark, rows)).collect())
    assert got == [(2, 56, 2, 1), (3, 56, 3, 1), (5, 57, 2, 1), (5, 57, 3, 1)]


# --- rules


def test_rules_equal_brute_force(spark, documents):
    rows = documents + [(-i, t) for i, t in enumerate([*SPECIAL, "l #1\n l #1\n\nl #1\nl #1", "a b c " * 40, " ".join(f"w{i % 60}" for i in range(130))], 1)] + documents[:1]
    got = collections.defaultdict(list)
    for r in rules.judge(frame(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    for d, t in rows:
        t, w = t or "", words(t)
        n = len(w)
        lines, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)

        def chars(k, later):
            seen, count, held = set(), collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1)), set()
            for i in range(n - k + 1):
                g = tuple(w[i : i + k])
                if (g in seen) if later else count[g] > 1:
                    held.update(range(i, i + k))
                seen.add(g)
            return held

        r = got[d][0]
        repeat = len(chars(3, False))
        assert tuple(r[1:6]) == (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        total = max(1, sum(map(len, w)))
        for k in rules.SHARES:
            assert r[f"dup_{k}gram_share"] == pytest.approx(sum(len(w[i]) for i in chars(k, True)) / total)
        assert not (r["base_failed"] and r["kept"])
    assert rules.judge(frame(spark, [])).count() == 0
    assert [r["kept"] for r in rules.judge(frame(spark, [(1, " ".join(f"w{i}" for i in range(80)))])).collect()] == [True]
