"""Packing, mixing, extraction, classifiers, neighbours and the pipeline."""

from __future__ import annotations

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

import corpus_pipeline
from tonewise.llm import ann, extract, mixing, packing, subwords
from tonewise.llm.words import chunks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# --- packing


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


@pytest.mark.parametrize("length", [2048, 64])
def test_pieces_hold_every_id_once(spark, documents, length):
    special = [None, "", " \n", "x<|endoftext|>y <|startoftext|>", "café    nbsp \x1c sep\x85", "Don't 123 STOP!! é ß", "long" * 4000, "a " * 5000]
    rows = documents[:80] + [(-i, t) for i, t in enumerate(special, 1)] + documents[:2] + [(None, "no id")]
    df = spark.createDataFrame([(d, t, "c", 9) for d, t in rows], "doc_id long, text string, id string, length int").repartition(3)
    got = packing.pack(df, length=length).collect()
    want = collections.Counter((d, ids.tobytes()) for (d, _), ids in zip(rows, whole_ids([t for _, t in rows])))
    docs = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        docs[r["doc_id"], r["start"], r["doc_tokens"]].append(r)
    have = collections.Counter()
    for (d, start, total), pieces in docs.items():
        if start == 0:
            for i, first in enumerate(sorted(pieces, key=lambda r: bytes(r["ids"]))):
                ids, at = bytes(first["ids"]), first["length"]
                while at < total:
                    same = sorted(docs[d, at, total], key=lambda r: bytes(r["ids"]))
                    ids, at = ids + bytes(same[i]["ids"]), at + same[i]["length"]
                have[d, ids] += 1
    assert have == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    assert packing.pack(df.where("false"), length=length).count() == 0


def ids_of(cache, texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    ids, bounds = cache.ids(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


ODD = ["", " ", "foo foo, Foo. FOO!? (foo) don't", "été Été, ÉTÉ; É ß Ÿ ÿ. ×÷", "...", "a1, 12. x-y- ÿ", "日本, 日本。 naïve,naïve,", "Foo<|endoftext|> BAR.", "<|EndOfText|>,"]


def test_ids_are_the_tokenizers_and_do_not_lean_on_hashes(monkeypatch):
    cache = packing.WordCache(packing.default_tokenizer())
    want = [w[:-1].tolist() for w in whole_ids(ODD)]
    assert ids_of(cache, ODD) == want and ids_of(cache, ODD[:6]) == want[:6]
    assert ids_of(cache, []) == []
    real = packing.hashes_of
    monkeypatch.setattr(packing, "hashes_of", lambda *a: real(*a) & np.uint64(3))
    cache.table = packing.WordTable([], [])
    assert ids_of(cache, ODD) == want
    cache.table = packing.WordTable(list(cache.met), list(cache.met.values()))
    assert ids_of(cache, ODD[::-1]) == want[::-1]


def test_words_met_again_move_to_the_table(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 45_000)
    cache = packing.WordCache(packing.default_tokenizer())
    texts = [" ".join(f"w{i}" for i in range(a, a + 30_000)) for a in (0, 30_000)]
    want = [w[:-1].tolist() for w in whole_ids(texts)]
    for size in (0, 30_000, 30_000):  # once, again, then from the table
        assert ids_of(cache, texts[:1]) == want[:1]
        assert len(cache.table.hashes) == size
    for _ in range(3):  # the table would be too large, so it begins anew
        assert ids_of(cache, texts[1:]) == want[1:]
    assert len(cache.table.hashes) == 30_000 and ids_of(cache, texts) == want


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 50)
    text = ("Foo bar, " * 40 + "x" * 9_000 + "\t" + "été " * 30).encode()
    parts = list(packing._parts(np.frombuffer(text, np.uint8)))
    assert b"".join(p.tobytes() for p in parts) == text and len(parts) > 5
    assert all(p[0] in b" \t" for p in parts[1:])
    ids, bounds = packing.word_ids(packing.default_tokenizer(), np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == whole_ids([text.decode()])[0][:-1].tolist() and bounds.tolist() == [0, len(ids)]


def test_patterns_fill_sequences():
    rng = random.Random(2)
    histogram = collections.Counter(rng.randint(1, 2048) for _ in range(50_000))
    patterns = packing.shortest_pack_first(histogram, 2048)
    placed = collections.Counter()
    for pieces, count in patterns:
        assert sum(pieces) <= 2048
        for p in pieces:
            placed[p] += count
    assert placed == histogram
    room = sum((2048 - sum(p)) * c for p, c in patterns)
    assert room < 0.02 * 2048 * sum(c for _, c in patterns)
    assert packing.shortest_pack_first({}, 8) == [] and len(packing.slots([])["key"]) == 0


# --- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > most * sizes[s]]
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
            open_.discard(s)
    return target


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", mixing.word_count(F.col("text")))
    return mixing.mix(df), df


def test_mixture_follows_targets_and_its_sql(spark):
    rng = random.Random(4)
    names = ["a", "B", None, "é", "zz", "tiny", "empty"]
    rows = [(i, rng.choices(names[:5], [1, 30, 8, 3, 8])[0], "w " * rng.randint(0, 60)) for i in range(3000)]
    rows += [(9000 + i, "tiny", "w w") for i in range(3)] + [(9100, "empty", None), (9101, "empty", "")] + rows[:5] + [(None, "a", "x y")]
    out, df = mixed(spark, rows)
    got = out.collect()
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate - 1e-9) <= r["copies"] <= min(3, math.ceil(rate + 1e-9))
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * 60
    again = mixing.mix(df.repartition(7, "text")).collect()
    key = lambda r: str((r["doc_id"], r["source"], r["size"], r["copies"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "source": [r[1] for r in rows], "text": [r[2] for r in rows]})
    con.register("documents", documents)
    twin = con.execute(mixing.ORACLE).fetchall()
    assert sorted(map(str, twin)) == sorted(str((r["doc_id"], r["size"], r["source_size"], r["target"], r["copies"] * r["size"])) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_targets_of_many_sources(spark, seed):
    rng = random.Random(seed)
    sizes = {f"host{rng.getrandbits(40)}": int(rng.paretovariate(0.6)) - rng.randint(0, 1) for _ in range(500)} | {None: 7}
    sizes |= {f"big{i}": 10**13 + i for i in range(seed)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(df, "source").collect()}
    want = brute_targets(sizes)
    assert {s: n for s, (n, _) in got.items()} == sizes
    assert all(got[s][1] == pytest.approx(want[s], rel=1e-12) for s in sizes)


def test_mixture_is_the_same_without_a_broadcast(spark):
    rows = [(i, f"s{i % 7}", "w " * (i % 13)) for i in range(400)] + [(1000, None, "a b")]
    out, df = mixed(spark, rows)
    assert sorted(map(str, mixing.mix(df, limit=0).collect())) == sorted(map(str, out.collect()))


def test_mixture_of_nothing_and_emitted_copies(spark):
    out, _ = mixed(spark, [(1, "s", None)])
    assert [(r["target"], r["copies"]) for r in out.collect()] == [(0.0, 0)]
    assert mixing.emitted(out).count() == 0
    out, df = mixed(spark, [(i, "only", "a b c") for i in range(10)])
    assert mixing.emitted(out).columns == df.columns and mixing.emitted(out).count() == 10
    assert mixing.mix(df.where("false")).count() == 0


# --- extraction

MENU = "<nav><ul><li><a href='/'>Home</a></li><li>About</li></ul></nav>"


def test_blocks_of_marked_pages():
    page = (
        "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';if(a<b){}</script></head><body>"
        f"{MENU}<div class='cookie-notice'>We use cookies</div><article class=post><h1>A &amp; B</h1><p><b>One\n  two &lt;3&nbsp;x<br><p>Three &eacute;&#233;&#xe9; <i>fo</i>ur"
        "<div class='ad'>Buy <div>now</div></div><script>x('<p>')</script><p>Five<form>Mail <input> <button>Go</button></form> six"
        "<aside>See also</aside><section id=comments><p>Nice!</p></section></article><footer>&copy; x</footer><!-- <p>no</p> --></body>"
    )
    assert extract.main_texts([page]) == ["A & B\n\nOne two <3 x\n\nThree ééé four\n\nFive\n\nsix"]
    assert extract.main_texts([None, "", "<p>", "just text & more", "<article><p>cut off in the mid"]) == ["", "", "", "just text & more", "cut off in the mid"]
    assert extract.main_texts(["<div class=ad>never closed<article><p>Text</p></article>"]) == ["Text"]


def test_repeated_stretches_go_from_unmarked_pages(spark):
    intro = "welcome to our little corner of the web please enjoy your stay"
    unique = [" ".join(f"u{i}x{j}" for j in range(12)) for i in range(9)]
    pages = [f"<body><div>{intro}</div><div>{u}</div><div>{intro} and {u.upper()}</div></body>" for u in unique]
    assert extract.main_texts(pages) == [f"{u}\n\n{u.upper()}" for u in unique]
    shared = [f"<article><p>{intro}</p></article>" for _ in range(5)]
    assert extract.main_texts(shared) == [intro] * 5
    rows = [(i, "http://h.org/x", p, "c") for i, p in enumerate(pages)] + [(None, None, None, None), (4, "no host", pages[0], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"]) for r in extract.extract(df).collect())
    assert got == sorted([*((str(i), "http://h.org/x", f"{u}\n\n{u.upper()}") for i, u in enumerate(unique)), ("None", "None", ""), ("4", "no host", f"{intro}\n\n{unique[0]}\n\n{intro} and {unique[0].upper()}")])
    assert extract.extract(df.where("false")).count() == 0
    assert extract.extract(df, group_bytes=200).count() == len(rows)  # a host dealt over several groups loses no page


def test_boilerplate_is_judged_by_host_not_by_group(spark):
    rng = random.Random(6)
    often, seldom, few = (" ".join(f"{p}{j}" for j in range(12)) for p in ("often", "seldom", "few"))
    bodies = []
    for i in range(600):
        stretch = often if i % 20 == 0 else seldom if i % 60 == 1 else ""  # 30 and 10 of 600 pages; 30 are enough
        bodies.append(f"<div>{' '.join(f'u{i}x{rng.randint(0, 99)}' for _ in range(9))}</div><div>{stretch}</div>")
    rows = [(i, "http://Big.org/x", f"<body>{b}</body>") for i, b in enumerate(bodies)]
    rows += [(1000 + i, "http://small.org/y", f"<p>s{i}</p><p>{few if i < 3 else ''}</p>") for i in range(9)]
    rows += [(2000 + i, "http://two.org/y", f"<p>{few if i < 2 else ''}</p>") for i in range(9)]
    want = {}
    for host in ("Big", "small", "two"):
        own = [r for r in rows if host in r[1]]
        want |= dict(zip((r[0] for r in own), extract.main_texts([r[2] for r in own])))
    kept = collections.Counter(word for text in want.values() for word in ("often0", "seldom0", "few0") if word in text.split())
    assert kept == {"seldom0": 10, "few0": 2}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for group_bytes in (1 << 30, 2000, 1):  # by pages alone, by bytes, about a page a group
        assert {r["page_id"]: r["text"] for r in extract.extract(df, group_bytes=group_bytes).collect()} == want


def texts_of(spark, pages, host="http://h.org/x"):
    """The registered path over pages of one host."""
    df = spark.createDataFrame([(i, host, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in extract.extract(df).orderBy("page_id").collect()]


def test_hosts_of_hardly_any_tokens(spark):
    rows = [(0, "http://a.org", "Not Found"), (1, "http://b.org", None), (2, "http://b.org", ""), (3, "http://c.org", "x"), (4, "http://d.org", "a b c"), (5, "http://e.org", "a b c d")]
    rows += [(10 + i, None, None) for i in range(3)] + [(20 + i, f"http://n{n}.org", "w " * n) for i, n in enumerate(range(9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.extract(df).collect()}
    assert got == {i: " ".join((h or "").split()) for i, _, h in rows}


def test_raw_elements_end_where_they_end(spark):
    article = lambda x: f"<article><p>one two</p>{x}<p>three four</p></article>"
    both = "one two\n\nthree four"
    drop = ["<svg class='i'/>", "<math/>", "<svg viewBox='0 0 1 1'><path d='M0 > 1'/><title>t</title></svg>", "<script>if (a</b) '<p>no</p>'</script>", "<script src='x'/>", "<style>p{}</style>",
            "<noscript><div>no</div></noscript>", "<template><p>no</p></template>", "<iframe src=x></iframe>", "<svg><text>no</text>", "<select><option>no", "<math><mi>no</mi>",
            "<object data=x><p>no</p></object>", "<title>no</title>", "<textarea><p>no</p></textarea>", "<SVG/>", "<svg/><svg/><svg>x</svg>", "<script>no"]
    got = texts_of(spark, [article(x) for x in drop])
    assert got == [both] * len(drop), [d for d, g in zip(drop, got) if g != both]


def test_comments_headers_and_class_names(spark):
    cases = [
        ("<article><p>text</p><section class='comments'><article>hi</article></section><p>end</p></article>", "text\n\nend"),
        ("<article><p>text</p></article><div id=comments><article class='comment'><p>hi</p></article><article>ho</article></div>", "text"),
        ("<article><header><h1>Title</h1></header><p>text</p><footer>me</footer></article>", "Title\n\ntext"),
        ("<article><div class='social-security-form'>law</div><p class='breaking alert'>news</p><p class=share>stock</p></article>", "law\n\nnews\n\nstock"),
        ("<article><p>text</p><div class='share-buttons'>tweet</div><div class='ad-300x250'>buy</div><div class='related_posts'>more</div></article>", "text"),
        ("<main><div class='notice'>cookies</div><div class='noticeable'>bright</div><ul class='main-nav'><li>home</li></ul><ul><li>point</li></ul></main>", "bright\n\npoint"),
        ("<div class=ad>open<article><p>text</p></article>", "text"),
        ("<header>site</header><article>text</article>", "text"),
        ("<div class='article-header'>x</div><main>text</main>", "text"),
    ]
    assert texts_of(spark, [page for page, _ in cases]) == [want for _, want in cases]


def test_inline_elements_never_remove_text():
    rng = random.Random(12)
    tags = ["span", "b", "i", "em", "a", "font", "mark", "custom-tag", "x", "abbr", "time", "small"]
    names = ["", ' class="ad"', " class='share button'", " id=nav", ' role="alert"', " class=comment", " data-x='>'"]
    for _ in range(200):
        words = [f"w{i}" for i in range(rng.randint(1, 8))]
        parts = []
        for word in words:
            tag = rng.choice(tags)
            parts.append(rng.choice([word, f"<{tag}{rng.choice(names)}>{word}</{tag}>", f"<{tag}{rng.choice(names)}>{word}", f"{word}<{tag}/>"]))
        page = f"<article><p>{' '.join(parts)}</p></article>"
        assert extract.main_text(extract.blocks(page), None) == " ".join(words), page


def _tree(rng, depth, kept):
    """A random well-formed element: its html, and its text blocks as (text, kept)."""
    if depth == 0 or rng.random() < 0.3:
        text = f"t{rng.randrange(10**6)}"
        return rng.choice([(f"<p>{text}</p>", [(text, kept)]), (f"<h2 class=title>{text}</h2>", [(text, kept)]), (f"<ul><li>{text}</li></ul>", [(text, kept)])])
    tag, attributes, drops = rng.choice([("div", "", False), ("section", " class=chapter", False), ("div", " class='ad-box'", True), ("aside", "", True), ("nav", "", True), ("form", "", True),
                                         ("section", " id=comments", True), ("blockquote", "", False), ("div", " class='cookie-notice'", True), ("footer", "", True)])
    inner = [_tree(rng, depth - 1, kept and not drops) for _ in range(rng.randint(0, 3))]
    return f"<{tag}{attributes}>{''.join(h for h, _ in inner)}</{tag}>", [b for _, found in inner for b in found]


def test_small_well_formed_pages(spark):
    rng = random.Random(21)
    pages, want = [], []
    for _ in range(150):
        before, body, after = (_tree(rng, 3, True) for _ in range(3))
        pages.append(f"<html><head><title>x</title></head><body><nav>menu</nav>{before[0]}<article><p>start</p>{body[0]}</article>{after[0]}<footer>f</footer></body></html>")
        want.append("\n\n".join(["start", *(t for t, kept in body[1] if kept)]))
    assert texts_of(spark, pages) == want


def test_repeats_equal_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 6))]
        run, least = rng.randint(1, 5), rng.randint(1, 3)
        pages = collections.defaultdict(set)
        for p, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                pages[tuple(s[i : i + run])].add(p)
        want = []
        for s in streams:
            hit = [False] * len(s)
            for i in range(len(s) - run + 1):
                if len(pages[tuple(s[i : i + run])]) >= least:
                    hit[i : i + run] = [True] * run
            want.append(hit)
        assert [c.tolist() for c in extract.repeated(streams, run, least, 0.0)] == want


# --- classifiers


def synthetic(seed, n, bad):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        text = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(rng.randint(5, 120))]
        if label:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), label))
    return rows


def logits(model, texts):
    return np.concatenate([model.logits(c) for c in chunks(pa.array(texts, pa.string()), lower=model.lower)])


def test_unseen_spellings_share_ngrams():
    rows = synthetic(1, 1500, ["worthless", "disgusting"])
    model = subwords.train(pa.array([t for _, t, _ in rows]), np.array([y for *_, y in rows]), window=3, lower=True, epochs=4)
    clean = "lamo sire tona " * 20
    got = logits(model, [clean, clean + "worthles", clean + "DISGUSTTING " + clean, "", None])
    assert got[0] < got[1] and got[0] < got[2] and got[1] > 0 and got[2] > 0 and got[3] == got[4] < 0
    held = synthetic(2, 300, ["worthless", "disgusting"])
    assert ((logits(model, [t for _, t, _ in held]) > 0) == [y for *_, y in held]).mean() > 0.97


def plain_logit(model, text):
    """The score of a text in plain Python: words, their buckets, and every run of the model's window."""
    import re

    from tonewise.llm.words import word_hash, words_of

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    if model.lower:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    values, last = [], {}
    for i, word in enumerate(words):
        raw = word.encode()
        chunk = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        ids, _ = subwords.subword_ids(chunk, np.array([0]))
        assert int(ids[0]) == int(subwords.mix(np.array([word_hash(raw)]))[0] % np.uint64(subwords.BUCKETS))
        assert len(ids) == 1 + sum(max(0, len(raw) + 3 - n) for n in subwords.NGRAMS)
        value = sum(model.weights[b] for b in ids) / len(ids)
        if model.patterns:
            back = min(int(math.log2(i - last[word])), subwords._PATTERNS - 2) if word in last else subwords._PATTERNS - 1
            value += model.pattern_weights[back]
        last[word] = i
        values.append(value)
    n = model.window or len(values)
    runs = [values[i : i + n] for i in range(max(1, len(values) - n + 1))] if values else [[0.0]]
    return max(sum(r) / max(len(r), 1) for r in runs) + model.offset


@pytest.mark.parametrize("window,patterns", [(3, False), (0, True), (2, True), (0, False)])
def test_scores_equal_plain_python(window, patterns):
    rows = synthetic(9, 300, ["worthless"])
    model = subwords.train(pa.array([t for _, t, _ in rows]), np.array([y for *_, y in rows]), window=window, lower=window > 0, patterns=patterns, epochs=2)
    texts = [t for _, t, _ in rows[:40]] + ["", None, "one", "One TWO", "é ÉÀ worthless", "a b a b c a", "x\x1cy z\n\n w"]
    assert np.allclose(logits(model, texts), [plain_logit(model, t) for t in texts], atol=1e-8)


def test_a_phrase_counts_the_same_at_any_place():
    rng = random.Random(4)
    word = lambda: f"{rng.choice('bcdfgk')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}"
    rows = []
    for i in range(1500):
        text = [word() for _ in range(rng.randint(3, 40))]
        at = rng.randrange(len(text) + 1)
        text[at:at] = ["you", "suck"] if i % 3 == 0 else rng.choice([["you"], ["suck"], ["we", "suck", "it"], []])
        rows.append((" ".join(text), int(i % 3 == 0)))
    model = subwords.train(pa.array([t for t, _ in rows]), np.array([y for _, y in rows]), window=3, lower=True, epochs=4)
    got = logits(model, [f"{'tona ' * k}you suck {'lamo ' * 9}" for k in range(7)])
    assert got.min() > 0 and got.max() - got.min() < 0.6 * abs(got.max())


def test_repetition_shows_in_patterns():
    rng = random.Random(3)
    plain = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(60)) for _ in range(300)]
    repeated = [" ".join(f"w{rng.randint(0, 999)} " * 10 for _ in range(6)) for _ in range(300)]
    y = np.array([1] * 200 + [0] * 200)
    model = subwords.train(pa.array(plain[:200] + repeated[:200]), y, patterns=True)
    assert (logits(model, plain[200:]) > 0).mean() > 0.97 and (logits(model, repeated[200:]) < 0).mean() > 0.97


def test_classifier_over_tables(spark):
    rows = synthetic(5, 400, ["moron"])
    docs = spark.createDataFrame([(i, t, "a", 0.5) for i, t, _ in rows] + [(None, "moron", "a", 0.1), (1000, None, "b", 0.1), (3, "x", "b", 1.0)], "doc_id long, text string, _label string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (5, 1)], "doc_id long, toxic int")
    texts, y = subwords.sample(docs, labels, "toxic")
    assert len(texts) == len(y) == 401
    few, _ = subwords.sample(docs, labels, "toxic", rows=100)
    assert 50 < len(few) < 160
    model = subwords.toxicity(docs, labels)
    got = subwords.score(docs, model, 0.5)
    assert got.columns == ["doc_id", "score", "predicted"]
    out = got.collect()
    assert len(out) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["score"] == s["score"] for r, s in zip(sorted(out, key=str), sorted(subwords.score(docs.repartition(5), model, 0.5).collect(), key=str)))
    empty = subwords.toxicity(docs, labels.where("false"))
    assert {r["score"] for r in subwords.score(docs, empty, 0.5).collect()} == {0.5}
    assert subwords.score(docs.where("false"), model, 0.5).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = subwords.quality(docs, labels.where(~subwords.fold(4, 2)))
    held = subwords.score(docs, model, 0.7).join(labels.where(subwords.fold(4, 2)), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93


# --- neighbours


def test_neighbours_equal_exact_search(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 24))
    x = (centres[rng.integers(0, 20, 900)] + 0.4 * rng.standard_normal((900, 24))).astype(np.float32)
    x[10] = x[11]  # a tie
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [float("inf")] + [1.0] * 23), (2080, [None] + [1.0] * 23), (2100, [1.0]), (2120, []), (None, [1.0] * 24)]
    shape = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("length", LongType())])
    df = spark.createDataFrame([(a, b, 1) for a, b in rows + bad], shape).repartition(4)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    exact, hits = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 900, 20))
    for q, found in got.items():
        score = exact @ exact[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(900), -score))[:20]
        hits += len({v for v, _ in found} & set(want.tolist()))
        assert [v for v, _ in found] == [v for v, _ in sorted(found, key=lambda z: (-z[1], z[0]))]
        assert all(s == pytest.approx(score[v], abs=1e-9) for v, s in found)
    assert hits / (20 * len(got)) > 0.99
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_one_huge_vector_leaves_the_other_answers_alone(spark):
    x = np.random.default_rng(8).standard_normal((60, 8))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(100, [1e300, -1e300] + [0.0] * 6), (101, [1e-300] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 20, 40, 100] and all(len(v) == 5 for v in got.values())
    wide = np.array([v for _, v in rows], np.longdouble)
    for q, found in got.items():
        at = [i for i, _ in rows].index(q)
        score = {i: s for (i, _), s in zip(rows, wide @ wide[at]) if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert [v for v, _ in found] == want
    both = spark.createDataFrame([(0, [1e300, 1e300]), (20, [1e300, -1e300]), (21, [1e300, 1.0])], "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(both, F.col("vec_id") % 20 == 0).collect()}
    assert found[0, 20] == 0.0 and found[0, 21] == math.inf and len(found) == 4


def test_codes_estimate_within_their_bounds():
    rng = np.random.default_rng(6)
    x, asked = rng.standard_normal((5000, 64)), rng.standard_normal((200, 64))
    turn = ann.frame(64)
    assert np.allclose(turn @ turn.T, np.eye(64)) and turn.shape == (64, 64 * ann.ROTATIONS)
    codes, length, fit, spread = ann.encoded(x)
    assert {len(c) for c in codes} == {64 * ann.ROTATIONS // 8} and np.allclose(length, np.linalg.norm(x, axis=1))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(codes, pa.binary()), *map(pa.array, (length, fit, spread))], list("abcdef"))
    ids, exact, estimate, slack = ann._estimates(rows, 64)
    assert (ids == np.arange(5000)).all() and (exact == x).all()
    error, bound = asked @ estimate.T - asked @ x.T, np.linalg.norm(asked, axis=1)[:, None] * slack
    assert (np.abs(error) > bound).mean() < 0.001 and abs(error.mean()) < 0.01 * bound.mean()
    # one rotation has the bound of sqrt(1 - fit^2) / fit; sixteen have about a quarter of it
    assert spread.mean() < 0.3 * np.sqrt(1 / (2 / np.pi) - 1)
    for few in (np.zeros((0, 64)), np.zeros((1, 64)), np.ones((1, 1))):
        codes, *numbers = ann.encoded(few)
        assert len(codes) == len(few) and all(np.isfinite(n).all() and len(n) == len(few) for n in numbers)


def test_neighbours_close_to_the_floor_are_reranked(spark):
    x = np.random.default_rng(3).standard_normal((3000, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 3 == 0).collect()}
    score = x[::3] @ x.T
    score[np.arange(1000), np.arange(0, 3000, 3)] = -np.inf
    want = {(3 * q, int(v)) for q, best in enumerate(np.argsort(-score, axis=1)[:, :20]) for v in best}
    assert len(want - got) <= 2


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400")
    columns, kept = docs.columns, []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources", "packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        kept.append([tuple(r) for r in docs.collect()])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = [{r[0] for r in rows} for rows in kept]
    assert ids[0] > ids[1] and ids[1] == ids[2] and ids[3] <= ids[2] and {r[0] for r in kept[4]} == ids[3]
    assert np.mean([(d in ids[0]) == y for d, y in labels.items() if d < 400]) > 0.9
    from tests.llm.test_text_operators import brute_classes, brute_dedupe

    classes = brute_classes([(r[0], r[1]) for r in kept[0]], 4, 85, 100)
    assert ids[1] == {d for d, _, c in classes if d == c}
    texts = {r[0]: r[1] for r in kept[2]}
    for d, _, _, words in brute_dedupe([(r[0], r[1]) for r in kept[1]], 50):
        assert texts[d].split() == words
    copies = collections.Counter(r[0] for r in kept[3])
    assert max(copies.values()) <= 3
    tokens = {r[0]: len(i) for r, i in zip(kept[3], whole_ids([r[1] for r in kept[3]]))}
    assert sum(r[2] for r in kept[4]) == sum(n * tokens[d] for d, n in copies.items())
