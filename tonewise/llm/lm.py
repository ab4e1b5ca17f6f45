"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, scored from memory maps.

Training makes two passes over the texts. The first counts words and gives each an id in the order of
its hash. The second counts pairs of ids; a pair goes to the shard of its first word, but pairs of a
word that makes up a noticeable share of all words (at most ``1 / HOT_SHARE`` of them exist) are
spread over all shards. Every task adds up what it has before anything is sent, so the shuffle holds
one entry per distinct pair and task. Reducers write the arrays of their shard to the shared folder.

Score of a text: sum of log10 p(token | previous token), with

    p(w | h) = max(c(h w) - D(c(h w)), 0) / c(h) + g(h) * q(w)
    q(w)     = max(k(w) - E(k(w)), 0) / K + e / (V + 1)

where k counts the distinct words before w, K all distinct pairs, D and E are the three discounts of
each level, g and e what they free. An unseen context gives q(w); an unseen word the last term alone.

Null or empty text is the sequence of its end alone. A null id is taken as the text "". Rows with one
id are separate texts. With nothing to learn from, every probability is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.llm import store
from tonewise.llm.words import chunks, mix, word_hash

#: Pairs of a first word with at least this share of all tokens are spread over all shards.
HOT_SHARE = 1 / 512
#: Pairs that a task holds before it sends them.
HELD_PAIRS = 4_000_000

_U64 = np.uint64
#: A hash that no word has, for practical purposes: its preimage holds white space.
END = word_hash(b" end ")
UNI = {"count": "u8"}
CTX = {"n1": "u8", "n2": "u8", "n3": "u8"}
PAIR_FIELDS = {"first": "binary", "run": "binary", "second": "binary", "count": "binary"}
SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2, 3+ from the number of items seen once, twice, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))])


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all tokens share."""

    folder: str
    bits: int
    offsets: np.ndarray  # first id of each shard
    vocabulary: int
    tokens: int
    texts: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, _U64))
    hot_stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    pairs: int = 0
    discount: np.ndarray = field(default_factory=lambda: discounts(np.zeros(4)))
    lower: np.ndarray = field(default_factory=lambda: discounts(np.zeros(4)))
    lower_free: float = 1.0

    @property
    def id_type(self) -> str:
        return "u4" if self.vocabulary < 2**32 - 1 else "u8"

    def shards(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        shard = np.searchsorted(self.offsets, first, side="right") - 1
        hot = np.isin(first, self.hot)
        shard[hot] = store.shard_of(mix(second[hot] + _U64(1)), self.bits)
        return np.minimum(shard, len(self.offsets) - 1)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first.astype(_U64) + _U64(1)) + second.astype(_U64))


def distinct_pairs(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs with their summed counts."""
    if not len(first):
        return first, second, count
    small = max(int(first.max()), int(second.max())) < 2**32
    order = np.argsort(first << _U64(32) | second, kind="stable") if small else np.lexsort((second, first))
    first, second = first[order], second[order]
    at = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    return first[at], second[at], np.add.reduceat(count[order], at)


def tokens_of(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows with an end after each row, and the position of each row's first token."""
    return np.insert(chunk.hashes, chunk.bounds[1:], END), chunk.bounds[:-1] + np.arange(chunk.rows)


def ids_of(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Ids and arrays of distinct sorted hashes; id -1 (as u8) marks an unseen word."""
    n = len(hashes)
    ids = np.full(n, 2**64 - 1, _U64)
    found = {"count": np.zeros(n), "before": np.zeros(n), "n1": np.zeros(n), "n2": np.zeros(n), "n3": np.zeros(n)}
    shards = store.shard_of(hashes, model.bits)
    edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if n else []
    for a, b in zip(edges, [*edges[1:], n]):
        s = int(shards[a])
        keys = store.mapped(model.folder, "uni", s, {"key": "u8", **UNI})
        if not len(keys["key"]):
            continue
        at = np.minimum(np.searchsorted(keys["key"], hashes[a:b]), len(keys["key"]) - 1)
        hit = np.flatnonzero(keys["key"][at] == hashes[a:b])
        at, to = at[hit], hit + a
        ids[to] = at.astype(_U64) + _U64(model.offsets[s])
        found["count"][to] = keys["count"][at]
        if model.pairs:
            context = store.mapped(model.folder, "ctx", s, CTX)
            for f in CTX:
                if len(context[f]):
                    found[f][to] = context[f][at]
            before = store.mapped(model.folder, "before", s, {"before": "u8"})["before"]
            if len(before):
                found["before"][to] = before[at]
    return ids, found


def train(texts: DataFrame, text: str = "text") -> Model:
    """Learn from the column ``text`` of all rows."""
    spark = texts.sparkSession
    texts = texts.select(text)
    folder, bits = store.new_folder(spark, "bigrams"), store.shard_bits(texts)
    how = {"count": "add"}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = store.Writer(UNI, how, bits)
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                hashes, _ = tokens_of(chunk)
                out = sent.add(hashes, {"count": np.ones(len(hashes), _U64)})
                if out is not None:
                    yield out
        if (out := sent.flush()) is not None:
            yield out

    end, share = int(END), HOT_SHARE

    def merge(table: pa.Table) -> pa.Table:
        keys, values = store.reduced(table, UNI, how)
        shard = table.column("shard")[0].as_py()
        store.write(folder, "uni", shard, {"key": keys, **values})
        count = values["count"]
        top = np.argsort(count)[::-1][: int(1 / share)]  # no more words than this can have the share
        at = np.searchsorted(keys, _U64(end))
        ends = int(count[at]) if at < len(keys) and keys[at] == _U64(end) else 0
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(count.sum())], pa.int64()), "ends": pa.array([ends], pa.int64()),
                         "top": pa.array([[int(x) for x in top]], pa.list_(pa.int64())), "top_count": pa.array([[int(count[x]) for x in top]], pa.list_(pa.int64()))})

    packed = texts.mapInArrow(words, store.schema(UNI))
    merged = store.every_shard(packed, bits).groupBy("shard").applyInArrow(merge, "shard int, n long, tokens long, ends long, top array<long>, top_count array<long>")
    kept = merged.select("shard", "n", "tokens", "ends", F.arrays_zip("top", "top_count").alias("top"))
    kept.write.parquet(f"{folder}/summary")
    summary = spark.read.parquet(f"{folder}/summary")
    rows = summary.select("shard", "n", "tokens", "ends").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r["shard"]] = r["n"]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    total = sum(r["tokens"] for r in rows)
    model = Model(folder, bits, offsets[:-1].astype(_U64), int(offsets[-1]), total, sum(r["ends"] for r in rows))
    frequent = summary.select("shard", F.explode("top").alias("t")).where(F.col("t.top_count") >= max(1.0, total * share)).select("shard", "t.top").collect()
    begin = _U64(model.vocabulary)  # the id before a text's first token
    model.hot = np.sort(np.array([begin, *(model.offsets[r[0]] + _U64(r[1]) for r in frequent)], _U64))
    return _pairs(texts, model)


def _pairs(texts: DataFrame, model: Model) -> Model:
    spark, folder, kind, begin = texts.sparkSession, model.folder, model.id_type, _U64(model.vocabulary)

    def pack(parts: list) -> pa.RecordBatch:
        first, second, count = distinct_pairs(*(np.concatenate(x) for x in zip(*parts)))
        shard = model.shards(first, second)
        order = np.argsort(shard, kind="stable")  # by first, second within a shard
        first, second, count, shard = first[order], second[order], count[order], shard[order]
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        columns: list[list] = [[], [], [], [], []]
        for a, b in zip(cut, [*cut[1:], len(shard)]):
            runs = np.flatnonzero(np.concatenate([[True], first[a + 1 : b] != first[a : b - 1]]))
            columns[0].append(int(shard[a]))
            columns[1].append(first[a:b][runs].astype(kind).tobytes())
            columns[2].append(np.diff(np.append(runs, b - a)).astype("u4").tobytes())
            columns[3].append(second[a:b].astype(kind).tobytes())
            columns[4].append(count[a:b].astype("u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", *PAIR_FIELDS])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                hashes, starts = tokens_of(chunk)
                distinct, back = np.unique(hashes, return_inverse=True)
                second = ids_of(model, distinct)[0][back]
                first = np.concatenate([second[:1], second[:-1]])
                first[starts] = begin
                parts.append(distinct_pairs(first, second, np.ones(len(first), np.int64)))
                held += len(parts[-1][0])
                if held >= HELD_PAIRS:
                    yield pack(parts)
                    parts, held = [], 0
        if held:
            yield pack(parts)

    def merge(table: pa.Table) -> Iterator[pa.Table]:
        runs = store.unpack(table, "run", "u4")
        first = np.repeat(store.unpack(table, "first", kind).astype(_U64), runs)
        first, second, count = distinct_pairs(first, store.unpack(table, "second", kind).astype(_U64), store.unpack(table, "count", "u4").astype(np.int64))
        shard = table.column("shard")[0].as_py()
        key = pair_key(first, second)
        order = np.argsort(key)
        store.write(folder, "pair", shard, {"key": key[order], "count": count[order].astype("u8")})
        hot = np.isin(first, model.hot)
        size = int((model.offsets[shard + 1] if shard + 1 < len(model.offsets) else begin) - model.offsets[shard])
        local = (first[~hot] - model.offsets[shard]).astype(np.int64)
        class_of = np.minimum(count, 3)
        context = {f"n{k}": np.bincount(local[class_of[~hot] == k], minlength=size).astype("u8") for k in (1, 2, 3)}
        store.write(folder, "ctx", shard, context)
        hot_ids, at = np.unique(first[hot], return_inverse=True)
        stats = [np.bincount(at[class_of[hot] == k], minlength=len(hot_ids)).tolist() for k in (1, 2, 3)]
        ids, before = np.unique(second, return_counts=True)
        to = np.searchsorted(model.offsets, ids, side="right") - 1
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        ends = [*cut[1:], len(to)]
        n = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        listed = pa.list_(pa.int64())
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "pairs": pa.array([len(key)], pa.int64()), "n": pa.array([n], listed),
            "hot": pa.array([[int(x) for x in hot_ids]], listed), "n1": pa.array([stats[0]], listed), "n2": pa.array([stats[1]], listed), "n3": pa.array([stats[2]], listed),
            "to": pa.array([[int(to[a]) for a in cut]], pa.list_(pa.int32())),
            "ids": pa.array([[ids[a:b].astype(kind).tobytes() for a, b in zip(cut, ends)]], pa.list_(pa.binary())),
            "before": pa.array([[before[a:b].astype("u4").tobytes() for a, b in zip(cut, ends)]], pa.list_(pa.binary())),
        })

    packed = texts.mapInArrow(pairs, "shard int, " + ", ".join(f"{k} {v}" for k, v in PAIR_FIELDS.items()))
    kept = store.every_shard(packed, model.bits).groupBy("shard").applyInArrow(
        merge, "shard int, pairs long, n array<long>, hot array<long>, n1 array<long>, n2 array<long>, n3 array<long>, to array<int>, ids array<binary>, before array<binary>"
    )
    kept.write.parquet(f"{folder}/merged")
    kept = spark.read.parquet(f"{folder}/merged")

    def gather(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        size = int((model.offsets[shard + 1] if shard + 1 < len(model.offsets) else begin) - model.offsets[shard])
        ids = (store.unpack(table, "ids", kind).astype(_U64) - model.offsets[shard]).astype(np.int64)
        before = np.bincount(ids, weights=store.unpack(table, "before", "u4"), minlength=size).astype(np.int64)
        store.write(folder, "before", shard, {"before": before.astype("u8")})
        n = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before >= 3).sum())]
        return pa.table({"n": pa.array([n], pa.list_(pa.int64()))})

    parts = kept.select(F.explode(F.arrays_zip("to", "ids", "before")).alias("x")).select(F.col("x.to").alias("shard"), "x.ids", "x.before")
    lower = [r["n"] for r in store.every_shard(parts, model.bits).groupBy("shard").applyInArrow(gather, "n array<long>").collect()]
    rows = kept.select("pairs", "n").collect()
    hot = kept.select(F.explode(F.arrays_zip("hot", "n1", "n2", "n3")).alias("x")).groupBy("x.hot").agg(*(F.sum(f"x.n{k}").alias(f"n{k}") for k in (1, 2, 3))).collect()
    model.pairs = sum(r["pairs"] for r in rows)
    model.hot_stats = np.zeros((len(model.hot), 3))
    for r in hot:
        model.hot_stats[np.searchsorted(model.hot, _U64(r["hot"]))] = r["n1"], r["n2"], r["n3"]
    if model.pairs:
        model.discount = discounts(np.sum([r["n"] for r in rows], axis=0))
        n = np.sum(lower, axis=0)
        model.lower = discounts(n[:4])
        model.lower_free = float(model.lower[1] * n[0] + model.lower[2] * n[1] + model.lower[3] * n[4]) / model.pairs
    return model


def chunk_scores(model: Model, chunk) -> dict[str, np.ndarray]:
    """The score columns of a chunk's rows."""
    hashes, starts = tokens_of(chunk)
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, word = ids_of(model, distinct)
    base = np.log10((word["count"] + 1) / (model.tokens + 1 * (model.vocabulary + 1)))
    unigram = model.lower_free / (model.vocabulary + 1)
    if model.pairs:
        unigram = unigram + np.maximum(word["before"] - model.lower[np.minimum(word["before"], 3).astype(int)], 0) / model.pairs
    else:
        unigram = np.full(len(distinct), unigram)
    seen, times = word["count"], np.stack([word["n1"], word["n2"], word["n3"]], axis=1)
    if len(model.hot) and len(distinct):
        at = np.minimum(np.searchsorted(model.hot, ids), len(model.hot) - 1)
        is_hot = model.hot[at] == ids
        times[is_hot] = model.hot_stats[at[is_hot]]
    free = np.where(seen > 0, times @ model.discount[1:] / np.maximum(seen, 1), 1.0)

    second = ids[back]
    first = np.concatenate([second[:1], second[:-1]])
    first[starts] = _U64(model.vocabulary)
    context, freed = (np.concatenate([x[back][:1], x[back][:-1]]) for x in (seen, free))
    context[starts] = model.texts
    begins = model.hot_stats[np.searchsorted(model.hot, _U64(model.vocabulary))] if len(model.hot_stats) else np.zeros(3)
    freed[starts] = float(begins @ model.discount[1:]) / model.texts if model.texts else 1.0
    # The end of a text is no context: it counts as a word, but nothing follows it.
    count = np.zeros(len(second))
    none = _U64(2**64 - 1)
    known = np.flatnonzero((first != none) & (second != none))
    if len(known) and model.pairs:
        a, b, key = first[known], second[known], pair_key(first[known], second[known])
        shard = model.shards(a, b)
        order = np.lexsort((key, shard))
        cut = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]]))
        for x, y in zip(cut, [*cut[1:], len(order)]):
            to = order[x:y]
            stored = store.mapped(model.folder, "pair", int(shard[to[0]]), {"key": "u8", "count": "u8"})
            if len(stored["key"]):
                at = np.minimum(np.searchsorted(stored["key"], key[to]), len(stored["key"]) - 1)
                hit = stored["key"][at] == key[to]
                count[known[to[hit]]] = stored["count"][at[hit]]
    p = np.maximum(count - model.discount[np.minimum(count, 3).astype(int)], 0) / np.maximum(context, 1) + freed * unigram[back]
    logs = np.log10(np.minimum(p, 1.0))
    n = np.diff(np.append(starts, len(hashes)))

    def sums(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, starts) if chunk.rows else np.zeros(0)

    return {"n_tokens": n, "n_known": sums((seen > 0)[back].astype(np.int64)), "train_tokens": np.full(chunk.rows, model.tokens),
            "base_score": sums(base[back]), "score": sums(logs)}


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with n_tokens, n_known, train_tokens, base_score and score, which replace columns of these names."""
    keep = tuple(k for k in keep if k not in {part.split()[0] for part in SCORES.split(", ")})
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = dict(rows.dtypes)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(width), lower=True):
                got = chunk_scores(model, chunk)
                part = batch.slice(chunk.first, chunk.rows)
                numbers = [pa.array(v, pa.float64() if "score" in k else pa.int64()) for k, v in got.items()]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *numbers], [*part.schema.names[:width], *got])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + (", " if keep else "") + SCORES)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose CRC-32 of the id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2
