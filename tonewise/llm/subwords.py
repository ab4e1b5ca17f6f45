"""Text classifiers of averaged subword embeddings under a linear softmax, trained in numpy.

A word stands for the vectors of its hashed self and of its hashed character n-grams; their mean is
the word's vector. ``Classifier`` averages word vectors and applies a linear softmax; embeddings and
softmax are learned together by stochastic gradient descent with per-weight steps. Unseen spellings
share n-grams with the words they distort.

``window`` 0 averages over the document. A positive value averages over each run of that many words,
from every word on, and takes the document's most likely run, so one passage counts as much in a long
text as in a short one, wherever it stands. A text of fewer words is one run.

``patterns`` adds word n-grams in a form that does not depend on the words: for each word, how far
back it last stood in the text (a hashed "A A", "A . A", ...), which is how repetition shows.

Training reads a bounded sample: at most ``ROWS`` labelled rows and ``BYTES`` bytes of text in
expectation, chosen by a hash of the id; tables within the bounds are read whole. Everything else is
one pass over all rows. After training, the product of embeddings and softmax is one number per
bucket, 2 MB in all, which is what tasks receive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tonewise.llm.store import new_folder
from tonewise.llm.words import _BYTE, Chunk, chunks, inside, mix, powers, release_memory

BUCKETS = 1 << 18
NGRAMS = (3, 4, 5)
DIMENSIONS = 8
#: Bounds of the training sample.
ROWS = 8_000
BYTES = 24 << 20

_U64 = np.uint64
#: Buckets that fewer training texts than this hold keep the weight 0.
LEAST_TEXTS = 3
_SUB = 0xA0761D6478BD642F | 1
#: A word's value is rounded to multiples of 1 / _UNIT when texts are scored.
_UNIT = float(1 << 32)
_PATTERNS = 24  # distances by powers of two, the last for a first occurrence


def subword_ids(chunk: Chunk, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the given words of a chunk, and the word (by its place in ``words``) of each."""
    size = chunk.ends[words] - chunk.starts[words]
    room = size + 2
    begin = np.cumsum(room) - room
    total = int(room.sum())
    text = np.empty(total, np.uint8)
    of = np.repeat(np.arange(len(words)), room)
    at = np.arange(total) - begin[of]
    text[:] = 0x20  # both ends of a word
    body = (at > 0) & (at <= size[of])
    text[body] = chunk.data[chunk.starts[words][of[body]] + at[body] - 1]
    up, down = powers(_SUB, total + 1)
    sums = np.zeros(total + 1, _U64)
    np.cumsum(_BYTE[text] * up[:total], out=sums[1:])
    ids, owners = [mix(chunk.hashes[words]) % _U64(BUCKETS)], [np.arange(len(words))]
    for n in NGRAMS:
        first = np.flatnonzero(at + n <= room[of])
        ids.append(mix((sums[first + n] - sums[first]) * down[first] + _U64(n)) % _U64(BUCKETS))
        owners.append(of[first])
    return np.concatenate(ids).astype(np.int32), np.concatenate(owners)


def pattern_ids(chunk: Chunk) -> np.ndarray:
    """For each word of the chunk, the pseudo bucket of the distance to its last occurrence in the row."""
    n = len(chunk.hashes)
    row = chunk.row_of
    order = np.lexsort((np.arange(n), chunk.hashes, row))
    same = np.zeros(n, bool)
    h, r = chunk.hashes[order], row[order]
    same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    back = np.zeros(n, np.int64)
    back[1:] = order[1:] - order[:-1]
    out = np.full(n, _PATTERNS - 1, np.int64)
    out[order[same]] = np.minimum(np.log2(back[same]).astype(np.int64), _PATTERNS - 2)
    return out


@dataclass
class Classifier:
    """What scoring needs: a number per bucket and pattern, and the offset."""

    weights: np.ndarray
    pattern_weights: np.ndarray
    offset: float
    window: int
    lower: bool
    patterns: bool

    def logits(self, chunk: Chunk) -> np.ndarray:
        distinct, first, back = np.unique(chunk.hashes, return_index=True, return_inverse=True)
        if not len(distinct):
            return np.full(chunk.rows, self.offset)
        ids, owners = subword_ids(chunk, first)
        word = np.bincount(owners, self.weights[ids], len(distinct)) / np.bincount(owners, minlength=len(distinct))
        value = word[back]
        if self.patterns:
            value = value + self.pattern_weights[pattern_ids(chunk)]
        # Whole numbers, so that a row's sums don't depend on the rows before it.
        value = np.rint(value * _UNIT).astype(np.int64)
        start, size = best_runs(value, chunk.bounds, self.window)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(value)])
        return (total[start + size] - total[start]) / (np.maximum(size, 1) * _UNIT) + self.offset


def best_runs(value: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each row's run of ``window`` words with the largest sum; the first of equal ones.

    Without a window, or with fewer words, the run is the row.
    """
    counts = np.diff(bounds)
    start, size = bounds[:-1].copy(), counts.copy()
    at = inside(bounds, window) if window else np.zeros(0, np.int64)
    if len(at):
        total = np.concatenate([np.zeros(1, value.dtype), np.cumsum(value)])
        sums = total[at + window] - total[at]
        rows = np.flatnonzero(counts >= window)
        first = np.searchsorted(at, bounds[rows])
        most = np.maximum.reduceat(sums, first)
        best = np.flatnonzero(sums == np.repeat(most, np.diff(np.append(first, len(at)))))
        start[rows] = at[best[np.searchsorted(best, first)]]
        size[rows] = window
    return start, size


def train(texts: pa.Array | pa.ChunkedArray, labels: np.ndarray, window: int = 0, lower: bool = False, patterns: bool = False,
          epochs: int = 6, batch: int = 64, rate: float = 0.3, seed: int = 7) -> Classifier:
    """Learn from texts with labels 0 and 1."""
    y = np.asarray(labels, np.int64)
    spread = len(texts) > 0 and 0 < y.sum() < len(y)
    if not spread:
        share = float(y.mean()) if len(y) else 0.5
        offset = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Classifier(np.zeros(BUCKETS), np.zeros(_PATTERNS), offset, window, lower, patterns)
    words, bounds, sub, sub_ptr, pats = _vocabulary(texts, lower, patterns)
    release_memory()
    rng = np.random.default_rng(seed)
    table = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    shapes = np.zeros((_PATTERNS, DIMENSIONS), np.float32)
    softmax = ((rng.random((DIMENSIONS, 2)) - 0.5) * 0.5).astype(np.float32)
    bias = np.zeros(2)
    frequent = _frequent(words, bounds, sub, sub_ptr)
    table[~frequent] = 0
    seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in (("table", table), ("shapes", shapes), ("softmax", softmax), ("bias", bias))}
    steps, done = epochs * -(-len(y) // batch), 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), -(-len(y) // batch)):
            step = rate * (1 - done / steps) + 1e-3
            done += 1
            counts = bounds[part + 1] - bounds[part]
            ptr = np.concatenate([[0], np.cumsum(counts)])
            flat = np.repeat(bounds[part] - ptr[:-1], counts) + np.arange(int(ptr[-1]))
            distinct, back = np.unique(words[flat], return_inverse=True)
            size = sub_ptr[distinct + 1] - sub_ptr[distinct]
            sptr = np.concatenate([[0], np.cumsum(size)])
            subs = sub[np.repeat(sub_ptr[distinct] - sptr[:-1], size) + np.arange(int(sptr[-1]))]
            vectors = np.add.reduceat(table[subs], sptr[:-1], axis=0) / size[:, None] if len(distinct) else np.zeros((0, DIMENSIONS), np.float32)
            value = vectors[back]
            if patterns:
                value = value + shapes[pats[flat]]
            # The first epoch learns from all words alike, the others from each text's most likely run.
            start, n = best_runs(value @ (softmax[:, 1] - softmax[:, 0]), ptr, window if epoch else 0)
            row = np.repeat(np.arange(len(part)), n)
            live = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            mean = np.stack([np.bincount(row, value[live, k], len(part)) for k in range(DIMENSIONS)], 1) / np.maximum(n, 1)[:, None]
            logit = mean @ softmax + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(p)), y[part]] -= 1
            p /= len(part)
            up = (p @ softmax.T) / np.maximum(n, 1)[:, None]
            _step(softmax, seen["softmax"], mean.T @ p, step)
            _step(bias, seen["bias"], p.sum(0), step)
            per_word = up[row]
            if patterns:
                grad = np.stack([np.bincount(pats[flat][live], per_word[:, k], _PATTERNS) for k in range(DIMENSIONS)], 1)
                _step(shapes, seen["shapes"], grad, step)
            grad = np.stack([np.bincount(back[live], per_word[:, k], len(distinct)) for k in range(DIMENSIONS)], 1) / size[:, None]
            used = np.flatnonzero(np.bincount(back[live], minlength=len(distinct)))
            which = np.repeat(np.arange(len(distinct)), size)
            keep = np.isin(which, used) if len(used) < len(distinct) else slice(None)
            kept = np.flatnonzero(frequent[subs[keep]])
            rows, at = np.unique(subs[keep][kept], return_inverse=True)
            which = which[keep][kept]
            grad = np.stack([np.bincount(at, grad[which, k], len(rows)) for k in range(DIMENSIONS)], 1)
            seen["table"][rows] += grad * grad
            table[rows] -= step * grad / np.sqrt(seen["table"][rows])
    direction = softmax[:, 1] - softmax[:, 0]
    del words, bounds, sub, sub_ptr, pats, vectors, value, mean, grad, flat, back, subs
    release_memory()
    return Classifier(table @ direction, shapes @ direction, float(bias[1] - bias[0]), window, lower, patterns)


def _step(weights: np.ndarray, seen: np.ndarray, grad: np.ndarray, step: float) -> None:
    seen += grad * grad
    weights -= step * grad / np.sqrt(seen)


def _frequent(words: np.ndarray, bounds: np.ndarray, sub: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Which buckets enough texts hold."""
    seen, last = np.zeros(BUCKETS, np.int32), np.full(BUCKETS, -1)
    for row in range(len(bounds) - 1):
        held = np.unique(words[bounds[row] : bounds[row + 1]])
        size = ptr[held + 1] - ptr[held]
        ids = sub[np.repeat(ptr[held] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        last[ids] = row
        ids = np.flatnonzero(last == row) if len(ids) > BUCKETS // 8 else np.unique(ids)
        seen[ids] += 1
    return seen >= LEAST_TEXTS


def _vocabulary(texts: pa.Array | pa.ChunkedArray, lower: bool, patterns: bool) -> tuple[np.ndarray, ...]:
    """Word numbers of all texts with row bounds, the buckets of each distinct word, and patterns."""
    known, numbers = np.zeros(0, _U64), np.zeros(0, np.int32)  # sorted hashes and their word numbers
    words, counts, pats, subs, sizes = [], [], [], [], []
    for chunk in chunks(texts, lower=lower):
        distinct, first, back = np.unique(chunk.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(known, distinct)
        new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != distinct) if len(known) else np.arange(len(distinct))
        ids, owners = subword_ids(chunk, first[new])
        order = np.argsort(owners, kind="stable")
        subs.append(ids[order])
        sizes.append(np.bincount(owners, minlength=len(new)))
        numbers = np.insert(numbers, at[new], np.arange(len(known), len(known) + len(new), dtype=np.int32))
        known = np.insert(known, at[new], distinct[new])
        words.append(numbers[np.searchsorted(known, distinct)][back])
        counts.append(chunk.counts)
        if patterns:
            pats.append(pattern_ids(chunk).astype(np.int8))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    ptr = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return np.concatenate(words), bounds, np.concatenate(subs), ptr, np.concatenate(pats) if patterns else np.zeros(0, np.int8)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS, size: int = BYTES, text: str = "text", doc_id: str = "doc_id") -> tuple[pa.ChunkedArray, np.ndarray]:
    """Texts and labels of the training rows; ``labels`` holds the ids that may be learned from.

    Rows with a null id or label are left out; of several labels of one id the largest counts.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.max(label) > 0).cast("int").alias("_label"))
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30))
    n = known.count()
    if n > rows:
        known = known.where(draw < int((1 << 30) * rows / n))
    folder = new_folder(spark, "sample")
    rows_of = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    rows_of.write.parquet(folder)
    stored = spark.read.schema("_id long, _text string, _label int").parquet(folder)
    held = stored.agg(F.sum(F.octet_length("_text")).alias("b"), F.count("*").alias("n")).first()
    share = min(1.0, size / max(held["b"] or 0, 1), 2 * rows / max(held["n"], 1))
    if share < 1:
        stored = stored.where(F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1 << 30)) < int((1 << 30) * share))
    got = stored.toArrow().sort_by([("_id", "ascending"), ("_label", "ascending"), ("_text", "ascending")])
    return got.column("_text"), got.column("_label").to_numpy()


def score(docs: DataFrame, model: Classifier, threshold: float, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ``score`` (0 to 1) and ``predicted`` (0 or 1).

    Null and empty texts get the score of no evidence. Columns named score and predicted are replaced.
    """
    keep = tuple(k for k in keep if k not in ("score", "predicted"))
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_scored_text"))
    width, at, shared = len(keep), rows.columns.index(text if text in keep else "_scored_text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(at), lower=model.lower):
                got = 1 / (1 + np.exp(-np.clip(model.logits(chunk), -500, 500)))
                part = batch.slice(chunk.first, chunk.rows)
                verdict = pa.array((got >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(got), verdict], [*keep, "score", "predicted"])

    kinds = [rows.schema[k] for k in keep]
    return rows.mapInArrow(run, StructType([*kinds, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def fold(modulus: int, remainder: int, doc_id: str = "doc_id") -> F.Column:
    """Whether the CRC-32 of the id as text leaves ``remainder``; a null id counts as the text ""."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Classifier:
    """Learns ``toxic`` from runs of 3 words in lower case: an insult is a word or two, wherever it stands."""
    return train(*sample(docs, labels, "toxic", text=text, doc_id=doc_id), window=3, lower=True, epochs=4)


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Classifier:
    """Learns ``quality`` from whole documents, cases kept."""
    return train(*sample(docs, labels, "quality", text=text, doc_id=doc_id), patterns=True, epochs=4)
