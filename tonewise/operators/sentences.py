"""A trained sentence model: word vectors composed pair by pair up a balanced tree, classified at its root.

A sentence's words are hashed to vectors. Neighbours are combined, left and right by matrices of their own, and the
results again, until one vector stands for the sentence; so the order of words counts ("not good" is no sum of
"not" and "good"). The root goes through a softmax over the classes.

Training is a barrier stage: each task holds its part of the labelled sentences. In every round a task steps along
the gradients of its own sentences, a batch at a time, from the parameters all share; then the tasks exchange the
sums of their steps, of the word vectors only the rows they touched, and all go on from the average. With one
batch a round that is the step along the joint gradient, whatever the number of tasks. An exchange costs about a
second, so there is one a round and not one a batch; its size is bounded by the model. A lost task starts the stage
again, with the same result. At most ``most_rows`` sentences, drawn by a hash of their id, are learnt from; that bounds
a task's memory.

Hashing and tokens are column expressions; Python sees arrays of small numbers only, in training and in scoring.
A null or empty sentence is one word of its own, so it gets the class that such sentences had in training.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.functions.text import longest_sentence

#: Most sentences that are learnt from.
MOST_ROWS = 200_000


@dataclass(frozen=True)
class SentenceSpec:
    """Size and training of a model; ``batch`` sentences make a step of one task."""

    buckets: int = 4096
    size: int = 16
    rounds: int = 12
    batch: int = 16
    rate: float = 0.3
    decay: float = 1e-4
    tasks: int = 4
    seed: int = 7
    most_rows: int = MOST_ROWS


def word_ids(sentence: Column, buckets: int) -> Column:
    """Numbers from 1 of the words in lower case; an empty sentence is [0]."""
    words = F.filter(F.split(F.lower(F.coalesce(sentence, F.lit(""))), r"[^\p{L}\p{N}']+"), lambda w: w != "")
    ids = F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(buckets - 1)) + 1).cast("int"))
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(0)))


@dataclass
class SentenceModel:
    """Parameters: word vectors, the two sides and the bias of a composition, and the classes' weights."""

    classes: tuple[float, ...]
    params: dict[str, np.ndarray] = field(repr=False)

    @staticmethod
    def fresh(classes: Sequence[float], spec: SentenceSpec) -> SentenceModel:
        rng, d = np.random.default_rng(spec.seed), spec.size
        half = np.eye(d) / 2
        return SentenceModel(
            tuple(classes),
            {
                "words": rng.normal(0, 0.3, (spec.buckets, d)),
                "left": half + rng.normal(0, 0.2, (d, d)),
                "right": half + rng.normal(0, 0.2, (d, d)),
                "bias": np.zeros(d),
                "out": rng.normal(0, 0.3, (d, len(classes))),
                "out_bias": np.zeros(len(classes)),
            },
        )

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, classes=np.array(self.classes, float), **self.params)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> SentenceModel:
        with np.load(io.BytesIO(data)) as arrays:
            return SentenceModel(tuple(arrays["classes"].tolist()), {k: arrays[k] for k in arrays.files if k != "classes"})

    def compose(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Root vectors of sentences given as one row of word numbers, and what a backward pass needs."""
        p, values, steps = self.params, self.params["words"][ids], []
        while len(sizes) and sizes.max() > 1:
            starts = np.cumsum(sizes) - sizes
            half = (sizes + 1) // 2
            sentence = np.repeat(np.arange(len(sizes)), half)
            at = np.arange(len(sentence)) - (np.cumsum(half) - half)[sentence]
            left = starts[sentence] + 2 * at
            paired = np.flatnonzero(2 * at + 1 < sizes[sentence])  # an odd last one goes up as it is
            higher = values[left]
            a, b = values[left[paired]], values[left[paired] + 1]
            higher[paired] = np.tanh(a @ p["left"] + b @ p["right"] + p["bias"])
            steps.append((left, paired, a, b, higher, len(values)))
            values, sizes = higher, half
        return values, steps

    def probabilities(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        roots, _ = self.compose(ids, sizes)
        return _softmax(roots @ self.params["out"] + self.params["out_bias"])

    def gradients(self, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Summed loss and gradients; those of the words are rows for np.unique(ids)."""
        p = self.params
        roots, steps = self.compose(ids, sizes)
        error = _softmax(roots @ p["out"] + p["out_bias"])
        loss = -float(np.log(np.maximum(error[np.arange(len(labels)), labels], 1e-300)).sum())
        error[np.arange(len(labels)), labels] -= 1
        grads = {"out": roots.T @ error, "out_bias": error.sum(0), "left": np.zeros_like(p["left"]), "right": np.zeros_like(p["right"]), "bias": np.zeros_like(p["bias"])}
        flow = error @ p["out"].T
        for left, paired, a, b, higher, n in reversed(steps):
            below = np.zeros((n, flow.shape[1]))
            single = np.ones(len(left), bool)
            single[paired] = False
            below[left[single]] = flow[single]
            inner = flow[paired] * (1 - higher[paired] ** 2)
            grads["left"] += a.T @ inner
            grads["right"] += b.T @ inner
            grads["bias"] += inner.sum(0)
            below[left[paired]] = inner @ p["left"].T
            below[left[paired] + 1] = inner @ p["right"].T
            flow = below
        rows, back = np.unique(ids, return_inverse=True)
        grads["words"] = np.zeros((len(rows), flow.shape[1]))
        np.add.at(grads["words"], back, flow)
        grads["rows"] = rows
        return loss, grads


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
    return x / x.sum(1, keepdims=True) if len(x) else x


_DENSE = ("left", "right", "bias", "out", "out_bias")


def local_round(model: SentenceModel, spec: SentenceSpec, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, order: np.ndarray) -> dict[str, np.ndarray]:
    """One task's steps from the shared parameters: their sums weighted by sentences, or by occurrences of a word."""
    start = {k: v.copy() for k, v in model.params.items()}
    rows, uses = np.unique(ids, return_counts=True)
    for part in np.array_split(order, max(1, -(-len(order) // spec.batch))) if len(order) else []:
        some, lengths = _slices(ids, sizes, part)
        _, grads = model.gradients(some, lengths, labels[part])
        for name in _DENSE:
            model.params[name] -= spec.rate * (grads[name] / len(part) + spec.decay * model.params[name])
        touched, times = np.unique(some, return_counts=True)
        words = model.params["words"]
        words[touched] -= spec.rate * (grads["words"] / times[:, None] + spec.decay * words[touched])
    moved = {k: (model.params[k] - start[k]) * len(order) for k in _DENSE}
    moved |= {"n": np.array(len(order)), "rows": rows, "uses": uses, "words": (model.params["words"][rows] - start["words"][rows]) * uses[:, None]}
    model.params.update(start)
    return moved


def averaged(model: SentenceModel, parts: list[dict[str, np.ndarray]]) -> None:
    """Move the shared parameters by the average of all tasks' steps."""
    n = sum(int(p["n"]) for p in parts)
    if not n:
        return
    for name in _DENSE:
        model.params[name] += sum(p[name] for p in parts) / n
    rows = np.unique(np.concatenate([p["rows"] for p in parts])).astype(np.int64)
    words, uses = np.zeros((len(rows), model.params["words"].shape[1])), np.zeros(len(rows))
    for p in parts:
        at = np.searchsorted(rows, p["rows"].astype(np.int64))
        words[at] += p["words"]
        uses[at] += p["uses"]
    model.params["words"][rows] += words / uses[:, None]


def _packed(parts: dict[str, np.ndarray]) -> str:
    out = io.BytesIO()
    np.savez(out, **parts)
    return base64.b64encode(out.getvalue()).decode()


def _unpacked(text: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(base64.b64decode(text))) as arrays:
        return {k: arrays[k] for k in arrays.files}


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())


def _slices(ids: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = (np.cumsum(sizes) - sizes)[chosen]
    some = sizes[chosen]
    at = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(starts, some)
    return ids[at], some


def train_sentences(sentences: DataFrame, classes: Sequence[float], spec: SentenceSpec = SentenceSpec(), key: str = "tweet_id", sentence: str = "sentence", label: str = "label") -> SentenceModel:
    """A model learnt from (key, sentence, label); labels outside ``classes`` are left out."""
    spark = sentences.sparkSession
    rows = sentences.where(F.col(label).isin(list(classes)))
    total = rows.count()
    if not total:
        raise ValueError("no sentence has one of the classes")
    draw = F.pmod(F.xxhash64(F.lit(spec.seed), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, spec.most_rows / total))
    number = F.array_position(F.array(*[F.lit(float(c)) for c in classes]), F.col(label).cast("double")) - 1
    ready = rows.where(draw).select(F.col(key).alias("key"), word_ids(F.col(sentence), spec.buckets).alias("ids"), number.cast("int").alias("label"))
    tasks = max(1, min(spec.tasks, spark.sparkContext.defaultParallelism))
    dealt = ready.repartition(tasks, "key").sortWithinPartitions("key", "label").select("ids", "label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        parts = [(*_arrays(b.column(0)), b.column(1).to_numpy()) for b in batches if len(b)]
        ids, sizes, labels = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        model = SentenceModel.fresh(classes, spec)
        for turn in range(spec.rounds):
            order = np.random.default_rng([spec.seed, turn, context.partitionId()]).permutation(len(sizes))
            moved = local_round(model, spec, ids, sizes, labels, order)
            averaged(model, [_unpacked(m) for m in context.allGather(_packed(moved))])
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])

    (found,) = dealt.mapInArrow(learn, "model binary", barrier=True).collect()
    return SentenceModel.from_bytes(bytes(found["model"]))


def score_sentences(sentences: DataFrame, model: SentenceModel, keep: Sequence[str] = ("tweet_id",), sentence: str = "sentence") -> DataFrame:
    """The columns ``keep``, the most likely class as ``prediction`` (of equals the first) and its ``probability``."""
    buckets, classes = len(model.params["words"]), np.array(model.classes)
    rows = sentences.select(*keep, word_ids(F.col(sentence), buckets).alias("_word_ids"))
    width, data = len(keep), model.to_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = SentenceModel.from_bytes(data)
        for batch in batches:
            ids, sizes = _arrays(batch.column(width))
            found = loaded.probabilities(ids, sizes).reshape(len(batch), len(classes))
            best = found.argmax(1) if len(batch) else np.zeros(0, np.int64)
            scored = [pa.array(classes[best]), pa.array(found[np.arange(len(best)), best])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *scored], [*keep, "prediction", "probability"])

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)
    return rows.mapInArrow(run, f"{kinds}prediction double, probability double")


def longest_sentences(tweets: DataFrame, keep: Sequence[str] = ("tweet_id",), text: str = "tweetText") -> DataFrame:
    """Each text's longest sentence, the one that stands for it."""
    return tweets.select(*keep, longest_sentence(F.col(text)).alias("sentence"))


def save_sentences(model: SentenceModel, spark, path: str) -> None:
    """One row of a table: the parameters are bounded by the spec, not by the data."""
    spark.createDataFrame([(bytearray(model.to_bytes()),)], "model binary").write.mode("overwrite").parquet(path)


def load_sentences(spark, path: str) -> SentenceModel:
    return SentenceModel.from_bytes(bytes(spark.read.schema("model binary").parquet(path).first()["model"]))
