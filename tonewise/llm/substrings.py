"""Removal of long word passages that already stand in an earlier document.

A word goes if it lies in a window of ``window`` consecutive words that also occurs in a document
with a smaller id. The reference is the collection itself, so it is cut into shards that are never
sent to all workers; a passage meets exactly those shards that can match it:

1. Every window names one anchor, the smallest hash among its shorter runs of words, so equal windows
   name equal anchors. Anchors found in two or more documents are kept as sorted hash arrays.
2. The context of such an anchor is the words a window around it can reach. Equal contexts are one
   reference text, owned by the smallest id; all its other owners lose the whole context.
3. Anchors with more than one context form the reference shards. A shard builds a suffix automaton
   of the contexts of each anchor, in the order of their ids, and streams every context through the
   automaton of the earlier ones: its matching statistics mark the windows of the owner that stand
   in an earlier document. An anchor with over ``CONTEXTS`` contexts would make one task grow with
   the data; its windows are instead grouped by their own hash over all tasks, with the same result.
4. Documents are streamed once more, and the maximal spans of marked windows are cut out.

Ids are compared as numbers; a null id counts as larger than all others and rows that share an id
are one document as far as "earlier" goes. Null text stays null and has no words. Texts shorter than
a window are never changed. Columns besides the text pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tonewise.llm import store
from tonewise.llm.words import Chunk, chunks, grams, inside, mix

#: Contexts of one anchor that an automaton takes; beyond, windows are compared by hash.
CONTEXTS = 200

_U64 = np.uint64
_LAST = np.iinfo(np.int64).max
ANCHOR = {"low": "i8", "high": "i8"}
OWNER = {"owner": "i8", "hot": "u1"}


def doc_numbers(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.int64())
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


def leftmost_minimum(values: np.ndarray, n: int) -> np.ndarray:
    """Position of the first smallest value of each n consecutive ones."""
    at, low, span = np.arange(len(values)), values, 1
    while span < n:
        step = min(span, n - span)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        span += step
    return at


class Anchors:
    """The anchors of a chunk's windows, and their contexts."""

    def __init__(self, chunk: Chunk, window: int):
        self.k = max(1, window // 2)
        self.reach = window - self.k
        self.starts = inside(chunk.bounds, window)
        if not len(self.starts):
            self.at = self.rows = self.low = self.high = np.zeros(0, np.int64)
            self.key = self.context = np.zeros(0, _U64)
            return
        runs = grams(chunk.hashes, self.k)
        self.at = np.unique(leftmost_minimum(runs, self.reach + 1)[self.starts])
        self.key = mix(runs[self.at])  # the smallest hashes alone would crowd the first shards
        self.rows = np.searchsorted(chunk.bounds, self.at, side="right") - 1
        self.low = np.maximum(self.at - self.reach, chunk.bounds[self.rows])
        self.high = np.minimum(self.at + window, chunk.bounds[self.rows + 1])
        # A context is told apart by its anchor, its words before and its words after.
        total = _Ranges(chunk.hashes)
        sides = mix(total(self.low, self.at) + _U64(1)) + mix(total(self.at, self.high)) * _U64(3)
        self.context = mix(sides ^ mix(self.key + _U64(7)))

    def some(self, keep: np.ndarray) -> None:
        for name in ("at", "rows", "low", "high", "key", "context"):
            setattr(self, name, getattr(self, name)[keep])


class _Ranges:
    """Hashes of ranges of words."""

    def __init__(self, hashes: np.ndarray):
        from tonewise.llm.words import _GRAM, powers

        up, self.down = powers(_GRAM, len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, _U64)
        np.cumsum(hashes * up[: len(hashes)], out=self.total[1:])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.total[high] - self.total[low]) * self.down[low] + (high - low).astype(_U64))


class Automaton:
    """Suffix automaton of texts added in the order of their ids; a state knows the first id that reached it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, moves: dict[int, int], link: int, length: int, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _clone(self, state: int, old: int, word: int) -> int:
        new = self._state(dict(self.next[old]), self.link[old], self.length[state] + 1, self.first[old])
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def add(self, words: list[int], doc: int) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            old = following[last].get(word)
            if old is not None:
                last = old if length[old] == length[last] + 1 else self._clone(last, old, word)
                continue
            new = self._state({}, 0, length[last] + 1, doc)
            state = last
            while state >= 0 and word not in following[state]:
                following[state][word] = new
                state = link[state]
            if state >= 0:
                old = following[state][word]
                link[new] = old if length[old] == length[state] + 1 else self._clone(state, old, word)
            last = new

    def matches(self, words: list[int], doc: int, window: int) -> Iterator[int]:
        """Ends of the windows that stand in a text of a smaller id."""
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        for end, word in enumerate(words, 1):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                if self.first[state] < doc:
                    yield end


def repeats(docs: DataFrame, text: str, doc_id: str, window: int) -> tuple[str, int]:
    """Folder and shard bits of the arrays that say which windows to remove."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    folder, bits = store.new_folder(spark, "substrings"), store.shard_bits(docs)
    how = {"low": "min", "high": "max"}

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = store.Writer(ANCHOR, how, bits)
        for batch in batches:
            ids = doc_numbers(batch.column(0))
            for chunk in chunks(batch.column(1)):
                found = Anchors(chunk, window)
                doc = ids[chunk.first + found.rows]
                if (out := sent.add(found.key, {"low": doc, "high": doc})) is not None:
                    yield out
        if (out := sent.flush()) is not None:
            yield out

    def shared(keys: np.ndarray, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"key": keys[values["low"] != values["high"]]}

    store.build(docs.mapInArrow(anchors, store.schema(ANCHOR)), folder, "anchor", bits, ANCHOR, how, shared)

    def repeated(chunk: Chunk) -> Anchors:
        found = Anchors(chunk, window)
        found.some(store.lookup(folder, "anchor", bits, found.key, {}, {})["found"])
        return found

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = doc_numbers(batch.column(0))
            for chunk in chunks(batch.column(1)):
                found = repeated(chunk)
                columns = [found.key.view("i8"), found.context.view("i8"), ids[chunk.first + found.rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "context", "id"])

    owners = docs.mapInArrow(contexts, "anchor long, context long, id long").groupBy("anchor", "context").agg(F.min("id").alias("owner"))
    owners.write.parquet(f"{folder}/owners")
    owners = spark.read.parquet(f"{folder}/owners")
    limit = CONTEXTS

    def packed(name: str, dtype: str, how: str) -> Callable:
        """Packs (key, value) rows for a table of one column."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = store.Writer({name: dtype}, {name: how}, bits)
            for batch in batches:
                out = sent.add(batch.column(0).to_numpy().view("u8"), {name: batch.column(1).to_numpy().view(dtype)})
                if out is not None:
                    yield out
            if (out := sent.flush()) is not None:
                yield out

        return run

    # The number of an anchor's contexts is looked up where the contexts are, so those of a hot anchor stay spread.
    several = owners.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    store.build(several.mapInArrow(packed("n", "i8", "add"), store.schema({"n": "i8"})), folder, "several", bits, {"n": "i8"}, {"n": "add"})

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = store.Writer(OWNER, {"owner": "min", "hot": "max"}, bits)
        for batch in batches:
            n = store.lookup(folder, "several", bits, batch.column(0).to_numpy().view("u8"), {"n": "i8"}, {"n": 0})["n"]
            values = {"owner": batch.column(2).to_numpy(), "hot": ((n > 0).astype("u1") + (n > limit)).astype("u1")}
            if (out := sent.add(batch.column(1).to_numpy().view("u8"), values)) is not None:
                yield out
        if (out := sent.flush()) is not None:
            yield out

    kinds = owners.select("anchor", "context", "owner")
    store.build(kinds.mapInArrow(owned, store.schema(OWNER)), folder, "owner", bits, OWNER, {"owner": "min", "hot": "max"})

    cold_names, hot_names = ["anchor", "context", "id", "before", "words"], ["shard", "key", "low"]
    shape = "anchor long, context long, id long, before int, words binary, shard int, key binary, low binary"

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of their owners: words for the automata, or windows, packed by task, where there are too many."""
        windows = store.Writer({"low": "i8"}, {"low": "min"}, bits)

        def packed_rows(sent: pa.RecordBatch) -> pa.RecordBatch:
            none = [pa.nulls(len(sent), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, *sent.columns], [*cold_names, *hot_names])

        for batch in batches:
            ids = doc_numbers(batch.column(0))
            for chunk in chunks(batch.column(1)):
                found = repeated(chunk)
                doc = ids[chunk.first + found.rows]
                known = store.lookup(folder, "owner", bits, found.context, OWNER, {"owner": -1, "hot": 0})
                mine = known["found"] & (known["owner"] == doc) & (known["hot"] > 0)
                hot = known["hot"][mine] == 2
                found.some(mine)
                doc = doc[mine]
                cold = np.flatnonzero(~hot)
                hashes = chunk.hashes
                rows = [
                    pa.array(found.key[cold].view("i8")),
                    pa.array(found.context[cold].view("i8")),
                    pa.array(doc[cold]),
                    pa.array((found.at - found.low)[cold].astype("i4")),
                    pa.array([hashes[a:b].tobytes() for a, b in zip(found.low[cold], found.high[cold])], pa.binary()),
                ]
                none = [pa.nulls(len(cold), kind) for kind in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows, *none], [*cold_names, *hot_names])
                starts, of = windows_of(found, np.flatnonzero(hot), window)
                if len(starts) and (out := windows.add(grams(hashes, window)[starts], {"low": doc[of]})) is not None:
                    yield packed_rows(out)
        if (out := windows.flush()) is not None:
            yield packed_rows(out)

    docs.mapInArrow(references, shape).write.parquet(f"{folder}/references")
    found = spark.read.schema(shape).parquet(f"{folder}/references")

    def marks(table: pa.Table) -> pa.Table:
        """The windows of each context that stand in an earlier document, as bits from the first.

        They leave as packed rows, so that no second Python worker runs behind this one in the same task.
        """
        table = table.combine_chunks().sort_by([("anchor", "ascending"), ("id", "ascending"), ("context", "ascending")])
        anchor, ids, before = (table.column(c).to_numpy() for c in ("anchor", "id", "before"))
        keys, masks = [], []
        reach, automaton, last = window - max(1, window // 2), Automaton(), None
        for i, words in enumerate(table.column("words")):
            if anchor[i] != last:
                automaton, last = Automaton(), anchor[i]
            words, doc = np.frombuffer(words.as_buffer(), "u8").tolist(), int(ids[i])
            mask = 0
            for end in automaton.matches(words, doc, window):
                mask |= 1 << (end - window + reach - int(before[i]))
            automaton.add(words, doc)
            if mask:
                keys.append(table.column("context")[i].as_py())
                masks.append(mask)
        sent = store.pack(*merged_masks(np.array(keys, np.int64).view("u8"), np.array(masks, "u8")), bits)
        return pa.Table.from_batches([sent])

    shards = F.pmod(F.xxhash64("anchor"), F.lit(4 << bits)).cast("int")
    marked = found.where("words is not null").withColumn("shard", shards).groupBy("shard").applyInArrow(marks, store.schema({"mask": "u8"}))
    early = found.where("shard is not null").select("shard", "key", "low")

    store.build(marked, folder, "mask", bits, {"mask": "u8"}, {"mask": "max"})
    store.build(early, folder, "window", bits, {"low": "i8"}, {"low": "min"})
    return folder, bits


def merged_masks(keys: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sorted distinct contexts with their marks."""
    return store.merged(keys, {"mask": masks}, {"mask": "max"})


def windows_of(found: Anchors, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows around the anchors ``which``, and the anchor of each."""
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = found.at[which][:, None] + np.arange(-found.reach, 1)
    fits = (starts >= found.low[which][:, None]) & (starts + window <= found.high[which][:, None])
    return starts[fits], np.repeat(which, fits.sum(1))


def removed(chunk: Chunk, ids: np.ndarray, folder: str, bits: int, window: int) -> np.ndarray:
    """Which words of the chunk go."""
    gone = np.zeros(len(chunk.hashes) + 1, np.int64)
    found = Anchors(chunk, window)
    found.some(store.lookup(folder, "anchor", bits, found.key, {}, {})["found"])
    doc = ids[chunk.first + found.rows]
    known = store.lookup(folder, "owner", bits, found.context, OWNER, {"owner": _LAST, "hot": 0})
    whole = known["found"] & (known["owner"] < doc) & (found.high - found.low >= window)
    np.add.at(gone, found.low[whole], 1)
    np.add.at(gone, found.high[whole], -1)
    own = np.flatnonzero(known["found"] & (known["owner"] == doc) & (known["hot"] == 1))
    mask = store.lookup(folder, "mask", bits, found.context[own], {"mask": "u8"}, {"mask": 0})["mask"]
    own, mask = own[mask > 0], mask[mask > 0]
    which, bit = np.nonzero(mask[:, None] >> np.arange(found.reach + 1).astype(_U64) & _U64(1)) if len(own) else (own, own)
    starts = found.at[own[which]] - found.reach + bit if len(own) else own
    hot = np.flatnonzero(known["found"] & (known["owner"] == doc) & (known["hot"] == 2))
    at, of = windows_of(found, hot, window)
    if len(at):
        early = store.lookup(folder, "window", bits, grams(chunk.hashes, window)[at], {"low": "i8"}, {"low": _LAST})["low"]
        starts = np.concatenate([starts, at[early < doc[of]]])
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + window, -1)
    return np.cumsum(gone[:-1]) > 0


def dedupe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 50) -> DataFrame:
    """All columns, the text without its repeated passages, and ``n_words`` and ``n_removed``.

    Kept words keep the white space between them; a text that loses nothing is unchanged. Two more
    columns of these names replace any that ``docs`` has.
    """
    if not 2 <= window <= 126:
        raise ValueError("a window has 2 to 126 words")
    docs = docs.drop("n_words", "n_removed")
    folder, bits = repeats(docs, text, doc_id, window)
    names = docs.columns
    where, number = names.index(text), names.index(doc_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = doc_numbers(batch.column(number))
            for chunk in chunks(batch.column(where)):
                gone = removed(chunk, ids, folder, bits, window)
                part = batch.slice(chunk.first, chunk.rows)
                lost = np.add.reduceat(np.append(gone, False).astype(np.int64), chunk.bounds[:-1]) * (chunk.counts > 0)
                texts = part.column(where)
                if lost.any():
                    texts = pa.array(_cut_rows(chunk, gone, lost, texts), pa.string())
                columns = [texts if i == where else part.column(i) for i in range(len(names))]
                columns += [pa.array(chunk.counts, pa.int64()), pa.array(lost, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed"])

    return docs.mapInArrow(cut, StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())]))


def _cut_rows(chunk: Chunk, gone: np.ndarray, lost: np.ndarray, texts: pa.Array) -> Iterator[str | None]:
    for i in range(chunk.rows):
        if not lost[i]:
            yield texts[i].as_py()
            continue
        a, b = int(chunk.bounds[i]), int(chunk.bounds[i + 1])
        kept = np.flatnonzero(~gone[a:b]) + a
        runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1) if len(kept) else []
        pieces = [chunk.data[chunk.starts[r[0]] : chunk.ends[r[-1]]].tobytes() for r in runs]
        breaks = [b"\n" if b"\n" in chunk.data[chunk.ends[x[-1]] : chunk.starts[x[-1] + 1]].tobytes() else b" " for x in runs[:-1]]
        out = b"".join(p + s for p, s in zip(pieces, [*breaks, b""]))
        yield out.decode()


def kept_digest(text: F.Column) -> F.Column:
    """SHA-256 of the words joined by one space."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.sha2(words, 256)
