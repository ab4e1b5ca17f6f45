"""Packing of tokenised documents into sequences, shortest pack first over the length histogram.

1. One pass tokenises every document, cuts it into pieces of at most ``length`` tokens and writes the
   pieces with their place among the pieces of equal length of the same task.
2. The histogram of piece lengths, at most ``length`` rows, goes to the driver. Lengths are placed
   longest first into the pack with the most room; packs of one make are held as a pattern and a
   count, so the work depends on the number of lengths, not of documents.
3. Counts per task and length give every piece its rank among all pieces of its length; the rank
   finds the pattern, the sequence and the offset. The table of patterns is bounded by ``length``.

No step gathers pieces of one length: ranks come from counters in the tasks and a prefix sum over
their totals. Pieces are stored in the shared folder before their counts are taken, so a lost
executor cannot change a rank.

Null text is empty; an empty document is its end id alone. Rows that share an id are packed each for
itself. An empty table gives no sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewise.llm.store import new_folder
from tonewise.llm.words import _BASE, _BYTE, _LOWER, _SPACE, CHUNK_BYTES, Chunk, mix, powers, split_rows, text_bytes, words_of

LENGTH = 2048
END_ID = 1
#: Words that a worker keeps with their ids: those met again, as a table, and those met once so far.
KEPT, MET = 400_000, 150_000

#: Lower-case letters of ASCII and Latin-1 as UTF-8, which no normalisation changes.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Letters and then ASCII punctuation, which is one token group of its own.
_ENDED = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]+)")
_CAPITALS = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The alphabet of bytes: printed ones stand for themselves, the others follow from 256 on; a space stays.
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTED))) if b != 32}

#: Kinds of bytes: 1 lower-case letters, 2 ASCII punctuation; and second bytes of Latin-1 letters.
_KIND = np.zeros(256, np.int8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 2
_LATIN, _LATIN_CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_LATIN[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_LATIN_CAPITAL[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = True

_caches: dict[str, WordCache] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _small(letter: re.Match) -> bytes:
    return bytes((0xC3, letter[0][1] + 32))


class WordCache:
    """Ids of words; the tokenizer drops white space, so a text's ids are those of its words in a row.

    It also folds case, so words are looked up in lower case, and letters and the punctuation behind
    them are encoded apart. Words are told apart by their hashes, and the bytes of equal hashes are compared.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # For words of lower-case letters the rules before the merges change nothing but the alphabet
        # of bytes, so many of them go through the merges at once; the last token of each is marked.
        rules = json.loads(Path(path).read_text())
        rules |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(rules))
        suffix = rules["model"]["end_of_word_suffix"]
        self.last = np.zeros(max(rules["model"]["vocab"].values()) + 1, bool)
        self.last[[i for token, i in rules["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.table = WordTable([], [])
        self.met: dict[bytes, bytes] = {}
        self.again: dict[bytes, bytes] = {}

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the n + 1 places where those of a text begin."""
        words = _words(data, offsets)
        order = np.argsort(words.hashes)
        ranked = words.hashes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(order)]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        size = words.ends - words.starts
        if not _same(words.data, words.starts, size, words.data, words.starts[first][which], size[first][which]).all():
            first = which = np.arange(len(order))  # two words of one hash: each word stands for itself
        begin, sizes, missing = self.table.find(words.data, words.starts[first], size[first], words.hashes[first])
        text, lost = words.data.tobytes(), first[missing]
        found = self._found([text[a:b] for a, b in zip(words.starts[lost].tolist(), words.ends[lost].tolist())])
        sizes[missing] = [len(f) // 4 for f in found]
        begin[missing] = len(self.table.ids) + np.cumsum(sizes[missing]) - sizes[missing]
        ids = np.concatenate([self.table.ids, np.frombuffer(b"".join(found), "<u4")])
        if len(self.again) > max(20_000, len(self.table.hashes) // 4):
            old = self.table if len(self.table.hashes) + len(self.again) <= KEPT else None
            self.table, self.again = WordTable(list(self.again), list(self.again.values()), old), {}
        many = sizes[which]
        ends = np.cumsum(many)
        at = np.arange(many.sum()) + np.repeat(begin[which] - ends + many, many)
        return ids[at], np.concatenate([[0], ends])[words.bounds]

    def _found(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of words that are not in the table."""
        again = {w: self.met.pop(w) for w in words if w in self.met}
        self.again |= again
        new = [w for w in words if w not in self.again]
        if new:
            # In lower case a word could turn into a special token, which counts in this case only.
            blob = b" ".join(new)
            low = _CAPITALS.sub(_small, blob.lower()).split(b" ")
            if b"<|" in blob:
                low = [w if b"<|" in w else x for w, x in zip(new, low)]
            ids = self._encode(set(low))
            if len(self.met) + len(new) > MET:
                self.met.clear()
            here = dict(zip(new, map(ids.__getitem__, low)))
            self.met |= here
        else:
            here = {}
        return [here[w] if w in here else self.again[w] for w in words]

    def _encode(self, words: set[bytes]) -> dict[bytes, bytes]:
        rest = [w for w in words if not (w.isalpha() and w.islower())]
        stems = {w: found.groups() for w in rest if (found := _ENDED.fullmatch(w))}
        plain = words.difference(stems).union(*stems.values())
        letters = [w for w in plain if (w.isalpha() and w.islower()) or _LETTERS.fullmatch(w)]
        found = self._letters(letters)
        plain = list(plain.difference(letters))
        for start in range(0, len(plain), 20_000):
            part = plain[start : start + 20_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                found[word] = array("I", got.ids).tobytes()
        return {w: found[stems[w][0]] + found[stems[w][1]] if w in stems else found[w] for w in words}

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        words = sorted(words, key=bytes.isascii)  # words of ASCII letters need no translation
        parts = [b" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        texts = [p.decode("ascii") if p.isascii() else p.decode("latin-1").translate(_BYTES) for p in parts]
        ids = [np.array(got.ids, "<u4") for got in self.merges.encode_batch_fast(texts, add_special_tokens=False)]
        if not ids:
            return {}
        ids = np.concatenate(ids)
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        blob = ids.tobytes()
        return {w: blob[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}


class WordTable:
    """Words with their ids as sorted hashes, their bytes and ids one after another."""

    def __init__(self, words: list[bytes], ids: list[bytes], old: WordTable | None = None):
        blob = np.frombuffer(b" ".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        many = np.array([len(i) // 4 for i in ids], np.int64)
        columns = [hashes_of(blob, np.cumsum(sizes + 1) - sizes - 1, sizes), np.cumsum(sizes + 1) - sizes - 1, sizes, np.cumsum(many) - many, many]
        self.words, self.ids = blob, np.frombuffer(b"".join(ids), "<u4")
        if old is not None:
            shift = [0, len(old.words), 0, len(old.ids), 0]
            columns = [np.concatenate([o, c + c.dtype.type(by)]) for o, c, by in zip(old.columns, columns, shift)]
            self.words, self.ids = np.concatenate([old.words, self.words]), np.concatenate([old.ids, self.ids])
        order = np.argsort(columns[0], kind="stable")
        self.columns = [c[order] for c in columns]
        self.hashes = self.columns[0]

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of each word, and which words are not here."""
        if not len(self.hashes):
            return np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.arange(len(starts))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known, start, size, begin, many = (c[at] for c in self.columns)
        here = known == hashes
        here[here] = _same(data, starts[here], sizes[here], self.words, start[here], size[here])
        return begin, many, np.flatnonzero(~here)


def hashes_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    up, down = powers(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[starts + sizes] - total[starts]) * down[starts] + sizes.astype(np.uint64))


def _same(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, others: np.ndarray, at: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether two words have the same bytes, pair by pair."""
    same = sizes == other_sizes
    size = np.where(same, sizes, 0)
    ends = np.cumsum(size)
    place = np.arange(size.sum())
    wrong = np.flatnonzero(data[place + np.repeat(starts - ends + size, size)] != others[place + np.repeat(at - ends + size, size)])
    same[np.searchsorted(ends, wrong, side="right")] = False
    return same


def _words(data: np.ndarray, offsets: np.ndarray) -> Chunk:
    """Words in lower case, with the punctuation behind a word of letters as a word of its own."""
    if b"<|" not in data.tobytes():
        data = _LOWER[data]
        capital = np.flatnonzero((data[:-1] == 0xC3) & _LATIN_CAPITAL[data[1:]]) + 1
        data[capital] += 0x20
    words, n = words_of(data, offsets), len(data)
    if not len(words.starts):
        return words
    kind = _KIND[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
    kind[latin] = kind[latin + 1] = 1
    body = np.maximum.accumulate(np.where(kind != 2, np.arange(n), -1))[words.ends - 1] + 1
    other = np.concatenate([[0], np.cumsum(kind != 1)])
    split = np.flatnonzero((body > words.starts) & (body < words.ends))
    split = split[other[body[split]] == other[words.starts[split]]]
    starts, ends = (np.sort(np.concatenate([edge, body[split]])) for edge in (words.starts, words.ends))
    return Chunk(0, words.rows, data, offsets, starts, ends, hashes_of(data, starts, ends - starts), np.searchsorted(starts, offsets))


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about ``CHUNK_BYTES`` that begin at white space."""
    start = 0
    while len(data) - start > CHUNK_BYTES:
        end, seek = start + CHUNK_BYTES, 0
        while end < len(data):  # to the next white space, however far it is
            gap = np.flatnonzero(_SPACE[data[end : end + (4096 << seek)]])
            if len(gap):
                end += int(gap[0])
                break
            end, seek = min(len(data), end + (4096 << seek)), seek + 1
        yield data[start:end]
        start = end
    yield data[start:]


def word_ids(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts that lie in ``data`` between ``offsets``, and the places where those of each begin."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    cache = _caches[path]
    if len(offsets) == 2:
        ids = np.concatenate([cache.ids(part, np.array([0, len(part)]))[0] for part in _parts(data)])
        return ids, np.array([0, len(ids)])
    return cache.ids(data, offsets)


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """(piece lengths, number of sequences) of every pattern."""
    open_, patterns, made = [], {}, 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if open_ and -open_[0][0] >= size:
                room, name = heappop(open_)
                pieces, count = patterns.pop(name)
                used = min(count, left)
                if used < count:
                    patterns[name] = (pieces, count - used)
                    heappush(open_, (room, name))
                pieces, room = [*pieces, size], -room - size
            else:
                pieces, room, used = [size], length - size, left
            left -= used
            patterns[made] = (pieces, used)
            if room:
                heappush(open_, (-room, made))
            made += 1
    return list(patterns.values())


def slots(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each place in a pattern: its length with its first rank (sorted), first sequence and offset."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pieces, count in patterns:
        at = 0
        for size in pieces:
            rows.append((size << 44 | ranks.get(size, 0), sequence, at))
            ranks[size] = ranks.get(size, 0) + count
            at += size
        sequence += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, tokenizer: str | None = None, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset and, if asked, ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers. A sequence is its pieces in the order of offset.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind, folder = docs.schema["id"].dataType.simpleString(), new_folder(spark, "packing")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for first, last in split_rows(offsets):
                found, bounds = word_ids(path, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                # Each text's ids and its end id, one text after another.
                every = np.insert(found, bounds[1:], END_ID).astype("<u4", copy=False)
                total = np.diff(bounds) + 1
                count = -(-total // length)
                row = np.repeat(np.arange(len(total)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(length, total[row] - start)
                begin = (np.cumsum(total) - total)[row] + start
                blob = memoryview(every.tobytes())
                cut = [blob[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + size).tolist())]
                crc = np.array([zlib.crc32(c) for c in cut], np.int64)
                order = np.argsort(size, kind="stable")
                lengths, at, many = np.unique(size[order], return_index=True, return_counts=True)
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.repeat(at, many) + np.repeat(seen[lengths], many)
                seen[lengths] += many
                columns = [batch.column(0).slice(first, last - first).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(total[row]), pa.array(crc)]
                columns += [pa.array(np.full(len(row), task, np.int64)), pa.array(place)]
                if ids:
                    columns.append(pa.array([bytes(c) for c in cut], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "doc_tokens", "crc", "task", "place", *(["ids"] if ids else [])])

    kinds = f"id {kind}, start long, length long, doc_tokens long, crc long, task long, place long" + (", ids binary" if ids else "")
    docs.mapInArrow(pieces, kinds).write.parquet(f"{folder}/pieces")
    stored = spark.read.schema(kinds).parquet(f"{folder}/pieces")
    counts = stored.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts.write.parquet(f"{folder}/counts")
    counts = spark.read.schema("length long, task long, n long").parquet(f"{folder}/counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, length)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = stored.join(base, ["length", "task"])
    ranked = ranked.select("id", "start", "length", "doc_tokens", "crc", (F.col("base") + F.col("place")).alias("rank"), *(["ids"] if ids else []))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = table.value
        for batch in batches:
            key = batch.column(2).to_numpy() << 44 | batch.column(5).to_numpy()
            at = np.searchsorted(made["key"], key, side="right") - 1
            columns = [*batch.columns[:5], pa.array(made["sequence"][at] + key - made["key"][at]), pa.array(made["offset"][at]), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, out)

    out = [doc_id, "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset", *(["ids"] if ids else [])]
    return ranked.mapInArrow(place, ", ".join(f"`{c}` {kind if c == doc_id else 'binary' if c == 'ids' else 'long'}" for c in out))
